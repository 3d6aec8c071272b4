"""URL filter by a tree of path templates per host.

Paths are cut at ``/``. Going down from each host, a segment keeps its name where it holds at least
``SHARE`` of its parent's paths and ``LEAST`` of them; every other segment is variable and becomes ``*``
(with its file ending, if any). Going up again, branches of one parent whose templates below are the same
and whose labelled rates differ by less than ``Z`` standard errors become one branch, ``{a,b}``. A template
is rejected when its smoothed share of bad labelled paths reaches ``REJECT``: counts are drawn towards the
host's share, and the host's towards that of all, with the weight of ``WEIGHT`` labels. Given rules for hosts
and path prefixes come before the templates.

Counting is by grouped sums, so a host that holds a third of all rows is never one task; only the at most
``1 / SHARE`` named children of a node and its wildcards meet in one group.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged like others; an
empty path is a template of its own; segments after the ``DEPTH``-th are one segment with their slashes;
repeated rows are judged alike, and equal paths of a host count once; null ids stay; without labels nothing
is rejected; an empty table gives none; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import cut_lineage, pick

SHARE, LEAST, DEPTH = 1 / 64, 4, 6
Z, WEIGHT, REJECT = 1.0, 8.0, 0.5
#: (verdict, host, path): the rule fits the host and its subdomains, and paths that start with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The rule that fits (the longest one) and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(prefix))
        name, verdict = F.when(fits, F.lit(own + prefix)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def segments(path: Column, depth: int = DEPTH) -> Column:
    parts = F.split(path, "/", -1)
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    deep = F.concat(F.slice(inner, 1, depth - 1), F.array(F.array_join(F.slice(inner, depth, F.greatest(F.size(inner), F.lit(1))), "/")))
    return F.when(F.startswith(path, F.lit("/")), F.when(F.size(inner) > depth, deep).otherwise(inner)).otherwise(F.array().cast("array<string>"))


def wildcard(segment: Column) -> Column:
    return F.when(segment == "", segment).otherwise(F.concat(F.lit("*"), F.regexp_extract(segment, r"\.[A-Za-z]{1,5}$", 0)))


def generalise(paths: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``paths`` (host, path, segs, ...) with ``names``, the template of each."""
    paths = cut_lineage(paths.withColumn("names", F.array().cast("array<string>")))
    for level in range(paths.agg(F.max(F.size("segs"))).first()[0] or 0):
        segment = F.get("segs", F.lit(level))
        kids = paths.filter(segment.isNotNull()).groupBy("host", "names", segment.alias("seg")).agg(F.count("*").alias("k"))
        kids = cut_lineage(kids)
        totals = kids.groupBy("host", "names").agg(F.sum("k").alias("total"))
        named = kids.filter(F.col("k") >= least).join(totals, ["host", "names"]).filter(F.col("k") >= F.col("total") * share)
        named = cut_lineage(named.select("host", "names", "seg", F.lit(True).alias("known")))
        paths = paths.withColumn("seg", segment).join(named, ["host", "names", "seg"], "left")
        name = F.when(F.col("known"), F.col("seg")).otherwise(wildcard(F.col("seg")))
        names = F.when(F.col("seg").isNull(), F.col("names")).otherwise(F.concat("names", F.array(name)))
        paths = cut_lineage(paths.withColumn("names", names).drop("seg", "known"))
    return paths


def similar(good: list[float], bad: list[float], z: float = Z) -> list[int]:
    """A group number for each branch: in order of its bad share, it joins the group before if the shares
    differ by less than ``z`` standard errors. Branches without labels cannot be told from any."""
    order = sorted(range(len(good)), key=lambda i: (bad[i] / (good[i] + bad[i]) if good[i] + bad[i] else -1.0, i))
    out, group, g, b = [0] * len(good), -1, 0.0, 0.0
    for i in order:
        n, m = g + b, good[i] + bad[i]
        pooled = (b + bad[i]) / (n + m) if n + m else 0.0
        spread = (pooled * (1 - pooled) * (1 / n + 1 / m)) ** 0.5 if n and m else 0.0
        apart = n and m and abs(b / n - bad[i] / m) >= z * spread and b * m != bad[i] * n
        if group < 0 or apart:
            group, g, b = group + 1, 0.0, 0.0
        g, b, out[i] = g + good[i], b + bad[i], group
    return out


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    rows, new = rows.sort_values("branch"), {}
    for _, same in rows.groupby(["below", "deep"], sort=True):
        labels = similar(same["good"].tolist(), same["bad"].tolist())
        for g in set(labels):
            together = [x for x, y in zip(same["branch"], labels, strict=True) if y == g]
            new |= dict.fromkeys(together, together[0] if len(together) == 1 else "{" + ",".join(together) + "}")
    return rows.assign(merged=[new[x] for x in rows["branch"]])[["host", "above", "branch", "merged"]]


def merge(templates: DataFrame) -> DataFrame:
    """``templates`` (host, names, good, bad) with ``merged``, their names after joining similar branches."""
    out = cut_lineage(templates.withColumn("merged", F.col("names")))
    for level in range(out.agg(F.max(F.size("names"))).first()[0] or 0, 0, -1):
        have = out.filter(F.size("merged") >= level)
        above, branch = F.slice("merged", 1, level - 1).alias("above"), F.get("merged", F.lit(level - 1)).alias("branch")
        below = F.slice("merged", level + 1, F.greatest(F.size("merged"), F.lit(1)))
        parts = have.select("host", above, branch, below.alias("rest"), "good", "bad").groupBy("host", "above", "branch", "rest").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        stats = parts.groupBy("host", "above", "branch").agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.bit_xor(F.xxhash64("rest")).alias("below"), F.count("*").alias("deep"))
        renamed = stats.groupBy("host", "above").applyInPandas(_merge, "host string, above array<string>, branch string, merged string").filter("branch <> merged")
        renamed = cut_lineage(renamed.withColumnRenamed("merged", "name"))
        out = out.withColumn("above", above).withColumn("branch", branch).join(renamed, ["host", "above", "branch"], "left")
        after = F.concat("above", F.array("name"), below)
        out = cut_lineage(out.withColumn("merged", F.when(F.col("name").isNull(), F.col("merged")).otherwise(after)).drop("above", "branch", "name"))
    return out


def purity(templates: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """(host, names, merged, purity): the smoothed share of bad labels of each merged template."""
    everything = templates.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    base = everything.b / (everything.g + everything.b) if everything.g + everything.b else 0.0
    hosts = templates.groupBy("host").agg(((F.sum("bad") + weight * base) / (F.sum("good") + F.sum("bad") + weight)).alias("prior"))
    own = templates.groupBy("host", "merged").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).join(hosts, "host")
    own = own.select("host", "merged", ((F.col("b") + weight * F.col("prior")) / (F.col("g") + F.col("b") + weight)).alias("purity"))
    return templates.select("host", "names", "merged").join(own, ["host", "merged"])


def judge(pages: DataFrame, labels: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, reject: float = REJECT) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page.

    ``labels`` holds (number, bad): the label of the document whose number is the last one in a path.
    """
    host, path = split_url(F.col("url"))
    read = pick(pages, page_id=page_id, url=F.col(url).cast("string")).select("page_id", host.alias("host"), path.alias("path"))
    number = F.expr(r"try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) AS bigint)")
    paths = cut_lineage(read.select("host", "path").distinct().withColumn("number", number).withColumn("segs", segments(F.col("path"))))
    marks = labels.filter("number IS NOT NULL AND bad IS NOT NULL").groupBy("number").agg(F.max("bad").alias("bad"))
    marked = paths.filter("number IS NOT NULL").join(marks, "number").select("host", "path", F.col("bad").cast("int").alias("bad"))
    paths = generalise(paths.select("host", "path", "segs"))
    counted = paths.join(marked, ["host", "path"], "left").groupBy("host", "names").agg(
        F.coalesce(F.sum(1 - F.col("bad")), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = cut_lineage(purity(merge(counted)))
    judged = paths.select("host", "path", "names").join(known, ["host", "names"])
    judged = cut_lineage(judged.select("host", "path", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity"))
    out = read.join(judged, ["host", "path"], "left")
    rule, fixed = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(fixed, own).alias("verdict"), "template", "purity")
