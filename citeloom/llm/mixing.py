"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken ``target / size of the source`` times. The whole part is certain;
the fractions are rounded together: two open documents are paired and mass, measured in words, moves from
one to the other at random until one of them is taken or left for good. Expected copies stay exact, and
what a source takes differs from its target by less than one document.

Documents are dealt by hash into groups of about ``GROUP`` of one source, so a source of any size is many
groups. A group leaves one open document; those meet in the next level of the tree, until one is left for
each source. Draws are seeded by group and ordered by the hash of the id, so reruns agree however rows are
split. One row per source passes through one task (for the targets); sources are counted in thousands.

Defined cases: a null or blank text has size 0, is taken the whole part of its copies, and moves no mass; a
null source is a source, ordered last; repeated rows are documents of their own; an empty table gives
none; other columns stay (``columns`` names those to keep).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import cut_lineage, with_field

WEIGHTS, MOST, GROUP, SEED = (1, 2, 3), 3, 4096, 17
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, documents, target): shares of all words by weight, no target over ``most`` sizes.

    Sources fill up in order of their limit per weight; the first that stays below its limit fixes the
    level of all that follow.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(names) - 1) % len(weights)
    cap = (F.col("source_size") * most).alias("cap")
    t = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double")).select("*", cap)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level).withColumn("order", F.row_number().over(filling))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("order", "level"))).over(everything)
    t = t.withColumn("level", first["level"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return t.select("source", "source_size", "documents", target.alias("target"))


def pair_off(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractions of one group in order; returns the fractions and the index still open (or -1)."""
    p, open_at = p.astype(float).tolist(), -1
    size, draws = size.tolist(), draws.tolist()
    for i in range(len(p)):
        if p[i] <= 0.0 or p[i] >= 1.0:
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = open_at, i
        up, down = min((1 - p[a]) * size[a], p[b] * size[b]), min(p[a] * size[a], (1 - p[b]) * size[b])
        if draws[i] * (up + down) < down:
            step_a, step_b, full_a, full_b = up / size[a], -up / size[b], 1.0, 0.0
            ends_a, ends_b = (1 - p[a]) * size[a] <= up, p[b] * size[b] <= up
        else:
            step_a, step_b, full_a, full_b = -down / size[a], down / size[b], 0.0, 1.0
            ends_a, ends_b = p[a] * size[a] <= down, (1 - p[b]) * size[b] <= down
        p[a] = full_a if ends_a else p[a] + step_a
        p[b] = full_b if ends_b else p[b] + step_b
        open_at = -1 if ends_a and ends_b else a if ends_b else b
    return np.array(p), open_at


def rounder(seed: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rounds one group; the one document left open is drawn in the ``last`` level."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tie", "row"], kind="stable")
        rng = np.random.default_rng([seed, level, int(rows["tie"].iloc[0]) & 0xFFFFFFFF, len(rows)])
        p, left = pair_off(rows["p"].to_numpy(), rows["size"].to_numpy(np.float64), rng.random(len(rows)))
        if last and left >= 0:
            p[left], left = float(rng.random() < p[left]), -1
        return rows.assign(p=p, open=np.arange(len(rows)) == left)

    return work


def copies(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """(row, size, source, source_size, target, copies) for ``sized``: (row, tie, source, size).

    ``row`` names a row, ``tie`` orders rows independently of how they are stored. ``sized`` is read several
    times and should be a written table.
    """
    goal = cut_lineage(targets(sized, weights, most))
    most_groups = goal.agg(F.max(F.ceil(F.col("documents") / group))).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = sized.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "source_size", "documents", "target", ratio.alias("ratio"))
    whole = F.floor("ratio")
    rows = known.withColumn("base", whole).withColumn("p", F.when(F.col("size") > 0, F.col("ratio") - whole).otherwise(F.lit(0.0)))
    out = ["row", "source", "size", "source_size", "target", (F.col("base") + F.round("p").cast("long")).alias("copies")]
    done = rows.filter("p <= 0").select(*out)
    left = rows.filter("p > 0").withColumn("part", F.pmod(F.xxhash64("tie", F.lit(seed)), F.ceil(F.col("documents") / group))).drop("documents", "ratio")
    level, width = 0, most_groups
    while width > 0:
        last = width <= 1
        step = left.groupBy("source", "part").applyInPandas(rounder(seed, level, last), with_field(left.schema, "open", "boolean"))
        step = cut_lineage(step)
        done = done.unionByName(step.filter("NOT open").select(*out))
        left = step.filter("open").drop("open").withColumn("part", F.floor(F.col("part") / group))
        width, level = 0 if last else -(-width // group), level + 1
    return done


def name_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row`` and ``tie``. Names hold only for a table written with them."""
    tie = F.xxhash64(F.col("doc_id").cast("string"), "size", F.coalesce(F.col("source"), F.lit("")))
    return docs.withColumn("row", F.monotonically_increasing_id()).withColumn("tie", tie)


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) of every document."""
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), words(docs[text]).alias("size"))
    named = cut_lineage(name_rows(narrow))
    done = copies(named.drop("doc_id"), **how)
    return named.select("row", "doc_id").join(done, "row").drop("row")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with all its columns."""
    columns = [f"`{c}`" for c in docs.columns]
    held = F.struct(*columns).alias("held")
    narrow = docs.select(held, docs["doc_id"], docs["source"].cast("string").alias("source"), words(docs["text"]).alias("size"))
    named = cut_lineage(name_rows(narrow))
    taken = copies(named.select("row", "tie", "source", "size"), **how).filter("copies > 0").select("row", "copies")
    return named.select("row", "held").join(taken, "row").select("held", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("held.*")
