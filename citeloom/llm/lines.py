"""Line deduplication over overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a text form a window (a text of fewer lines is one window). Windows are
compared over all documents by two 64-bit hashes; of equal windows the first one stays, in the order of
document id (null last), text hash and line, and the lines under any later one are removed: overlapping
windows merge, as covered positions are a set.

Counting is an aggregation with partial sums in every map task, so a window that a third of all rows hold
sends one row per task; the join back has one row per repeated window on one side and can be split on the
other. Texts travel once, to meet their removed positions.

Defined cases: a null text stays null and has no lines; an empty text is one empty line; rows repeated with
the same id and text are one document (all keep the same lines); a document all of whose lines are removed
stays with an empty text; an empty table gives none; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import let

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """(id, mark, at, a, b): one row per window, named by the hashes ``a`` and ``b``."""
    hashed = docs.select("id", "mark", F.transform(_lines(F.col("body")), lambda x: F.xxhash64(x)).alias("x"),
                         F.transform(_lines(F.col("body")), lambda x: F.xxhash64(F.lit(1), x)).alias("y"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("x") - width, F.lit(0)))

    def key(side: str, i: Column) -> Column:
        return F.xxhash64(F.least(F.size("x"), F.lit(width)), *(F.get(F.col(side), i + o) for o in range(width)))

    return hashed.select("id", "mark", F.inline(F.transform(starts, lambda i: F.struct(i.alias("at"), key("x", i).alias("a"), key("y", i).alias("b")))))


def removals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, mark, starts): where later windows begin, for the documents that have any."""
    place = F.struct(F.col("id").isNull().alias("last"), "id", "mark", "at").alias("place")
    every = _windows(docs, width).select("id", "mark", "at", "a", "b", place)
    first = every.groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("final")).filter("first < final")
    later = every.join(first.select("a", "b", "first"), ["a", "b"]).filter("place > first")
    return later.groupBy("id", "mark").agg(F.collect_set("at").alias("starts"))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and the counts ``n_lines`` and ``n_removed``."""
    held = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("held"))
    named = held.select("held", F.col("held")[doc_id].alias("id"), F.xxhash64(F.col("held")[text]).alias("mark"), F.col("held")[text].alias("body"))
    found = removals(named.filter("body IS NOT NULL").select("id", "mark", "body"), width).withColumnsRenamed({"id": "rid", "mark": "rmark"})
    both = named.join(found, F.col("id").eqNullSafe(F.col("rid")) & (F.col("mark") == F.col("rmark")), "left")
    def shorter(lines: Column) -> Column:
        covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, F.least(s + width - 1, F.size(lines) - 1))))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        # ``let`` and the argument of ``transform`` are computed once a row, what a lambda names once a line
        return let(left, lambda kept: F.struct(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(kept)).cast("long").alias("removed")))

    cut = both.withColumn("short", F.when(F.col("starts").isNotNull(), let(_lines(F.col("body")), shorter)))
    count = F.when(F.col("body").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("body")))).cast("long")
    kept = F.when(F.col("starts").isNotNull(), F.col("short.text")).otherwise(F.col("body"))
    out = [kept.alias(c) if c == text else F.col("held")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut.select(*out, count.alias("n_lines"), F.coalesce("short.removed", F.lit(0).cast("long")).alias("n_removed"))


SQL = """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, len(l) AS n, i, array_to_string(l[i+1:i+3], chr(10)) AS k, least(len(l), 3) AS m
      FROM d, unnest(range(0, greatest(len(l) - 2, 1))) AS t(i)),
later AS (SELECT doc_id, n, i FROM (SELECT *, row_number() OVER (PARTITION BY m, k ORDER BY doc_id NULLS LAST, i) AS r FROM w) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, i + o AS p FROM later, unnest([0, 1, 2]) AS u(o) WHERE i + o < n),
line AS (SELECT doc_id, p, l[p+1] AS x FROM d, unnest(range(0, len(l))) AS t(p)),
kept AS (SELECT a.doc_id, string_agg(a.x, chr(10) ORDER BY a.p) AS text, count(*) AS c FROM line a
         ANTI JOIN covered c ON a.doc_id = c.doc_id AND a.p = c.p GROUP BY a.doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN s.text IS NULL THEN 0 ELSE len(string_split(s.text, chr(10))) END AS n_lines,
       CASE WHEN s.text IS NULL THEN 0 ELSE len(string_split(s.text, chr(10))) - coalesce(k.c, 0) END AS n_removed
FROM documents s LEFT JOIN kept k ON s.doc_id = k.doc_id"""
