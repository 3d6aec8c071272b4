"""Target-distribution importance resampling over hashed word n-grams, hashed by prefix CRCs.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of any code points beyond ASCII; features
are all runs of 1 to ``ORDER`` words joined by one space, repeats counted. A block of texts is brought into
that form (words with one separator) and scanned once for running CRCs; the CRC-32 of each feature follows
from the two at its ends (``prefix_crc``), and its bucket is that modulo ``BUCKETS``.

Every task adds up its own bucket counts, so ``BUCKETS`` rows a task are shuffled, for documents and target.
A bucket's gain is the floored log ratio of its smoothed target and source shares; a document's weight is
the floored mean gain of its features. The gains (one long per bucket, whatever the input) are broadcast,
and a second scan weighs the documents. Gumbel noise seeded by the id is added, and the documents of the
largest sums are drawn, which samples without replacement in proportion to the weights' exponentials.
Scores are whole numbers from a range of some ten thousands, so ranks come from a table of counts by score
and an order by id within each score; no task orders the whole table.

Defined cases: null and empty texts have no features and weight 0; a null id draws the noise of an empty id
and comes first among ties; repeated rows are documents of their own; with an empty target or table all
counts are 0 and only smoothing is left; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm import prefix_crc
from citeloom.llm.common import blocks, cut_lineage, pick, text_bytes

ORDER, BUCKETS, SEED, LEAST_WORDS, PERCENT = 2, 10000, 7, 20, 25
#: Bytes of text scanned at once.
STEP_BYTES = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
SPACE = np.uint8(32)


def features(raw: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text, words): one entry per feature with the number of its text, and words per text."""
    texts = len(offsets) - 1
    raw = LOWER[raw]
    inside = WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:] = inside[:-1] & ~edge[1:-1]
    after[:-1] = inside[1:] & ~edge[1:-1]
    first, last = np.nonzero(inside & ~before)[0], np.nonzero(inside & ~after)[0]
    kept = inside | before  # a word's bytes and the sign behind it, unless the text ends there
    form = np.where(inside, raw, SPACE)[kept]
    place = np.cumsum(kept) - 1
    start, stop = place[first], place[last] + 1
    bounds = np.searchsorted(first, offsets)
    words = np.diff(bounds)
    text = np.repeat(np.arange(texts), words)
    prefix = prefix_crc.running(form)
    found, of = [], []
    for n in range(1, order + 1):
        if len(start) < n:
            break
        same = text[: len(text) - n + 1] == text[n - 1 :]
        found.append(prefix_crc.crc_of_runs(prefix, start[: len(start) - n + 1][same], stop[n - 1 :][same]) % np.uint32(buckets))
        of.append(text[: len(text) - n + 1][same])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words
    return np.concatenate(found).astype(np.int64), np.concatenate(of), words


def bucket_counts(docs: DataFrame, *, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of the whole table in each bucket that has any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in blocks(batches, "text", STEP_BYTES):
            total += np.bincount(features(*text_bytes(batch, "text"), order, buckets)[0], minlength=buckets)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return pick(docs, text=text).mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from the counts of both tables."""
    spark = source.sparkSession
    sides = source.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    every = sides.unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t")))
    each = every.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = Window.partitionBy()  # one row per bucket
    total = each.select("bucket", *(F.col(c).cast("double").alias(c) for c in "st"), *(F.sum(c).over(whole).cast("double").alias(n) for c, n in (("s", "all_s"), ("t", "all_t"))))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return total.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, seeded by the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, gain: np.ndarray, *, order: int = ORDER) -> DataFrame:
    """``docs`` (columns doc_id, text, any others but the new ones) with n_words, n_features and weight, less the text."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one long per bucket
    kept = docs.drop("text", "n_words", "n_features", "weight").columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in blocks(batches, "text", STEP_BYTES):
            bucket, text, words = features(*text_bytes(batch, "text"), order, len(own))
            n = np.bincount(text, minlength=batch.num_rows)
            at = np.argsort(text, kind="stable")
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(own[bucket[at]])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(words), pa.array(n), pa.array(weight)], names=[*kept, "n_words", "n_features", "weight"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*kept, "text").mapInArrow(work, f"{fields}, n_words long, n_features long, weight long")


def importance(
    docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, mark, n_words, n_features, weight, score, rank) of every document; ``rank`` only of those drawn.

    ``percent`` of the documents with at least ``least`` words are drawn. ``mark`` is a hash of the text.
    """
    sizes = {"order": order, "buckets": buckets}
    table = gains(bucket_counts(docs, text=text, **sizes), bucket_counts(target, text=target_text, **sizes), buckets=buckets)
    gain = np.zeros(buckets, np.int64)
    for row in table.collect():  # ``buckets`` rows
        gain[row.bucket] = row.gain
    named = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    scored = weigh(named, gain, order=order)
    scored = cut_lineage(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least
    levels = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))  # whole numbers of a small range
    down = Window.orderBy(F.col("score").desc())
    above = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.floor(F.sum("n").over(Window.partitionBy()) * percent / F.lit(100)).cast("long")
    levels = levels.select("score", above.alias("above"), quota.alias("quota")).filter("above < quota")
    both = scored.join(levels, "score", "left")
    within = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight", "mark")
    drawn = both.filter(able & F.col("above").isNotNull()).withColumn("rank", F.col("above") + F.row_number().over(within))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("quota"), F.col("rank")).cast("long"))
    rest = both.filter(~able | F.col("above").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "mark", "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents drawn, with all their columns; rows of equal id and text are drawn together."""
    drawn = importance(docs, target, doc_id=doc_id, text=text, **options).filter("rank IS NOT NULL")
    keys = drawn.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    return docs.join(keys, docs[doc_id].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__mark")), "left_semi")


#: The same rows in SQL. The CRC of each distinct feature goes through its hexadecimal digits, four bits at a time.
SQL = r"""WITH nibble AS MATERIALIZED (SELECT list(list_reduce([1, 2, 3, 4], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) ORDER BY v) AS t
    FROM range(16) AS r(v)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w,
    row_number() OVER () AS k FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
f AS (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))) AS x FROM d),
g AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))) AS x FROM b),
names AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION SELECT x FROM g)),
crc AS (SELECT x, xor(list_reduce(list_transform(range(1, len(h) + 1), lambda i: instr('0123456789ABCDEF', h[i + 2 * (i % 2) - 1]) - 1),
    lambda c, v: xor(c >> 4, t[1 + (xor(c, v) & 15)]), 4294967295), 4294967295) % 10000 AS bucket FROM names, nibble),
ds AS (SELECT bucket, count(*) AS s FROM f JOIN crc USING (x) GROUP BY bucket),
bt AS (SELECT bucket, count(*) AS t FROM g JOIN crc USING (x) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM ds)::DOUBLE + 10000))
    / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM bt)::DOUBLE + 10000))))::BIGINT AS gain
    FROM ds FULL JOIN bt USING (bucket)),
w AS (SELECT k, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN crc USING (x) JOIN gain USING (bucket) GROUP BY k),
s AS (SELECT doc_id, len(d.w) AS n, 2 * len(d.w) - CASE WHEN len(d.w) > 0 THEN 1 ELSE 0 END AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM d LEFT JOIN w USING (k)),
r AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id, n_features, weight) AS place FROM s)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
    CASE WHEN n >= 20 AND place <= (SELECT 25 * count(*) // 100 FROM s WHERE n >= 20) THEN place END AS rank FROM r"""
