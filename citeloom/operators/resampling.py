"""Paired bootstrap intervals and sign-flip tests as relational jobs.

Draws come from md5 of (resample, position, seed), so every task and every engine makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT_LIMIT = 12


def _position(df: DataFrame, key: str) -> DataFrame:
    """Dense 0-based position in md5 order, numbered bucket by bucket instead of in one task."""
    h = F.md5(F.col(key).cast("string").cast("binary"))
    keyed = df.withColumn("h", h).withColumn("bucket", F.substring(h, 1, 3))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("c"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("h", key)
    return keyed.join(offsets, "bucket").withColumn("i", F.col("base") + F.row_number().over(inside) - 1).drop("h", "bucket", "base")


def _hex(text: Column, width: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, width), 16, 10).cast("long")


def unpaired(scores: DataFrame) -> DataFrame:
    """Samples that some system or metric lacks; the test needs every pair."""
    total = scores.select("system_name", "metric").distinct().agg(F.count("*").alias("n")).scalar()
    return scores.groupBy("sample_id").agg(F.count("*").alias("n")).filter(F.col("n") != total).select(
        F.col("sample_id").cast("string").alias("entity_id"), F.lit("unpaired_sample").alias("rule")
    )


def paired_tests(scores: DataFrame, baseline: str, *, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Every other system against ``baseline`` on every metric.

    ``scores``: ``sample_id, system_name, metric, score``. All comparisons ride on one row per sample
    (their number is systems x metrics), so each draw is made and joined once. With at most twelve
    samples every sign pattern is tried, otherwise ``resamples`` random ones with the +1 correction.
    """
    if resamples < 1:
        raise ValueError("resamples must be positive")
    base = scores.filter(F.col("system_name") == baseline).select("sample_id", "metric", F.col("score").alias("base"))
    pairs = scores.filter(F.col("system_name") != baseline).join(base, ["sample_id", "metric"]).select(
        "sample_id", F.struct("system_name", "metric").alias("key"), "score", "base"
    )
    wide = pairs.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("key", (F.col("score") - F.col("base")).alias("d")))).alias("cells"))
    wide = _position(wide.select("sample_id", "cells"), "sample_id").select("i", "cells")
    n = wide.agg(F.count("*").alias("n")).scalar()
    observed = pairs.groupBy("key").agg(
        F.avg("base").alias("baseline_mean"), F.avg("score").alias("system_mean"), F.avg(F.col("score") - F.col("base")).alias("difference"), F.count("*").alias("n")
    )
    each = wide.withColumn("n", n)
    # Bootstrap: position i of resample r takes the sample at md5(r:i:seed) mod n.
    slots = each.select("i", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    draws = slots.select("r", (_hex(F.concat_ws(":", "r", "i", F.lit(seed)), 8) % F.col("n")).alias("i"))
    counts = draws.groupBy("r", "i").agg(F.count("*").alias("w"))
    means = (
        counts.join(wide, "i").select("r", "w", F.explode("cells").alias("c")).groupBy("r", F.col("c.key").alias("key"))
        .agg((F.sum(F.col("c.d") * F.col("w")) / F.sum("w")).alias("m"))
    )
    bands = means.groupBy("key").agg(F.percentile("m", F.lit(0.025)).alias("ci_lower"), F.percentile("m", F.lit(0.975)).alias("ci_upper"))
    # Sign flips: bit i of the pattern number when all are tried, else a hash bit.
    exact = F.col("n") <= EXACT_LIMIT
    last = F.when(exact, (F.pow(F.lit(2.0), F.least(F.col("n"), F.lit(EXACT_LIMIT))) - 1).cast("int")).otherwise(F.lit(resamples - 1))
    bit = F.when(exact, F.floor(F.col("p") / F.pow(F.lit(2.0), F.least(F.col("i"), F.lit(EXACT_LIMIT)))).cast("long") % 2).otherwise(
        _hex(F.concat_ws(":", F.lit("s"), "p", "i", F.lit(seed)), 1) % 2
    )
    flips = each.select("i", "n", "cells", F.explode(F.sequence(F.lit(0), last)).alias("p")).select("p", "n", "cells", (1 - 2 * bit).alias("sign"))
    null_means = flips.select("p", "n", "sign", F.explode("cells").alias("c")).groupBy("p", "n", F.col("c.key").alias("key")).agg(
        F.avg(F.col("c.d") * F.col("sign")).alias("m")
    )
    tail = null_means.join(observed.select("key", "difference"), "key").groupBy("key").agg(
        F.count("*").alias("tried"), F.count(F.when(F.abs("m") >= F.abs("difference") - 1e-12, 1)).alias("extreme")
    )
    out = observed.join(bands, "key").join(tail, "key")
    p = F.when(F.col("n") <= EXACT_LIMIT, F.col("extreme") / F.col("tried")).otherwise((F.col("extreme") + 1) / (F.col("tried") + 1))
    out = out.withColumn("p_value", p)
    return out.select(
        "key.system_name", "key.metric", "n", "baseline_mean", "system_mean", "difference", "ci_lower", "ci_upper", "p_value",
        ((F.col("p_value") < 0.05) & ((F.col("ci_lower") > 0) | (F.col("ci_upper") < 0))).alias("significant"),
    )
