"""Exact, linearly interpolated quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARGIN = 0.002
_SMALL = 20_000


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """One row per group with a column for every named probability.

    The built-in exact percentile keeps every distinct value of a group in one aggregation buffer,
    which a group holding a third of all rows would overflow. Here a bounded sketch first brackets
    each quantile; values below the bracket are only counted, and only the distinct values inside it
    are put in order. Groups below 20 000 rows use their minimum and maximum as the bracket. The
    sketch only narrows the search, so the answer is exact.
    """
    keys = list(keys)
    names = list(probs)
    cuts = sorted({c for p in probs.values() for c in (max(0.0, p - _MARGIN), min(1.0, p + _MARGIN))})
    spot = {c: i for i, c in enumerate(cuts)}
    clean = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null")
    sketch = F.percentile_approx("v", F.array(*[F.lit(c) for c in cuts]), F.lit(10_000))
    bounds = clean.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), sketch.alias("s")
    )

    def side(p: float, low: bool) -> Column:
        cut = max(0.0, p - _MARGIN) if low else min(1.0, p + _MARGIN)
        edge = F.col("lo") if low else F.col("hi")
        return F.when((F.col("n") < _SMALL) | F.lit(cut in (0.0, 1.0)), edge).otherwise(
            F.col("s")[spot[cut]]
        )

    brackets = bounds.select(
        *keys, "n",
        F.array(*[
            F.struct(
                F.lit(name).alias("q"),
                side(p, True).alias("a"),
                side(p, False).alias("b"),
                (F.lit(p) * (F.col("n") - 1)).alias("rank"),
            )
            for name, p in probs.items()
        ]).alias("qs"),
    )
    # Distinct values are counted once before anything is joined, so ties never travel twice.
    counted = clean.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    cond = [counted[k].eqNullSafe(brackets[k]) for k in keys]
    joined = (
        counted.join(brackets, cond) if keys else counted.withColumn("qs", brackets.select("qs").scalar())
    )
    each = joined.select(*[counted[k] for k in keys], "v", "c", F.explode("qs").alias("x")).select(
        *keys, "c", "v", "x.*"
    )
    squeezed = (
        each.filter("v <= b")
        .groupBy(*keys, "q", "rank", F.when(F.col("v") >= F.col("a"), F.col("v")).alias("v"))
        .agg(F.sum("c").alias("c"))
    )
    order = Window.partitionBy(*keys, "q").orderBy(F.col("v").asc_nulls_first())
    placed = squeezed.withColumn("upto", F.sum("c").over(order)).withColumn("before", F.col("upto") - F.col("c"))
    lower, upper = F.floor("rank"), F.ceil("rank")
    per_q = placed.groupBy(*keys, "q").agg(
        F.max(F.when((lower >= F.col("before")) & (lower < F.col("upto")), F.col("v"))).alias("vl"),
        F.max(F.when((upper >= F.col("before")) & (upper < F.col("upto")), F.col("v"))).alias("vu"),
        F.first("rank").alias("rank"),
    )
    point = F.col("vl") + (F.col("vu") - F.col("vl")) * (F.col("rank") - F.floor("rank"))
    return per_q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == n, point)).alias(n) for n in names]
    )
