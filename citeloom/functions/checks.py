"""Constraint checks: every rule is a predicate, violations are rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """Raised in strict mode when a rule is broken."""


def violations(df: DataFrame, entity: Column, rules: Mapping[str, Column]) -> DataFrame:
    """Rows ``(entity_id, rule)`` for every rule whose predicate says "broken".

    One pass over the table whatever the number of rules: broken rules are gathered into a small
    array per row and exploded. A NULL predicate counts as not broken. The outer explode keeps Spark
    from inferring a filter on the array, which would evaluate every rule twice.
    """
    hits = F.filter(
        F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]),
        lambda r: r.isNotNull(),
    )
    rows = df.select(entity.cast("string").alias("entity_id"), F.explode_outer(hits).alias("rule"))
    return rows.filter("rule is not null")


def duplicates(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that occur more than once."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
        .select(
            F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("entity_id"),
            F.lit(rule).alias("rule"),
            "copies",
        )
    )


def unresolved(refs: DataFrame, target: DataFrame, key: str, rule: str) -> DataFrame:
    """References without a target row."""
    return (
        refs.select(key).distinct()
        .join(target.select(key).distinct(), key, "left_anti")
        .select(F.col(key).cast("string").alias("entity_id"), F.lit(rule).alias("rule"))
    )


def require_none(found: DataFrame, what: str) -> None:
    """Strict mode: fail with a few examples when any violation exists."""
    sample = found.limit(5).collect()
    if sample:
        raise ConstraintError(f"{what}: {[r.asDict() for r in sample]}")
