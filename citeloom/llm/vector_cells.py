"""Vectors cut into shards of bounded size, and a query set met with every shard in blocks.

Equal vectors are one representative with the smallest of their ids (as many as a result can hold), so a
vector that a third of all rows share is one object. Representatives are dealt to shards by a hash of their
first id, whatever their values are; an index is built for each shard and written as a table. Queries are
dealt into blocks; one task handles a cell of one shard and one block, and only the best of each cell are
shuffled on.

Rows with a null id, a null or empty vector, or a null or non-finite component take no part. Vectors are
compared with vectors of equal length only. Rows repeated with the same id and vector count once; an id
never is a result of its own query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import cut_lineage

#: Vectors of one index, and queries of one block.
SHARD, BLOCK = 4096, 2048


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part; ``v`` holds doubles."""
    rows = vectors.select(vectors[vec_id].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter((F.size("v") > 0) & finite)


def representatives(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): distinct vectors with their ``keep`` smallest ids."""
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("place", place).filter(F.col("place") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def sharded(rows: DataFrame, keep: int, shard: int = SHARD) -> tuple[DataFrame, int]:
    """Representatives with ``dim`` and ``shard``, as a written table, and the number of shards."""
    reps = cut_lineage(representatives(rows, keep))
    shards = max(1, -(-reps.count() // shard))
    return reps.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(shards)).cast("int")), shards


def search_cells(
    index: DataFrame, queries: DataFrame, shards: int, search: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame],
    *, top: int, score: str, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` of every query over all shards.

    ``index`` holds ``dim`` and ``shard`` and whatever ``search`` reads; ``search`` gets a shard's rows, the
    ids and the vectors of a block, and returns (query_id, vec_id, score).
    """
    queries = cut_lineage(queries.distinct())
    width = max(1, -(-queries.count() // block))
    right = queries.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(width)).cast("int").alias("part")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))

    def cell(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search(own, asked["id"].to_numpy(np.int64), np.stack(asked["v"].to_numpy()).astype(np.float64))

    keys = ("dim", "shard", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def best_rows(query: int, reps: np.ndarray, scores: np.ndarray, ids: list[np.ndarray], top: int) -> list[tuple[int, int, float]]:
    """The ``top`` (query, id, score) of scored representatives, without the query's own id."""
    rows = [(s, i) for r, s in zip(reps, scores, strict=True) for i in ids[r] if i != query]
    rows.sort(key=lambda x: (-x[0], x[1]))
    return [(query, i, s) for s, i in rows[:top]]


def divisible(rows: DataFrame, by: int) -> DataFrame:
    return rows.filter(F.col("id") % by == 0)


def quantised(v: Column, times: int = 64) -> Column:
    return F.transform(v, lambda x: F.floor(x * times).cast("double"))
