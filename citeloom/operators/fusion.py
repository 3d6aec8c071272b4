"""Rank fusion, reranking, lookups and projection of results to evidence candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import text as tx
from citeloom.functions.identity import content_hash

RRF_K = 60


def first_per_route(results: DataFrame) -> DataFrame:
    """Keep the first occurrence of a chunk within one route's result list."""
    return results.groupBy("query_id", "method", "chunk_id").agg(
        F.min(F.struct("rank", "score")).alias("m")
    ).select("query_id", "method", "chunk_id", F.col("m.rank").alias("rank"), F.col("m.score").alias("score"))


def reciprocal_rank_fusion(sparse: DataFrame, dense: DataFrame, k_results: int, *, k: int = RRF_K) -> DataFrame:
    """Sum of ``1/(k+rank)`` over both routes; ties by best component rank, then chunk id.

    One aggregation on (query, chunk) instead of a full outer join: both legs are already cut to
    their top k, so this shuffles a few rows per query.
    """
    if k_results < 1 or k < 1:
        raise ValueError("limits must be positive")
    legs = first_per_route(
        sparse.select("query_id", "chunk_id", "rank", "score", F.lit("sparse").alias("method")).unionByName(
            dense.select("query_id", "chunk_id", "rank", "score", F.lit("dense").alias("method"))
        )
    )
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{c}")
    merged = legs.groupBy("query_id", "chunk_id").agg(
        pick("sparse", "rank"), pick("dense", "rank"), pick("sparse", "score"), pick("dense", "score")
    )
    part = lambda m: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(f"{m}_rank")), F.lit(0.0))
    scored = merged.withColumn("score", part("sparse") + part("dense"))
    order = Window.partitionBy("query_id").orderBy(
        F.desc(F.round("score", 12)), F.least("sparse_rank", "dense_rank"), "chunk_id"
    )
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k_results)
        .select("query_id", "chunk_id", "rank", "score", "sparse_rank", "dense_rank", "sparse_score", "dense_score")
    )


# ---------------------------------------------------------------- reranking

ScoreFunction = Callable[[list[str], list[str]], list[float]]


def score_pairs(pairs: DataFrame, score: Callable[[], ScoreFunction], *, max_rank: int = 20) -> DataFrame:
    """Score (query, text) pairs with a user model; only the first ``max_rank`` candidates reach it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = score()
        for frame in frames:
            yield frame[["query_id", "chunk_id"]].assign(
                rerank_score=[float(x) for x in model(frame["query"].tolist(), frame["text"].tolist())]
            )

    keys = pairs.select("query_id", "chunk_id").schema.fields
    return (
        pairs.filter(F.col("rank") <= max_rank)
        .select("query_id", "chunk_id", "query", "text")
        .mapInPandas(run, T.StructType([*keys, T.StructField("rerank_score", T.DoubleType())]))
    )


def overlap_scores(pairs: DataFrame, *, max_rank: int = 20, normalise: bool = True) -> DataFrame:
    """Offline default scorer: share of distinct query tokens that occur in the text."""
    q = F.array_distinct(tx.tokens(F.col("query"), normalise=normalise))
    t = F.array_distinct(tx.tokens(F.col("text"), normalise=normalise))
    both = pairs.filter(F.col("rank") <= max_rank).select("query_id", "chunk_id", q.alias("q"), t.alias("t"))
    ratio = F.size(F.array_intersect("q", "t")) / F.greatest(F.size("q"), F.lit(1))
    return both.select("query_id", "chunk_id", ratio.alias("rerank_score"))


def rerank_problems(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Non-finite, repeated and unknown scored chunks."""
    finite = F.col("rerank_score").isNull() | F.isnan("rerank_score") | (F.abs("rerank_score") == float("inf"))
    bad = scores.filter(finite).select("query_id", "chunk_id", F.lit("non_finite_score").alias("rule"))
    twice = scores.groupBy("query_id", "chunk_id").count().filter("count > 1").select(
        "query_id", "chunk_id", F.lit("duplicate_chunk").alias("rule")
    )
    unknown = scores.join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select(
        "query_id", "chunk_id", F.lit("unknown_chunk").alias("rule")
    )
    return bad.unionByName(twice).unionByName(unknown)


def reorder(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Order by rerank score, then old rank, then chunk id; the old rank and score are kept."""
    if k < 1:
        raise ValueError("limit must be positive")
    joined = candidates.join(scores, ["query_id", "chunk_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 12)), "rank", "chunk_id")
    return (
        joined.withColumn("new_rank", F.row_number().over(order))
        .filter(F.col("new_rank") <= k)
        .withColumnsRenamed({"rank": "retrieval_rank", "score": "retrieval_score"})
        .withColumnRenamed("new_rank", "rank")
        .withColumn("score", F.col("rerank_score"))
    )


# ---------------------------------------------------------------- lookups and projections


def hydrate(results: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Join text and provenance after top-k, when only a few rows per query are left."""
    cols = columns or ("document_id", "title", "source_uri", "text")
    keep = [c for c in results.columns if c not in cols]
    return results.select(*keep).join(chunks.select("chunk_id", *cols), "chunk_id")


def lookup(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Batch key lookup; an id without a row comes back with ``found = false``."""
    return ids.select(key).distinct().join(table.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def to_evidence(results: DataFrame) -> DataFrame:
    """Ranked results to evidence rows; a rerank score that is no number becomes NULL."""
    meta = F.col("metadata")
    return results.select(
        "query_id", "chunk_id", "document_id", "title", "source_uri", "text",
        F.col("method").alias("retrieval_method"),
        F.col("rank").alias("retrieval_rank"),
        F.col("score").alias("retrieval_score"),
        F.try_element_at(meta, F.lit("rerank_score")).try_cast("double").alias("rerank_score"),
        F.concat(F.lit("C"), F.col("rank")).alias("citation_id"),
        meta.alias("metadata"),
    )


def uniform_hits(hits: DataFrame) -> DataFrame:
    """Fill the gaps of hits from differing sources: place in the list, score 1, document ``doc``."""
    document = F.coalesce(F.nullif("document_id", F.lit("")), F.lit("doc"))
    text = F.when(tx.is_blank(F.col("text")), "placeholder text").otherwise(F.col("text"))
    title = F.when(tx.is_blank(F.col("title")), document).otherwise(F.col("title"))
    return hits.select(
        "query_id",
        F.coalesce(F.nullif("chunk_id", F.lit("")), F.concat(F.lit("c_"), F.col("position"))).alias("chunk_id"),
        document.alias("document_id"),
        text.alias("text"),
        title.alias("title"),
        F.col("position").alias("rank"),
        F.coalesce(F.col("score").try_cast("double"), F.lit(1.0)).alias("score"),
        "method",
    )


def https_problem(url: Column) -> Column:
    """Why a URL is not a canonical https address, or NULL."""
    rest = F.substr(url, F.lit(9))
    host_port = F.regexp_extract(rest, r"^[^/?]*", 0)
    host = F.substring_index(host_port, ":", 1)
    port = F.when(host_port.contains(":"), F.regexp_extract(host_port, r"^[^:]*:(.*)$", 1))
    return (
        F.when(tx.is_blank(url), "blank")
        .when(~url.startswith("https://"), "not_https")
        .when(url.contains("@"), "credentials")
        .when(url.contains("#"), "fragment")
        .when(host_port == "", "no_host")
        .when(port.isNotNull() & (port != "443"), "port")
        .when(host.rlike(r"^\d+(\.\d+){3}$"), "ip_literal")
        .when(host.startswith("[") | host.endswith("]"), "ipv6_literal")
    )


def web_candidates(hits: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Web hits ``(query_id, title, url, snippet, position)`` to candidates, and the rejected ones.

    Blank addresses and snippets are dropped first; the rest keep their order and are renumbered.
    """
    usable = hits.filter(~tx.is_blank(F.col("url")) & ~tx.is_blank(F.col("snippet")))
    place = Window.partitionBy("query_id").orderBy("position")
    ranked = usable.withColumn("rank", F.row_number().over(place)).withColumn("problem", https_problem(F.col("url")))
    good = ranked.filter("problem is null").select(
        "query_id",
        F.concat_ws("_", F.lit("cand_web"), F.col("rank"), F.substring(content_hash(F.col("snippet")), 1, 8)).alias("candidate_id"),
        F.lit("web_search_snippet").alias("source_kind"),
        F.lit(source_id).alias("source_id"),
        F.col("url").alias("document_id"),
        F.concat(F.lit("hit_"), F.col("rank")).alias("chunk_id"),
        "title",
        F.lit("search_snippet").alias("section"),
        F.concat(F.lit("Web: "), F.col("title")).alias("source_label"),
        F.col("snippet").alias("text"),
        F.lit("web_search").alias("retrieval_route"),
        "rank",
        (F.lit(1.0) / F.col("rank")).alias("score"),
        F.col("url").alias("canonical_url"),
    )
    return good, ranked.filter("problem is not null").select("query_id", "url", "rank", "problem")


def corpus_candidates(results: DataFrame, source_id: str) -> DataFrame:
    """Corpus results to the same candidate shape."""
    return results.select(
        "query_id",
        F.col("chunk_id").alias("candidate_id"),
        F.lit("local_document").alias("source_kind"),
        F.lit(source_id).alias("source_id"),
        "document_id", "chunk_id", "title",
        F.coalesce("heading_path", F.lit("")).alias("section"),
        F.col("source_uri").alias("source_label"),
        "text",
        F.col("method").alias("retrieval_route"),
        "rank", "score",
        F.lit(None).cast("string").alias("canonical_url"),
    )
