"""Hybrid search inside a part of the corpus: equality filters that reach both legs, or the dense one alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import fusion, lexical, vectors
from citeloom.plans.corpus_store import CorpusStore

# Fixed value: what a search may filter on.
FIELDS = ("source", "source_type", "document_id")
LEGS = ("both", "dense")


def filtered_legs(
    store: CorpusStore, queries: DataFrame, query_vectors: DataFrame, *, k_leg: int = 20, filter_legs: str = "both"
) -> dict[str, DataFrame]:
    """Top ``k_leg`` of both legs for ``queries(query_id, query, filters...)``.

    Every column of ``queries`` beside ``query_id`` and ``query`` is a filter, NULL where a query has none.
    ``filter_legs="dense"`` leaves the sparse leg unfiltered.
    """
    fields = tuple(c for c in queries.columns if c not in ("query_id", "query"))
    unknown = [f for f in fields if f not in FIELDS]
    if unknown:
        raise ValueError(f"cannot filter on {', '.join(unknown)}")
    if filter_legs not in LEGS:
        raise ValueError(f"filter_legs must be one of {', '.join(LEGS)}")
    attributes = store.chunks.select("chunk_id", *(f for f in fields if f != "document_id"))
    if filter_legs == "both":
        sparse = lexical.bm25_top_k(store.index, queries, k_leg, attributes=attributes, fields=fields)
    else:
        sparse = lexical.bm25_top_k(store.index, queries.select("query_id", "query"), k_leg)
    held = store.vectors
    missing = [f for f in fields if f not in held.columns]
    if missing:
        held = held.join(store.chunks.select("chunk_id", *missing), "chunk_id")
    asked = query_vectors.join(queries.select("query_id", *fields), "query_id")
    return {"sparse": sparse, "dense": vectors.cosine_top_k(asked, held, k_leg, filter_column=fields)}


def filtered_hybrid(
    store: CorpusStore, queries: DataFrame, query_vectors: DataFrame, k: int = 20, *, k_leg: int = 20, filter_legs: str = "both"
) -> DataFrame:
    """Fused results of the legs; see ``filtered_legs``."""
    legs = filtered_legs(store, queries, query_vectors, k_leg=k_leg, filter_legs=filter_legs)
    return fusion.reciprocal_rank_fusion(legs["sparse"], legs["dense"], k)


def outside_filters(results: DataFrame, store: CorpusStore, queries: DataFrame) -> DataFrame:
    """Results that break their query's filter: none, if both legs were filtered."""
    fields = [c for c in queries.columns if c not in ("query_id", "query")]
    met = results.select("query_id", "chunk_id").join(store.chunks.select("chunk_id", *[F.col(f).alias(f"is_{f}") for f in fields]), "chunk_id").join(queries, "query_id")
    broken = [F.col(f).isNotNull() & (F.col(f) != F.col(f"is_{f}")) for f in fields]
    rule = F.coalesce(*[F.when(b, F.lit(f)) for b, f in zip(broken, fields)]) if fields else F.lit(None)
    return met.select("query_id", "chunk_id", rule.alias("rule")).filter("rule is not null")
