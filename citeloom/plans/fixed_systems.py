"""Systems to compare: fixed ones (one search, packing, and a gate on the supplied answer) and the adaptive loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators import evidence as ev

# Fixed value: what a system says when it has nothing to answer from.
NO_ANSWER = (
    "I am unable to answer this question based on the provided corpus as it does not contain relevant information."
)
CALLS = {"dense": 1, "sparse": 1, "two_pass": 2}


def system_outputs(rows: DataFrame, answers: DataFrame, *, max_chunks: int = 6, max_characters: int = 24_000) -> DataFrame:
    """Outputs of several systems at once.

    ``rows``: hydrated results with ``system_name``; ``answers``: ``system_name, query_id, answer``.
    The two-pass system asks the same query twice, which cannot change its evidence: it is searched
    once and charged two calls.
    """
    key = F.struct("system_name", "query_id")
    keyed = rows.withColumn("query_id", key).drop("system_name")
    packed = ev.pack_context(keyed, max_chunks=max_chunks, max_characters=max_characters)
    flat = packed.select("query_id.system_name", "query_id.query_id", "selected", "total_characters")
    asked = answers.join(flat, ["system_name", "query_id"], "left")
    none = F.array().cast("array<string>")
    selected = F.coalesce("selected", none)
    allowed = F.transform(selected, lambda c, i: F.concat(F.lit("C"), i + 1))
    reason = (
        F.when(F.size(selected) == 0, "no_evidence_retrieved")
        .when(F.col("answer").isNull(), "no_evidence_retrieved")
        .when(ev.says_abstain(F.col("answer")), "generator_abstained")
        .when(F.size(ev.citation_errors(tx.strip(F.col("answer")), allowed)) > 0, "invalid_citations")
    )
    df = asked.withColumn("abstention_reason", reason).withColumn("retrieved", selected)
    text = F.when(F.col("abstention_reason").isin("no_evidence_retrieved", "invalid_citations"), NO_ANSWER).otherwise(tx.strip(F.col("answer")))
    calls = F.coalesce(*[F.when(F.col("system_name") == n, F.lit(c)) for n, c in CALLS.items()], F.lit(1))
    return df.select(
        "system_name", "query_id", text.alias("answer"), "abstention_reason",
        F.when(F.col("abstention_reason").isNull(), "completed").otherwise("abstained").alias("status"),
        F.col("retrieved").alias("retrieved_chunk_ids"), calls.alias("retrieval_calls"),
    )


def adaptive_outputs(state: DataFrame, evidence: DataFrame, name: str = "adaptive") -> DataFrame:
    """Outputs of the retrieval loop in the form of the fixed systems, from its finished states and evidence."""
    held = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))).alias("e"))
    df = state.join(held, "query_id", "left")
    ids = F.coalesce(F.transform("e", lambda x: x["chunk_id"]), F.array().cast("array<string>"))
    return df.select(
        F.lit(name).alias("system_name"), "query_id", "answer", "abstention_reason", "status", ids.alias("retrieved_chunk_ids"), "retrieval_calls",
    )
