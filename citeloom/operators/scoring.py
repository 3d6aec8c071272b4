"""Score cards per system and sample, their aggregation and the leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.quantiles import exact_quantiles
from citeloom.operators import metrics as mt

KEYS = ["system_name", "query_id"]
COMPARED = ("recall_at_1", "mrr", "ndcg_at_10", "fact_f1", "citation_precision", "abstention_correct")


def isolate_failures(wanted: DataFrame, system_results: DataFrame) -> DataFrame:
    """One row for every (system, sample): a missing result becomes a failed one, others are kept."""
    return wanted.select(*KEYS).join(system_results, KEYS, "left").withColumns({
        "status": F.coalesce("status", F.lit("failed")),
        "answer": F.coalesce("answer", F.lit("")),
        "citations": F.coalesce("citations", F.array().cast("array<string>")),
    })


def score_cards(
    samples: DataFrame, outputs: DataFrame, retrieved: DataFrame, citation_map: DataFrame, qrels: DataFrame, facts: DataFrame
) -> DataFrame:
    """All metrics of every (system, sample). ``samples``: ``query_id, requires_abstention, gold_documents``."""
    rows = outputs.join(samples, "query_id")
    ranks = mt.ranking_metrics(rows, retrieved, qrels, KEYS)
    fact = mt.fact_metrics(outputs, facts, KEYS).select(
        *KEYS, F.col("precision").alias("fact_precision"), F.col("recall").alias("fact_recall"), F.col("f1").alias("fact_f1")
    )
    cites = mt.citation_metrics(outputs, citation_map, retrieved, qrels, KEYS)
    hits = retrieved.select(*KEYS, "chunk_id").distinct().join(qrels.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")
    found = hits.groupBy(*KEYS).agg(F.count("*").alias("gold_found"))
    card = rows.join(ranks, KEYS).join(fact, KEYS).join(cites, KEYS).join(found, KEYS, "left")
    outcome = mt.abstention_outcome(F.col("status"), F.col("requires_abstention"))
    supported = F.when(
        (F.col("gold_count") > 0) & ~F.col("requires_abstention"), F.coalesce("gold_found", F.lit(0)) == F.col("gold_count")
    )
    return card.select(
        *KEYS, "recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10", "fact_precision", "fact_recall", "fact_f1",
        "citation_validity_rate", "citation_precision", "citation_recall", outcome.alias("abstention_outcome"),
        outcome.isin("true_positive", "true_negative").cast("double").alias("abstention_correct"),
        supported.alias("complete_support"), (F.col("gold_documents") > 1).alias("multi_source"), "requires_abstention",
        (F.col("status") == "completed").alias("answered"), "latency_ms", "retrieval_calls", "iterations",
    )


def aggregate_cards(cards: DataFrame) -> DataFrame:
    """Means, conditional rates (NULL without a denominator) and exact latency percentiles per system."""
    rate = lambda hit, base: F.avg(F.when(base, hit.cast("double")))
    means = {f"mean_{c}": F.avg(c) for c in ("recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10", "fact_f1", "citation_validity_rate", "citation_precision", "citation_recall", "latency_ms", "retrieval_calls", "iterations")}
    report = cards.groupBy("system_name").agg(
        F.count("*").alias("sample_count"),
        *[c.alias(n) for n, c in means.items()],
        F.avg("abstention_correct").alias("abstention_accuracy"),
        F.avg(F.col("answered").cast("double")).alias("answer_coverage"),
        rate(F.col("abstention_outcome") == "false_positive", ~F.col("requires_abstention")).alias("false_abstention_rate"),
        rate(F.col("answered"), F.col("requires_abstention")).alias("unsupported_answer_rate"),
        rate(F.col("complete_support"), F.col("multi_source") & F.col("complete_support").isNotNull()).alias("multi_source_complete_support_rate"),
        F.count(F.when(F.col("abstention_outcome") == "execution_failed", 1)).alias("failed_count"),
    )
    times = exact_quantiles(cards, ["system_name"], "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99})
    return report.join(times, "system_name", "left")


def leaderboard(report: DataFrame) -> DataFrame:
    """One formatted line per system, best first."""
    f3 = lambda c: F.format_string("%.3f", F.round(F.col(c), 9))
    line = F.concat_ws(
        " | ", F.col("system_name"), f3("mean_recall_at_1"), f3("mean_mrr"), f3("mean_ndcg_at_10"), f3("mean_fact_f1"),
        f3("mean_citation_validity_rate"), f3("mean_citation_precision"), f3("abstention_accuracy"), F.format_string("%.1f", F.round("mean_latency_ms", 9)),
    )
    return report.select("system_name", "mean_ndcg_at_10", line.alias("line")).orderBy(F.desc("mean_ndcg_at_10"), "system_name")


def paired_metrics(cards: DataFrame) -> DataFrame:
    """Cards unpivoted to ``(sample_id, system_name, metric, score)``."""
    return cards.unpivot(
        ["query_id", "system_name"], list(COMPARED), "metric", "score"
    ).select(F.col("query_id").alias("sample_id"), "system_name", "metric", "score")


# ---------------------------------------------------------------- inspection


def diagnostic(answerable: Column, reranked: Column, hybrid: Column) -> Column:
    """Label from the first gold rank in the reranked and fused lists."""
    return (
        F.when(~answerable, "unanswerable_incorrectly_retrieved")
        .when(reranked <= 1, "gold_hit_at_1")
        .when(reranked <= 5, "gold_hit_at_5")
        .when(hybrid <= 10, "gold_hit_at_10")
        .otherwise("gold_not_retrieved")
    )


def first_gold_ranks(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """First gold rank per query in the reranked and hybrid lists of ``(mode, query_id, chunk_id, rank)``."""
    hits = results.join(qrels.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")
    rank = lambda m: F.min(F.when(F.col("mode") == m, F.col("rank")))
    return hits.groupBy("query_id").agg(rank("reranked").alias("reranked_rank"), rank("hybrid").alias("hybrid_rank"))


def judgment_queue(queries: DataFrame, results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Questions waiting for review with their automatic label and top reranked chunk."""
    gold = qrels.groupBy("query_id").agg(F.count("*").alias("gold"))
    top = results.filter("mode = 'reranked' and rank = 1").select("query_id", F.col("chunk_id").alias("top_chunk_id"))
    rows = queries.join(gold, "query_id", "left").join(first_gold_ranks(results, qrels), "query_id", "left").join(top, "query_id", "left")
    label = diagnostic(F.col("gold").isNotNull(), F.col("reranked_rank"), F.col("hybrid_rank"))
    return rows.select("query_id", label.alias("automatic_diagnostic"), F.lit("pending_human_review").alias("human_judgment"), "top_chunk_id")


def mode_summary(cards: DataFrame) -> DataFrame:
    """Mean recall and MRR per mode over answerable questions."""
    return cards.filter("gold_count > 0").groupBy("mode").agg(
        F.count("*").alias("questions"), *[F.avg(c).alias(c) for c in ("recall_at_1", "recall_at_5", "recall_at_10", "mrr")]
    )


def multi_source_support(results: DataFrame, qrels: DataFrame, *, k: int = 5) -> DataFrame:
    """Any and complete support and pooled recall within ``k`` for questions with several gold chunks."""
    gold = qrels.select("query_id", "chunk_id").distinct()
    many = gold.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 1")
    modes = results.select("mode").distinct()
    base = many.join(results.filter(F.col("rank") <= k), "query_id", "left")
    found = base.join(gold.withColumn("g", F.lit(1)), ["query_id", "chunk_id"], "left").groupBy("mode", "query_id", "n").agg(
        F.count_distinct(F.when(F.col("g") == 1, F.col("chunk_id"))).alias("hits")
    )
    return modes.join(found, "mode").groupBy("mode").agg(
        F.count("*").alias("questions"),
        F.count(F.when(F.col("hits") > 0, 1)).alias("any_support"),
        F.count(F.when(F.col("hits") == F.col("n"), 1)).alias("complete_support"),
        (F.sum("hits") / F.sum("n")).alias("pooled_recall"),
    )


def provenance_rate(results: DataFrame, columns: list[str]) -> DataFrame:
    """Share of results whose provenance columns are all present."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return results.groupBy("mode").agg(F.count("*").alias("results"), F.avg(whole.cast("double")).alias("complete_rate"))


def review_sheet(results: DataFrame, chunks: DataFrame, qrels: DataFrame, *, top: int = 3, width: int = 220) -> DataFrame:
    """Top results of every mode with a gold mark and a one-line excerpt."""
    from citeloom.functions import text as tx

    gold = qrels.select("query_id", "chunk_id").distinct().withColumn("is_gold", F.lit(True))
    rows = results.filter(F.col("rank") <= top).join(chunks.select("chunk_id", "title", "text"), "chunk_id").join(gold, ["query_id", "chunk_id"], "left")
    flat = F.array_join(tx.words(F.col("text")), " ")
    excerpt = F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("..."))).otherwise(flat)
    return rows.select("query_id", "mode", "rank", "chunk_id", "title", F.coalesce("is_gold", F.lit(False)).alias("is_gold"), F.replace(excerpt, F.lit("|"), F.lit("\\|")).alias("excerpt"))
