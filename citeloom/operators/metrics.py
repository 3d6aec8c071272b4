"""Ranking, fact, citation and abstention metrics over whole result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as tx

# Words ignored when a fact statement is compared with an answer.
FACT_STOPWORDS = (
    "a", "an", "the", "in", "on", "at", "to", "for", "of", "and", "or", "is", "are", "was", "were",
    "be", "by", "as", "with", "that", "this", "it", "from", "can", "uses", "use", "used", "has",
    "have", "sets", "set", "also", "into",
)


def ranking_metrics(
    samples: DataFrame, results: DataFrame, qrels: DataFrame, keys: list[str],
    *, ks: tuple[int, ...] = (1, 3, 5, 10), empty_recall: float = 0.0,
) -> DataFrame:
    """Recall@k, reciprocal rank and nDCG at 10 for every row of ``samples`` (which carries ``keys``).

    ``results`` is ``keys + chunk_id, rank``; ``qrels`` is ``query_id, chunk_id``. A chunk retrieved
    twice counts at its first place. Samples without gold keep a row with ``empty_recall``.
    """
    gold = qrels.select("query_id", "chunk_id").distinct()
    first = results.groupBy(*keys, "chunk_id").agg(F.min("rank").alias("rank"))
    hits = first.join(gold, ["query_id", "chunk_id"], "left_semi").filter(F.col("rank") <= max(10, *ks))
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1.0)
    per = hits.groupBy(*keys).agg(
        *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"h{k}") for k in ks],
        F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(F.col("rank") <= 10, gain)).alias("dcg"),
    )
    golds = gold.groupBy("query_id").agg(F.count("*").alias("gold_count"))
    base = samples.select(*keys).join(golds, "query_id", "left").join(per, keys, "left")
    n = F.coalesce("gold_count", F.lit(0))
    ideal = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(1), F.least(n, F.lit(10)).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda acc, r: acc + F.lit(1.0) / F.log2(r + 1.0),
    )
    recall = lambda k: F.when(n > 0, F.coalesce(f"h{k}", F.lit(0)) / n).otherwise(F.lit(empty_recall))
    return base.select(
        *keys,
        n.alias("gold_count"),
        *[recall(k).alias(f"recall_at_{k}") for k in ks],
        F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        F.when(n > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(F.lit(0.0)).alias("ndcg_at_10"),
    )


def fact_metrics(answers: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Lexical fact proxy. ``answers``: keys + ``answer``; ``facts``: ``query_id, fact_id, statement``.

    A fact is matched when at least half of its salient words occur in the answer.
    """
    salient = facts.select(
        "query_id", "fact_id",
        F.filter(
            F.array_distinct(tx.ascii_words(F.lower("statement"))), lambda w: ~w.isin(*FACT_STOPWORDS)
        ).alias("fw"),
    )
    said = answers.select(*keys, "answer", F.array_distinct(tx.ascii_words(F.lower("answer"))).alias("aw"))
    share = F.size(F.array_intersect("fw", "aw")) / F.size("fw")
    hit = (F.size("fw") > 0) & (F.size("aw") > 0) & (share >= 0.5)
    counted = said.join(salient, "query_id").groupBy(*keys).agg(
        F.count("*").alias("facts"), F.count(F.when(hit, 1)).alias("matched")
    )
    rows = answers.select(*keys, F.length("answer").alias("chars"), tx.is_blank(F.col("answer")).alias("blank")).join(
        counted, keys, "left"
    )
    m, n = F.coalesce("matched", F.lit(0)), F.coalesce("facts", F.lit(0))
    recall = F.when(n > 0, m / n).otherwise(0.0)
    dense = F.least(F.lit(1.0), (m * 150) / F.greatest("chars", F.lit(1)))
    precision = (
        F.when(m == 0, 0.0)
        .when(F.col("blank"), 1.0)
        .when((m == n) & (dense < 0.5), 0.5)
        .when(m == n, 1.0)
        .otherwise(dense)
    )
    out = rows.select(*keys, m.alias("matched_facts"), precision.alias("precision"), recall.alias("recall"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def citation_metrics(
    answers: DataFrame, citation_map: DataFrame, results: DataFrame, qrels: DataFrame, keys: list[str]
) -> DataFrame:
    """Validity, precision and recall of cited ids.

    ``answers``: keys + ``answer``, ``citations``; ``citation_map``: keys + ``citation_id, chunk_id``;
    ``results``: keys + ``chunk_id``.
    """
    inline = F.transform(
        F.regexp_extract_all("answer", F.lit(r"\[C([0-9]+)\]"), F.lit(1)), lambda n: F.concat(F.lit("C"), n)
    )
    cited = answers.select(*keys, F.explode(F.array_union(inline, F.coalesce("citations", F.array().cast("array<string>")))).alias("citation_id"))
    got = results.select(*keys, "chunk_id").distinct().withColumn("retrieved", F.lit(True))
    gold = qrels.select("query_id", "chunk_id").distinct().withColumn("is_gold", F.lit(True))
    resolved = (
        cited.join(citation_map.select(*keys, "citation_id", "chunk_id"), [*keys, "citation_id"], "left")
        .join(got, [*keys, "chunk_id"], "left")
        .join(gold, ["query_id", "chunk_id"], "left")
    )
    valid = F.coalesce("retrieved", F.lit(False))
    good = valid & F.coalesce("is_gold", F.lit(False))
    per = resolved.groupBy(*keys).agg(
        F.count("*").alias("cited"),
        F.count(F.when(valid, 1)).alias("valid"),
        F.count(F.when(good, 1)).alias("grounded"),
        F.count_distinct(F.when(good, F.col("chunk_id"))).alias("gold_chunks"),
    )
    golds = gold.groupBy("query_id").agg(F.count("*").alias("gold_count"))
    rows = answers.select(*keys).join(per, keys, "left").join(golds, "query_id", "left")
    rate = lambda c: F.coalesce(F.col(c) / F.col("cited"), F.lit(0.0))
    return rows.select(
        *keys,
        F.coalesce("cited", F.lit(0)).alias("cited"),
        rate("valid").alias("citation_validity_rate"),
        rate("grounded").alias("citation_precision"),
        F.coalesce(F.col("gold_chunks") / F.col("gold_count"), F.lit(0.0)).alias("citation_recall"),
        F.coalesce(F.col("valid") == F.col("cited"), F.lit(False)).alias("all_citations_valid"),
    )


def abstention_outcome(status: Column, requires_abstention: Column) -> Column:
    abstained = status == "abstained"
    return (
        F.when(~status.isin("completed", "abstained"), "execution_failed")
        .when(requires_abstention & abstained, "true_positive")
        .when(~requires_abstention & ~abstained, "true_negative")
        .when(abstained, "false_positive")
        .otherwise("false_negative")
    )


def evidence_recall(cases: DataFrame, retrieved: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Share of expected evidence found; a case expecting nothing scores one."""
    hits = retrieved.select(*keys, "evidence_id").distinct().join(
        expected.select("case_id", "evidence_id").distinct(), ["case_id", "evidence_id"], "left_semi"
    ).groupBy(*keys).agg(F.count("*").alias("hits"))
    size = expected.select("case_id", "evidence_id").distinct().groupBy("case_id").agg(F.count("*").alias("n"))
    rows = cases.select(*keys).join(size, "case_id", "left").join(hits, keys, "left")
    return rows.select(
        *keys, F.when(F.col("n").isNull(), 1.0).otherwise(F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 4)).alias("evidence_recall")
    )
