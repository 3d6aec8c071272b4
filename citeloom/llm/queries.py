"""The queries of the operators of this folder: ``opN_<name>`` over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import collocations, importance, language, lines, metric_tree, mixing, near_duplicates, packing, pii, pruned_graph, suffix_dedup, toxicity, url_templates, vector_cells
from citeloom.llm.common import pick, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_power_of_two_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut into power-of-two sequences."""
    return packing.pack(read(spark, folder, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


@query
def op8_pivotal_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is taken so that sources come near their targets."""
    mixed = mixing.mix(read(spark, folder, "documents"))
    return mixed.withColumn("taken", F.col("size") * F.col("copies"))


@query
def op9_ngram_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(pick(docs, doc_id="doc_id", text="text"), model).select("doc_id", "score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op6_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the three-line windows that occurred before."""
    docs = pick(read(spark, folder, "documents"), doc_id="doc_id", text="text")
    return lines.remove_repeats(docs)


SQL["op6_line_windows"] = lines.SQL


@query
def op3_metric_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 largest whole-number inner products of every 20th vector, exactly."""
    rows = vector_cells.usable(read(spark, folder, "embeddings"), "vec_id", "embedding")
    rows = rows.select("id", vector_cells.quantised(F.col("v")).alias("v"))
    return metric_tree.top_products(rows, vector_cells.divisible(rows, 20), 20)


@query
def op5_pruned_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest vectors found by cosine of every 50th vector."""
    rows = vector_cells.usable(read(spark, folder, "embeddings"), "vec_id", "embedding")
    return pruned_graph.nearest(rows, vector_cells.divisible(rows, 50), 5)


SQL["op3_metric_tree"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0)
SELECT query_id, rank, vec_id, score FROM (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)) WHERE rank <= 20"""


@query
def op10_bbit_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates.groups(read(spark, folder, "documents"))


@query
def op4_path_templates(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict on every page's url; the path templates learn from the quality labels of the documents shown."""
    labels = read(spark, folder, "labels").select(F.col("doc_id").alias("number"), (F.col("quality") == 0).alias("bad"))
    return url_templates.judge(read(spark, folder, "pages"), labels)


@query
def op7_lstm_crf_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: the patterns' spans and the tagger's."""
    docs = read(spark, folder, "documents")
    found = pii.detect(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 200-byte strings that occur anywhere else."""
    kept = suffix_dedup.remove_repeats(read(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_prefix_crc_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the documents of at least 20 words, drawn by how much their n-grams look like the benchmark's."""
    drawn = importance.importance(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


SQL["op13_prefix_crc_resampling"] = importance.SQL


@query
def op12_dynamic_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest phrases of each language, counted by dynamic itemset counting."""
    return collocations.collocations(collocations.phrase_counts(read(spark, folder, "documents"))).drop("cut")


SQL["op12_dynamic_collocations"] = collocations.SQL


@query
def op11_crf_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = read(spark, folder, "documents")
    model = language.train(docs, ~language.held_out(F.col("doc_id")))
    found = language.detect(docs, model, keep=["doc_id"])
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
