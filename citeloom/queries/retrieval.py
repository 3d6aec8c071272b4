"""Lexical, vector, fused and reranked retrieval with its ranking quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.functions.checks import violations
from citeloom.operators import fusion, lexical, metrics, vectors
from citeloom.plans import filtered_search
from citeloom.queries import inputs as inp
from citeloom.queries.base import fragment, register, sql


@register("tokens_per_document", "C1", sql(
    f"""SELECT doc_id, len(t) AS token_count, len(list_distinct(t)) AS distinct_tokens,
        sha256(array_to_string(t, ' ')) AS token_digest FROM (SELECT doc_id, {inp.sql_tokens('text')} AS t FROM docs)""", "docs"))
def tokens_per_document(spark, folder):
    t = inp.docs(spark, folder).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select(
        "doc_id", F.size("t").alias("token_count"), F.size(F.array_distinct("t")).alias("distinct_tokens"),
        F.sha2(F.array_join("t", " "), 256).alias("token_digest"),
    )


@register("postings_table", "C2", sql(
    "SELECT term, count(*) AS chunks, sum(tf) AS occurrences, max(tf) AS max_tf FROM postings GROUP BY term", "postings"))
def postings_table(spark, folder):
    return inp.fresh_index(spark, folder).postings.groupBy("term").agg(
        F.count("*").alias("chunks"), F.sum("tf").alias("occurrences"), F.max("tf").alias("max_tf")
    )


@register("bm25_term_statistics", "C3", sql("SELECT term, nd, round(idf, 6) AS idf FROM term_stats", "term_stats"))
def bm25_term_statistics(spark, folder):
    return inp.fresh_index(spark, folder).terms


@register("bm25_top_10", "C4", sql(
    "SELECT query_id, chunk_id, document_id, ordinal, rank, round(score, 6) AS score FROM bq_sparse WHERE rank <= 10", "bq_sparse"))
def bm25_top_10(spark, folder):
    return inp.sparse_top(spark, folder, 10)


@register("bm25_zero_score_fill", "C5", sql(
    f"""SELECT * FROM (SELECT q.query_id, c.chunk_id, c.document_id, c.ordinal,
            row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(b.score, 0) DESC, c.document_id, c.ordinal) AS rank,
            round(coalesce(b.score, 0), 6) AS score
        FROM (SELECT DISTINCT query_id FROM rare_terms) q CROSS JOIN chunk_stats c
        LEFT JOIN rare_bm25 b ON b.query_id = q.query_id AND b.chunk_id = c.chunk_id) WHERE rank <= 25""",
    "rare_bm25"))
def bm25_zero_score_fill(spark, folder):
    return lexical.bm25_top_k(inp.index(spark, folder), rare_queries(spark, folder), 25)


def rare_queries(spark, folder):
    """The longest word of every passage beside one word no chunk holds: few or no matches."""
    longest = F.element_at(
        F.array_sort(
            F.array_distinct(tx.tokens(F.col("query"))),
            lambda a, b: F.when(F.length(a) < F.length(b), 1).when(F.length(a) > F.length(b), -1).when(a > b, 1).when(a < b, -1).otherwise(0),
        ),
        1,
    )
    return inp.queries(spark, folder).select(
        "query_id", F.concat(longest, F.lit(" zzunseen"), F.col("query_id")).alias("query")
    )


inp.fragment(
    "rare_queries",
    f"""SELECT query_id, list_sort(list_transform(list_distinct({inp.sql_tokens('query')}),
            lambda x: {{'l': -length(x), 'x': x}}))[1].x || ' zzunseen' || query_id AS query FROM bench_queries""",
    "bench_queries",
)
inp.search_fragments("rare", "rare_queries")


@register("query_validation", "C6, D10", sql(
    f"""SELECT turn_key, CASE WHEN {inp.sql_strip('query')} = '' THEN 'blank_query'
            WHEN len({inp.sql_tokens('query')}) = 0 THEN 'no_tokens' END AS reason
        FROM (SELECT conv_id || ':' || turn AS turn_key, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN repeat(' ', CAST(conv_id % 3 AS BIGINT)) WHEN 2 THEN '... the' ELSE 'of ' || text END AS query FROM conversations)
        WHERE {inp.sql_strip('query')} = '' OR len({inp.sql_tokens('query')}) = 0"""))
def query_validation(spark, folder):
    shaped = (
        F.when(F.col("turn") % 4 == 0, F.col("text"))
        .when(F.col("turn") % 4 == 1, F.expr("repeat(' ', int(conv_id % 3))"))
        .when(F.col("turn") % 4 == 2, "... the")
        .otherwise(F.concat(F.lit("of "), F.col("text")))
    )
    q = inp.table(spark, folder, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), shaped.alias("query"))
    return lexical.rejected_queries(q).withColumnRenamed("query_id", "turn_key")


@register("index_fingerprints", "C7, C9", sql(
    """SELECT (SELECT count(*) FROM chunk_stats) AS chunk_count, (SELECT count(DISTINCT document_id) FROM chunk_stats) AS document_count,
        (SELECT sha256(string_agg(b || ':' || h, ',' ORDER BY b)) FROM
          (SELECT substr(d, 1, 3) AS b, sha256(string_agg(d || '*' || n, ',' ORDER BY d || '*' || n)) AS h FROM
            (SELECT sha256(chunk_id || ':' || document_id) AS d, count(*) AS n FROM chunk_stats GROUP BY 1) GROUP BY 1)) AS corpus_fingerprint,
        sha256('tokenizer=1.0;k1=1.5;b=0.75') AS configuration_fingerprint""", "chunk_stats"))
def index_fingerprints(spark, folder):
    return lexical.index_fingerprints(inp.index(spark, folder))


@register("unresolved_index_chunks", "C8", sql(
    "SELECT chunk_id AS entity_id, 'unresolved_chunk' AS rule FROM chunks WHERE doc_id % 7 = 3 ", "chunks"))
def unresolved_index_chunks(spark, folder):
    gone = inp.docs(spark, folder).filter("doc_id % 7 = 3").select("document_id")
    left = inp.chunks(spark, folder).join(gone, "document_id", "left_anti")
    return lexical.unresolved_chunks(inp.index(spark, folder), left)


@register("index_consistency", "C2, C10", sql(
    """SELECT entity_id, rule, copies FROM (
        SELECT chunk_id AS entity_id, 'duplicate_chunk_id' AS rule, count(*) AS copies FROM doubled GROUP BY 1 HAVING count(*) > 1
        UNION ALL SELECT chunk_id, 'empty_token_list', 1 FROM doubled WHERE len(toks) = 0)""", "doubled"))
def index_consistency(spark, folder):
    base = inp.fresh_chunks(spark, folder)
    again = base.filter(F.col("ordinal") >= 1)
    emptied = base.filter(F.col("ordinal") == 1).withColumn("text", F.lit("... of the")).withColumn("chunk_id", F.concat(F.lit("e:"), "chunk_id"))
    return lexical.index_problems(base.unionByName(again).unionByName(emptied))


inp.fragment("doubled", f"""SELECT chunk_id, toks FROM chunk_tokens UNION ALL SELECT chunk_id, toks FROM chunk_tokens WHERE ordinal >= 1
    UNION ALL SELECT 'e:' || chunk_id, [] FROM chunk_tokens WHERE ordinal = 1""", "chunk_tokens")


@register("vector_checks", "D3", sql(
    """SELECT CAST(vec_id AS VARCHAR) AS entity_id, CASE vec_id % 9 WHEN 1 THEN 'empty_vector' WHEN 2 THEN 'dimension_mismatch' WHEN 3 THEN 'non_finite_value' END AS rule
       FROM embeddings WHERE vec_id % 9 IN (1, 2, 3)"""))
def vector_checks(spark, folder):
    e = F.col("embedding")
    broken = (
        F.when(F.col("vec_id") % 9 == 1, F.array().cast("array<float>"))
        .when(F.col("vec_id") % 9 == 2, F.slice(e, 1, 63))
        .when(F.col("vec_id") % 9 == 3, F.transform(e, lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x).cast("float")))
        .otherwise(e)
    )
    return vectors.vector_problems(inp.table(spark, folder, "embeddings").withColumn("embedding", broken), "vec_id")


@register("vector_point_ids", "D4, D5", sql(
    """SELECT chunk_id, document_id, ordinal, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
        substr('89ab', CAST((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id,
        heading_path, source_type
       FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('citeloom:chunk:' || chunk_id)) AS h,
             CASE WHEN ordinal > 0 THEN 'part ' || ordinal END AS heading_path FROM chunks)""", "chunks"))
def vector_point_ids(spark, folder):
    base = inp.fresh_chunks(spark, folder).withColumn("source_type", F.lit("text")).withColumn(
        "heading_path", F.when(F.col("ordinal") > 0, F.concat(F.lit("part "), "ordinal")).otherwise("")
    )
    return vectors.payload(base).select("chunk_id", "document_id", "ordinal", "point_id", "heading_path", "source_type")


COSINE = """SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (
    SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank
    FROM embeddings q JOIN embeddings v ON {on}) WHERE rank <= {k}"""


@register("cosine_top_10", "D6", COSINE.format(on="true", k=10))
def cosine_top_10(spark, folder):
    e = inp.table(spark, folder, "embeddings")
    return vectors.cosine_top_k(e.withColumnRenamed("vec_id", "query_id"), e, 10, vector_id="vec_id")


@register("cosine_top_5_same_label", "D7", COSINE.format(on="q.label = v.label", k=5))
def cosine_top_5_same_label(spark, folder):
    e = inp.table(spark, folder, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("filter_value"))
    return vectors.cosine_top_k(q, e, 5, vector_id="vec_id", filter_column="label")


@register("vector_upsert", "A9", sql(
    """SELECT vec_id, label, batch FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY batch DESC) AS r FROM
        (SELECT vec_id, label, 1 AS batch FROM embeddings UNION ALL SELECT vec_id, label + 100, 2 FROM embeddings WHERE vec_id % 3 = 0)) WHERE r = 1"""))
def vector_upsert(spark, folder):
    e = inp.table(spark, folder, "embeddings").select("vec_id", "label", F.lit(1).alias("batch"))
    new = e.filter("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("batch"))
    return vectors.latest_points(e, new, key="vec_id")


@register("duplicate_chunk_ids", "D9", sql(
    """SELECT h AS entity_id, 'duplicate_chunk_id' AS rule, count(*) AS copies FROM (SELECT sha256(text) AS h FROM docs) GROUP BY h HAVING count(*) > 1""", "docs"))
def duplicate_chunk_ids(spark, folder):
    from citeloom.functions.checks import duplicates
    from citeloom.functions.identity import content_hash

    return duplicates(inp.docs(spark, folder).select(content_hash(F.col("text")).alias("chunk_id")), ["chunk_id"], "duplicate_chunk_id")


@register("embedded_chunks_nearest", "D1, D2, D6", sql(
    "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bq_dense WHERE rank <= 10", "bq_dense"))
def embedded_chunks_nearest(spark, folder):
    return inp.dense_top(spark, folder, 10)


@register("embed_with_model", "D1, D2", None)
def embed_with_model(spark, folder):
    """The pluggable path: a Python model called in batches of eight over all chunks."""
    out = vectors.embed_rows(inp.chunks(spark, folder).select("chunk_id", "text"), "text", letter_model)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return out.select("chunk_id", F.size("embedding").alias("dim"), norm.alias("norm"))


def letter_model():
    import numpy as np

    def model(texts):
        rows = np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype=float)
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    return model


@register("bucketed_vector_search", "D11", None)
def bucketed_vector_search(spark, folder):
    """Recall of the bucketed search against the exact one, per label."""
    e = inp.table(spark, folder, "embeddings")
    q = e.withColumnRenamed("vec_id", "query_id")
    near = vectors.lsh_top_k(q, e, 10, dim=64, vector_id="vec_id", tables=8).select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = vectors.cosine_top_k(q, e, 10, vector_id="vec_id")
    return (
        exact.join(near, ["query_id", "vec_id"], "left")
        .join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
        .groupBy("label")
        .agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("pairs"))
    )


@register("route_first_occurrence", "E1", sql(
    """SELECT query_id, method, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank) AS r FROM
        (SELECT user_id AS query_id, event_type AS chunk_id, event_id AS rank, value AS score, 'sparse' AS method FROM events)) WHERE r = 1"""))
def route_first_occurrence(spark, folder):
    return fusion.first_per_route(
        inp.table(spark, folder, "events").select(
            F.col("user_id").alias("query_id"), F.col("event_type").alias("chunk_id"), F.col("event_id").alias("rank"),
            F.col("value").alias("score"), F.lit("sparse").alias("method"),
        )
    )


@register("hybrid_top_20", "E2, E3", sql(
    """SELECT query_id, chunk_id, rank, round(score, 6) AS score, sparse_rank, dense_rank, round(sparse_score, 6) AS sparse_score,
        round(dense_score, 6) AS dense_score FROM bq_hybrid""", "bq_hybrid"))
def hybrid_top_20(spark, folder):
    return inp.all_modes(spark, folder)["hybrid"]


def filter_questions(spark, folder):
    """The questions, a third each without a filter, inside one source, and inside one document (some in both)."""
    q, i = inp.queries(spark, folder), F.col("query_id")
    docs = inp.table(spark, folder, "documents").select(F.col("doc_id").alias("number"))
    named = inp.docs(spark, folder).select(F.col("doc_id").alias("number"), "document_id")
    q = q.withColumn("number", F.when((i % 3 == 1) | (i % 12 == 5), i * 7 % docs.agg(F.count("*")).scalar()))
    q = q.join(named, "number", "left").drop("number")
    return q.withColumn("source", F.when(i % 3 == 2, F.concat(F.lit("src"), i % 20)))


fragment("filter_questions", """SELECT q.query_id, d.document_id, CASE WHEN q.query_id % 3 = 2 THEN 'src' || (q.query_id % 20) END AS source FROM bench_queries q
    LEFT JOIN docs d ON d.doc_id = CASE WHEN q.query_id % 3 = 1 OR q.query_id % 12 = 5 THEN q.query_id * 7 % (SELECT count(*) FROM documents) END""", "bench_queries", "docs")
fragment("filter_pairs", """SELECT f.query_id, c.chunk_id, c.document_id, c.ordinal FROM filter_questions f JOIN chunks c
    ON (f.document_id IS NULL OR f.document_id = c.document_id) AND (f.source IS NULL OR f.source = c.source)""", "filter_questions", "chunks")
fragment("filter_sparse", """SELECT * FROM (SELECT f.query_id, f.chunk_id, coalesce(b.score, 0) AS score,
        row_number() OVER (PARTITION BY f.query_id ORDER BY coalesce(b.score, 0) DESC, f.document_id, f.ordinal) AS rank
    FROM filter_pairs f SEMI JOIN bq_terms t ON t.query_id = f.query_id LEFT JOIN bq_bm25 b ON b.query_id = f.query_id AND b.chunk_id = f.chunk_id) WHERE rank <= 20""", "filter_pairs", "bq_terms", "bq_bm25")
fragment("filter_dense", """SELECT * FROM (SELECT f.query_id, f.chunk_id, c.score, row_number() OVER (PARTITION BY f.query_id ORDER BY c.score DESC, f.chunk_id) AS rank
    FROM filter_pairs f JOIN bq_cosine c ON c.query_id = f.query_id AND c.chunk_id = f.chunk_id) WHERE rank <= 20""", "filter_pairs", "bq_cosine")
_fused = """SELECT query_id, chunk_id, rank, round(score, 6) AS score, sparse_rank, dense_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, least(sparse_rank, dense_rank), chunk_id) AS rank
    FROM (SELECT coalesce(s.query_id, d.query_id) AS query_id, coalesce(s.chunk_id, d.chunk_id) AS chunk_id, s.rank AS sparse_rank, d.rank AS dense_rank, coalesce(1.0 / (60 + s.rank), 0) + coalesce(1.0 / (60 + d.rank), 0) AS score
        FROM {sparse} s FULL OUTER JOIN filter_dense d ON s.query_id = d.query_id AND s.chunk_id = d.chunk_id)) WHERE rank <= 20"""


def _filtered(spark, folder, **options):
    found = filtered_search.filtered_hybrid(inp.store(spark, folder), filter_questions(spark, folder), inp.query_vectors(spark, folder), **options)
    return found.select("query_id", "chunk_id", "rank", "score", "sparse_rank", "dense_rank")


@register("hybrid_filtered", "E3, D7", sql(_fused.format(sparse="filter_sparse"), "filter_sparse", "filter_dense"))
def hybrid_filtered(spark, folder):
    """Fused search inside a source or a document: both legs are filtered, and padding stays inside."""
    return _filtered(spark, folder)


@register("hybrid_filtered_dense_leg", "E3, D7", sql(_fused.format(sparse="bq_sparse"), "bq_sparse", "filter_dense"))
def hybrid_filtered_dense_leg(spark, folder):
    """The same with the filter on the dense leg alone."""
    return _filtered(spark, folder, filter_legs="dense")


@register("reranked_top_6", "E4, E5", sql(
    """SELECT query_id, chunk_id, rank, round(rerank_score, 6) AS rerank_score, retrieval_rank, round(retrieval_score, 6) AS retrieval_score
       FROM bq_reranked""", "bq_reranked"))
def reranked_top_6(spark, folder):
    return inp.all_modes(spark, folder)["reranked"].select(
        "query_id", "chunk_id", "rank", "rerank_score", "retrieval_rank", "retrieval_score"
    )


@register("rerank_with_model", "E4", None)
def rerank_with_model(spark, folder):
    base = inp.hybrid_top(spark, folder)
    pairs = fusion.hydrate(base, inp.chunks(spark, folder), "text").join(inp.queries(spark, folder), "query_id")
    return fusion.reorder(base, fusion.score_pairs(pairs, shared_words_model), 6).select("query_id", "chunk_id", "rank", "rerank_score")


def shared_words_model():
    def model(queries, texts):
        return [len(set(q.split()) & set(t.split())) / max(1, len(set(q.split()))) for q, t in zip(queries, texts)]

    return model


@register("rerank_score_checks", "E5", sql(
    """SELECT query_id, chunk_id, rule FROM (
        SELECT query_id, chunk_id, 'unknown_chunk' AS rule FROM (SELECT query_id, chunk_id || 'x' AS chunk_id FROM bq_sparse WHERE rank = 2)
        UNION ALL SELECT query_id, chunk_id, 'duplicate_chunk' FROM bq_sparse WHERE rank = 3
        UNION ALL SELECT query_id, chunk_id, 'non_finite_score' FROM bq_sparse WHERE rank = 4)""", "bq_sparse"))
def rerank_score_checks(spark, folder):
    base = inp.run(spark, folder, "sparse").filter("rank <= 5")
    value = F.when(F.col("rank") == 4, F.lit(float("nan"))).otherwise(F.col("score"))
    name = F.when(F.col("rank") == 2, F.concat("chunk_id", F.lit("x"))).otherwise(F.col("chunk_id"))
    copies = F.explode(F.expr("array_repeat(1, case when rank = 3 then 2 else 1 end)"))
    return fusion.rerank_problems(base, base.select("query_id", name.alias("chunk_id"), value.alias("rerank_score"), copies.alias("c")).drop("c"))


@register("ranking_quality_by_mode", "J4, J5, J6, J25", sql(
    """SELECT mode, query_id, coalesce(g.n, 0) AS gold_count,
        CASE WHEN g.n > 0 THEN round(coalesce(h1, 0) / g.n, 6) ELSE 0 END AS recall_at_1,
        CASE WHEN g.n > 0 THEN round(coalesce(h3, 0) / g.n, 6) ELSE 0 END AS recall_at_3,
        CASE WHEN g.n > 0 THEN round(coalesce(h5, 0) / g.n, 6) ELSE 0 END AS recall_at_5,
        CASE WHEN g.n > 0 THEN round(coalesce(h10, 0) / g.n, 6) ELSE 0 END AS recall_at_10,
        round(coalesce(1.0 / fr, 0), 6) AS mrr,
        CASE WHEN g.n > 0 THEN round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(g.n, 10) + 1), lambda r: 1.0 / log2(r + 1))), 6) ELSE 0 END AS ndcg_at_10
       FROM (SELECT m.mode, q.query_id FROM bench_queries q, (VALUES ('sparse'), ('dense'), ('hybrid'), ('reranked')) m(mode)) s
       LEFT JOIN (SELECT query_id, count(*) AS n FROM qrels GROUP BY 1) g USING (query_id)
       LEFT JOIN (SELECT mode, query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5,
            count(*) FILTER (rank <= 10) AS h10, min(rank) AS fr, sum(1.0 / log2(rank + 1)) AS dcg
          FROM by_mode JOIN qrels USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY 1, 2) h USING (mode, query_id)""",
    "by_mode", "qrels", "bench_queries"))
def ranking_quality_by_mode(spark, folder):
    modes = F.explode(F.array(*[F.lit(m) for m in ("sparse", "dense", "hybrid", "reranked")]))
    samples = inp.queries(spark, folder).select(modes.alias("mode"), "query_id")
    results = by_mode(inp.all_modes(spark, folder))
    return metrics.ranking_metrics(samples, results, inp.fresh_qrels(spark, folder), ["mode", "query_id"])


def by_mode(lists):
    """All four result lists in one table; the first three keep ten rows, the reranked one six."""
    out = None
    for mode, df in lists.items():
        part = df.filter("rank <= 10").select(F.lit(mode).alias("mode"), "query_id", "chunk_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


inp.fragment("by_mode", """SELECT 'sparse' AS mode, query_id, chunk_id, rank FROM bq_sparse WHERE rank <= 10
    UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM bq_dense WHERE rank <= 10
    UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM bq_hybrid WHERE rank <= 10
    UNION ALL SELECT 'reranked', query_id, chunk_id, rank FROM bq_reranked""", "bq_sparse", "bq_dense", "bq_hybrid", "bq_reranked")
