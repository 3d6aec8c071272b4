"""Inputs every query shares, derived from the given tables, with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.functions.identity import content_hash, joined_hash
from citeloom.operators import chunking, fusion, lexical, vectors
from citeloom.plans import corpus_store
from citeloom.queries.base import fragment
from citeloom.session import checkpoint_root

DIM = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; a file with fewer splits than cores is spread, larger inputs are left alone."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in HEAVY_TEXT and df.rdd.getNumPartitions() < cores // 2:
        return df.repartition(cores)
    return df


HEAVY_TEXT = {"documents", "pages", "conversations"}
# Passages are sent to the tasks up to this size.
PASSAGE_BYTES = 16 << 20
_STORES: dict[tuple[str, str], corpus_store.CorpusStore] = {}
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage result written once per session to the shared folder, for the stages that read it."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _TABLES:
        path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def store(spark: SparkSession, folder: str) -> corpus_store.CorpusStore:
    """The retrieval tables of ``documents``, written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORES:
        root = f"{checkpoint_root(spark)}/corpus-{uuid.uuid4().hex}"
        corpus_store.build(docs(spark, folder), root, dim=DIM)
        _STORES[key] = corpus_store.load(spark, root)
    return _STORES[key]


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as ingested text files."""
    return as_documents(table(spark, folder, "documents"))


def as_documents(rows: DataFrame) -> DataFrame:
    uri = F.concat(F.lit("file://data/raw/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    base = rows.select(
        "doc_id", "lang", "source", uri.alias("source_uri"), F.col("doc_id").cast("string").alias("title"),
        F.regexp_replace("text", "\r\n?", "\n").alias("raw"),
    )
    hashed = base.withColumn("content_sha256", content_hash(F.col("raw")))
    return hashed.select(
        "doc_id", "lang", "source", "source_uri", "title", F.lit("text").alias("source_type"), "content_sha256",
        joined_hash(F.col("source_uri"), F.col("content_sha256")).alias("document_id"),
        tx.strip(F.col("raw")).alias("text"),
    ).filter(F.col("text") != "")


def fresh_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks made from the documents, without the store."""
    return chunking.word_windows(docs(spark, folder))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return store(spark, folder).chunks


def queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), tx.strip(F.col("text")).alias("query")
    )


def qrels(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "qrels", lambda: fresh_qrels(spark, folder))


def fresh_qrels(spark: SparkSession, folder: str) -> DataFrame:
    """Gold chunks: those holding the passage word for word."""
    return passage_matches(queries(spark, folder), chunks(spark, folder))


def _run_hash(of_words: bool, n: Column) -> Callable[[Column], Column]:
    return lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ") if of_words else F.substr("w", i, n))


def passage_matches(asked: DataFrame, base: DataFrame, most: int = PASSAGE_BYTES) -> DataFrame:
    """``query_id, chunk_id`` where the chunk's ``text`` contains the ``query``.

    A run of the passage is looked up among the runs of the text and then verified, so no passage is compared
    with a chunk that cannot hold it. The run has up to five inner words (first and last word may be parts of
    words in the text). A query without a whole inner word is anchored on its first eight characters instead;
    the lengths in use are at most thirteen numbers. Passages of up to ``most`` bytes go to the tasks, one scan of
    the chunks; more are met through an equi-join on a hash of the run.
    """
    asked = asked.filter("query <> ''").select("query_id", "query")
    if (asked.agg(F.sum(F.octet_length("query") + 64).alias("bytes")).head().bytes or 0) <= most:
        kinds = [f"{df.schema[c].name} {df.schema[c].dataType.simpleString()}" for df, c in ((asked, "query_id"), (base, "chunk_id"))]
        held = base.filter("chunk_id is not null and text is not null").select("chunk_id", "text")
        return held.mapInArrow(_passages_in(asked.toArrow()), ", ".join(kinds)).distinct()
    return _joined_passages(asked, base)


def _passages_in(asked: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    ids, passages = asked.column("query_id").combine_chunks(), asked.column("query").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word: dict[str, dict[int, dict[str, list[int]]]] = {}  # first word of a run, its words, the run
        by_start: dict[int, dict[str, list[int]]] = {}
        for i, passage in enumerate(passages):
            inner = passage.split()[1:-1][:5]
            runs = by_word.setdefault(inner[0], {}) if inner else by_start
            key = " ".join(inner) if inner else passage[:8]
            runs.setdefault(len(inner) or len(key), {}).setdefault(key, []).append(i)

        def near(text: str) -> set[int]:
            words, found = text.split(), set()
            for at, word in enumerate(words):
                for n, runs in by_word.get(word, {}).items():
                    found.update(runs.get(" ".join(words[at : at + n]), ()))
            for n, runs in by_start.items():
                for key in {text[at : at + n] for at in range(len(text) - n + 1)} & runs.keys():
                    found.update(runs[key])
            return found

        for batch in batches:
            pairs = [(i, row) for row, text in enumerate(batch.column("text").to_pylist()) for i in near(text) if passages[i] in text]
            which, rows = zip(*pairs) if pairs else ((), ())
            columns = [ids.take(pa.array(which, pa.int64())), batch.column("chunk_id").take(pa.array(rows, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id"])

    return run


def _joined_passages(asked: DataFrame, base: DataFrame) -> DataFrame:
    w = tx.words(F.col("query"))
    inner = F.size(w) >= 3
    size = F.when(inner, F.least(F.size(w) - 2, F.lit(5))).otherwise(F.least(F.length("query"), F.lit(8)))
    key = F.when(inner, F.array_join(F.slice(w, 2, size), " ")).otherwise(F.substr("query", F.lit(1), size))
    anchors = asked.select("query_id", "query", inner.alias("inner"), size.alias("size"), F.xxhash64(key).alias("h"))
    runs = None
    for used in anchors.select("inner", "size").distinct().collect():
        units = base.select("chunk_id", (tx.words(F.col("text")) if used.inner else F.col("text")).alias("w"))
        count, n = F.size("w") if used.inner else F.length("w"), F.lit(used["size"])
        keys = F.array_distinct(F.transform(F.sequence(F.lit(1), count - n + 1), _run_hash(used.inner, n)))
        # The outer form on purpose: for the inner one Spark infers a filter that cuts every text a second time.
        part = units.select("chunk_id", F.lit(used.inner).alias("inner"), n.alias("size"), F.explode_outer(F.when(count >= n, keys)).alias("h")).filter("h is not null")
        runs = part if runs is None else runs.unionByName(part)
    if runs is None:
        return asked.select("query_id").withColumn("chunk_id", F.lit("")).limit(0)
    # Only ids and hashes travel; texts are joined to the few pairs that share a run.
    pairs = runs.join(anchors, ["inner", "size", "h"]).select("query_id", "query", "chunk_id")
    return pairs.join(base.select("chunk_id", "text"), "chunk_id").filter(F.contains("text", "query")).select("query_id", "chunk_id").distinct()


def index(spark: SparkSession, folder: str) -> lexical.LexicalIndex:
    return store(spark, folder).index


def fresh_index(spark: SparkSession, folder: str) -> lexical.LexicalIndex:
    """The index built from the documents in one plan, without the store."""
    return lexical.build_index(fresh_chunks(spark, folder))


def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return store(spark, folder).vectors


def query_vectors(spark: SparkSession, folder: str, queries_df: DataFrame | None = None) -> DataFrame:
    q = queries(spark, folder) if queries_df is None else queries_df
    counted = lexical.query_terms(q).withColumnRenamed("qtf", "tf")
    return vectors.hashed_embedding(counted, "query_id", dim=DIM)


def sparse_top(spark: SparkSession, folder: str, k: int, q: DataFrame | None = None) -> DataFrame:
    return lexical.bm25_top_k(index(spark, folder), queries(spark, folder) if q is None else q, k)


def dense_top(spark: SparkSession, folder: str, k: int, q: DataFrame | None = None) -> DataFrame:
    return vectors.cosine_top_k(query_vectors(spark, folder, q), chunk_vectors(spark, folder), k)


def all_modes(spark: SparkSession, folder: str, q: DataFrame | None = None) -> dict[str, DataFrame]:
    """Top 20 of both legs, their fusion and the reranked best six; every leg is planned once."""
    q = queries(spark, folder) if q is None else q
    sparse, dense = sparse_top(spark, folder, 20, q), dense_top(spark, folder, 20, q)
    hybrid = fusion.reciprocal_rank_fusion(sparse, dense, 20)
    pairs = fusion.hydrate(hybrid, chunks(spark, folder), "text").join(q, "query_id")
    reranked = fusion.reorder(hybrid, fusion.overlap_scores(pairs), 6)
    return {"sparse": sparse, "dense": dense, "hybrid": hybrid, "reranked": reranked}


def run(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    """Stored results of the benchmark queries in one mode; fused results are read, not searched again."""
    if mode in ("sparse", "dense"):
        search = sparse_top if mode == "sparse" else dense_top
        return stored(spark, folder, f"run_{mode}", lambda: search(spark, folder, 20))
    if mode == "hybrid":
        legs = run(spark, folder, "sparse"), run(spark, folder, "dense")
        return stored(spark, folder, "run_hybrid", lambda: fusion.reciprocal_rank_fusion(*legs, 20))
    hybrid = run(spark, folder, "hybrid")

    def rerank() -> DataFrame:
        pairs = fusion.hydrate(hybrid, chunks(spark, folder), "text").join(queries(spark, folder), "query_id")
        return fusion.reorder(hybrid, fusion.overlap_scores(pairs), 6)

    return stored(spark, folder, "run_reranked", rerank)


def runs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {mode: run(spark, folder, mode) for mode in ("sparse", "dense", "hybrid", "reranked")}


def hybrid_top(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, "hybrid")


def reranked_top(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, "reranked")


# ---------------------------------------------------------------- SQL twins

WS = tx.SPACE
TOKEN_SQL = tx.TOKEN_PATTERN
STOP_SQL = "[" + ",".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_words(expr: str) -> str:
    return f"regexp_extract_all({expr}, '[^{WS}]+')"


def sql_tokens(expr: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all(lower({expr}), '{TOKEN_SQL}'), lambda x: rtrim(x, '.')), "
        f"lambda x: x <> '' AND NOT list_contains({STOP_SQL}, x))"
    )


def sql_ascii_words(expr: str) -> str:
    mixed = rf"[{tx.WORD}]*(?:[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}])[{tx.WORD}]*"
    return (
        f"regexp_extract_all(regexp_replace({expr}, '{mixed}', chr(1), 'g'), "
        "'[a-zA-Z0-9_](?:[a-zA-Z0-9_-]*[a-zA-Z0-9_])?')"
    )


fragment(
    "docs_raw",
    f"""SELECT doc_id, lang, source, 'file://data/raw/' || source || '/' || doc_id || '.txt' AS source_uri,
        CAST(doc_id AS VARCHAR) AS title, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS raw FROM documents""",
)
fragment(
    "docs",
    f"""SELECT doc_id, lang, source, source_uri, title, 'text' AS source_type, sha256(raw) AS content_sha256,
        sha256(source_uri || ':' || sha256(raw)) AS document_id, {sql_strip('raw')} AS text
        FROM docs_raw WHERE {sql_strip('raw')} <> ''""",
    "docs_raw",
)
fragment(
    "windows",
    f"""SELECT doc_id, document_id, title, source_uri, source_type, source, lang, p, i AS ordinal,
        regexp_replace(array_to_string(p[i*540+1 : i*540+600], ''), '[{WS}]+$', '') AS text,
        CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(p[1 : i*540], '')) END AS start_char,
        len(p[i*540+1 : i*540+600]) AS words
        FROM (SELECT *, unnest(range(CAST(greatest(1, ceil((len(p) - 60) / 540.0)) AS BIGINT))) AS i
              FROM (SELECT *, regexp_extract_all(text, '[^{WS}]+[{WS}]*') AS p FROM docs))""",
    "docs",
)
fragment(
    "chunks",
    """SELECT doc_id, document_id, title, source_uri, source_type, source, lang, ordinal, text, start_char,
        start_char + length(text) AS end_char, words AS token_estimate,
        sha256(document_id || ':' || ordinal || ':' || text) AS chunk_id FROM windows""",
    "windows",
)
fragment(
    "bench_queries",
    f"SELECT item_id AS query_id, {sql_strip('text')} AS query FROM benchmark",
)
fragment(
    "qrels",
    """SELECT q.query_id, c.chunk_id FROM bench_queries q JOIN chunks c ON contains(c.text, q.query)""",
    "bench_queries", "chunks",
)
fragment(
    "chunk_tokens",
    f"SELECT chunk_id, document_id, ordinal, {sql_tokens('text')} AS toks FROM chunks",
    "chunks", stored=True,
)
fragment("chunk_stats", "SELECT chunk_id, document_id, ordinal, len(toks) AS dl FROM chunk_tokens", "chunk_tokens")
fragment(
    "postings",
    """SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM chunk_tokens)
        GROUP BY chunk_id, term""",
    "chunk_tokens", stored=True,
)
fragment("corpus_meta", "SELECT count(*) AS n, avg(dl) AS avgdl FROM chunk_stats", "chunk_stats")
fragment(
    "raw_idf",
    """SELECT term, nd, ln(n - nd + 0.5) - ln(nd + 0.5) AS raw
        FROM (SELECT term, count(*) AS nd FROM postings GROUP BY term), corpus_meta""",
    "postings", "corpus_meta", stored=True,
)
fragment(
    "term_stats",
    """SELECT term, nd, CASE WHEN raw < 0 THEN avg(raw) OVER () * 0.25 ELSE raw END AS idf
        FROM raw_idf""",
    "raw_idf",
)


def search_fragments(prefix: str, queries_cte: str, *, k_leg: int = 20) -> None:
    """Sparse, dense, fused and reranked result CTEs for one query table ``(query_id, query)``."""
    p = prefix
    fragment(
        f"{p}_terms",
        f"""SELECT query_id, term, count(*) AS qtf
            FROM (SELECT query_id, unnest({sql_tokens('query')}) AS term FROM {queries_cte}) GROUP BY query_id, term""",
        queries_cte,
    )
    fragment(
        f"{p}_bm25",
        f"""SELECT t.query_id, po.chunk_id, round(sum(ts.idf * t.qtf * (po.tf * 2.5)
                / (po.tf + 1.5 * (0.25 + 0.75 * cs.dl / m.avgdl))), 9) AS score
            FROM {p}_terms t JOIN term_stats ts USING (term) JOIN postings po USING (term)
            JOIN chunk_stats cs USING (chunk_id), corpus_meta m GROUP BY t.query_id, po.chunk_id""",
        f"{p}_terms", "term_stats", "postings", "chunk_stats", "corpus_meta",
    )
    fragment(
        f"{p}_sparse",
        f"""SELECT * FROM (SELECT q.query_id, c.chunk_id, c.document_id, c.ordinal, coalesce(b.score, 0) AS score,
                row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(b.score, 0) DESC, c.document_id, c.ordinal) AS rank
            FROM (SELECT DISTINCT query_id FROM {p}_terms) q CROSS JOIN chunk_stats c
            LEFT JOIN {p}_bm25 b ON b.query_id = q.query_id AND b.chunk_id = c.chunk_id) WHERE rank <= {k_leg}""",
        f"{p}_bm25", "chunk_stats",
    )
    slot = f"(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {DIM})"
    if "chunk_dims" not in _DIMS:
        fragment(
            "chunk_dims",
            f"SELECT chunk_id, {slot} AS d, sum(tf) AS w FROM postings GROUP BY chunk_id, {slot}",
            "postings",
        )
        fragment("chunk_norms", "SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM chunk_dims GROUP BY chunk_id", "chunk_dims")
        _DIMS.add("chunk_dims")
    fragment(
        f"{p}_dims",
        f"SELECT query_id, {slot} AS d, sum(qtf) AS w FROM {p}_terms GROUP BY query_id, {slot}",
        f"{p}_terms",
    )
    fragment(f"{p}_norms", f"SELECT query_id, sqrt(sum(w * w)) AS norm FROM {p}_dims GROUP BY query_id", f"{p}_dims")
    fragment(
        f"{p}_cosine",
        f"""SELECT qn.query_id, cn.chunk_id, round(coalesce(x.dot, 0) / (qn.norm * cn.norm), 9) AS score
            FROM {p}_norms qn CROSS JOIN chunk_norms cn
            LEFT JOIN (SELECT query_id, chunk_id, sum(q.w * c.w) AS dot FROM {p}_dims q JOIN chunk_dims c USING (d)
                       GROUP BY query_id, chunk_id) x
              ON x.query_id = qn.query_id AND x.chunk_id = cn.chunk_id""",
        f"{p}_norms", f"{p}_dims", "chunk_norms", "chunk_dims",
    )
    fragment(
        f"{p}_dense",
        f"""SELECT * FROM (SELECT query_id, chunk_id, score,
                row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {p}_cosine)
            WHERE rank <= {k_leg}""",
        f"{p}_cosine",
    )
    fragment(
        f"{p}_hybrid",
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC,
                least(sparse_rank, dense_rank), chunk_id) AS rank
            FROM (SELECT coalesce(s.query_id, d.query_id) AS query_id, coalesce(s.chunk_id, d.chunk_id) AS chunk_id,
                s.rank AS sparse_rank, d.rank AS dense_rank, s.score AS sparse_score, d.score AS dense_score,
                coalesce(1.0 / (60 + s.rank), 0) + coalesce(1.0 / (60 + d.rank), 0) AS score
              FROM {p}_sparse s FULL OUTER JOIN {p}_dense d ON s.query_id = d.query_id AND s.chunk_id = d.chunk_id))
            WHERE rank <= 20""",
        f"{p}_sparse", f"{p}_dense",
    )
    fragment(
        f"{p}_overlap",
        f"""SELECT h.query_id, h.chunk_id,
                len(list_intersect(list_distinct({sql_tokens('q.query')}), t.toks)) / greatest(len(list_distinct({sql_tokens('q.query')})), 1) AS rerank_score
            FROM {p}_hybrid h JOIN {queries_cte} q USING (query_id) JOIN chunk_tokens t USING (chunk_id)""",
        f"{p}_hybrid", queries_cte, "chunk_tokens",
    )
    fragment(
        f"{p}_reranked",
        f"""SELECT * FROM (SELECT h.query_id, h.chunk_id, h.rank AS retrieval_rank, h.score AS retrieval_score, o.rerank_score,
                row_number() OVER (PARTITION BY h.query_id ORDER BY round(o.rerank_score, 12) DESC, h.rank, h.chunk_id) AS rank
            FROM {p}_hybrid h JOIN {p}_overlap o USING (query_id, chunk_id)) WHERE rank <= 6""",
        f"{p}_hybrid", f"{p}_overlap",
    )


_DIMS: set[str] = set()
search_fragments("bq", "bench_queries")
