"""Evidence operators over the reranked results of every benchmark query."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators import evidence as ev
from citeloom.operators import fusion
from citeloom.queries import inputs as inp
from citeloom.queries.base import fragment, register, sql


def evidence_rows(spark, folder):
    """The six reranked chunks of each query, joined with their text."""
    best = inp.reranked_top(spark, folder).select("query_id", "chunk_id", F.col("rank").alias("position"), "rerank_score", "retrieval_rank", "retrieval_score")
    return fusion.hydrate(best, inp.chunks(spark, folder), "document_id", "doc_id", "title", "source_uri", "text")


fragment("evid", """SELECT r.query_id, r.chunk_id, r.rank AS position, r.rerank_score, r.retrieval_rank, r.retrieval_score, c.document_id, c.doc_id, c.title, c.source_uri, c.text
    FROM bq_reranked r JOIN chunks c USING (chunk_id)""", "bq_reranked", "chunks")


def claim_rows(spark, folder):
    """Evidence whose text ends in statements that differ from document to document."""
    return evidence_rows(spark, folder).withColumn(
        "text",
        F.concat(
            "text", F.lit(".\nThe cache timeout is "), F.col("doc_id") % 4, F.lit(" seconds. The cache timeout is "), F.col("doc_id") % 3,
            F.lit(" seconds. Live reload is "), F.when(F.col("doc_id") % 2 == 0, "supported").otherwise("not supported"),
            F.lit(". Old sync is "), F.when(F.col("doc_id") % 5 == 0, "disabled").otherwise("deprecated"),
            F.lit(".\n```\nretry limit is 9\n```\nsize: int = 4 and depth is 8\n"),
        ),
    )


CLAIM_SQL = """text || '.' || chr(10) || 'The cache timeout is ' || doc_id % 4 || ' seconds. The cache timeout is ' || doc_id % 3 || ' seconds. Live reload is '
    || CASE WHEN doc_id % 2 = 0 THEN 'supported' ELSE 'not supported' END || '. Old sync is ' || CASE WHEN doc_id % 5 = 0 THEN 'disabled' ELSE 'deprecated' END
    || '.' || chr(10) || '```' || chr(10) || 'retry limit is 9' || chr(10) || '```' || chr(10) || 'size: int = 4 and depth is 8' || chr(10)"""
FENCE_SQL = ev.FENCES
NUM_SQL = ev.NUMERIC_CLAIM.replace("(?iU)", "(?i)")
SUP_SQL = ev.SUPPORT_CLAIM.replace("(?iU)", "(?i)")
TYPED_SQL = ev.TYPED_ASSIGNMENT.replace("(?mU)", "(?m)")


def prose_sql(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '{FENCE_SQL}', '', 'g'), '{TYPED_SQL}', '', 'g')"


def claims_fragments(prefix: str, source: str, keys: str) -> None:
    fragment(f"{prefix}_prose", f"SELECT {keys}, {prose_sql('text')} AS p FROM {source}", source)
    fragment(
        f"{prefix}_numeric",
        f"""SELECT {keys}, attribute, unit, arg_max(value, pos) AS value FROM (
            SELECT {keys}, unnest(range(len(regexp_extract_all(p, '{NUM_SQL}', 1)))) AS pos,
              lower(unnest(regexp_extract_all(p, '{NUM_SQL}', 1))) AS attribute, unnest(regexp_extract_all(p, '{NUM_SQL}', 2)) AS value,
              lower(unnest(regexp_extract_all(p, '{NUM_SQL}', 3))) AS unit FROM {prefix}_prose) GROUP BY ALL""",
        f"{prefix}_prose",
    )
    fragment(
        f"{prefix}_support",
        f"""SELECT {keys}, feature, arg_max(status, pos) AS status FROM (
            SELECT {keys}, unnest(range(len(regexp_extract_all(p, '{SUP_SQL}', 1)))) AS pos, unnest(regexp_extract_all(p, '{SUP_SQL}', 1)) AS feature,
              lower(unnest(regexp_extract_all(p, '{SUP_SQL}', 2))) AS status FROM {prefix}_prose) GROUP BY ALL""",
        f"{prefix}_prose",
    )
    fragment(
        f"{prefix}_claims",
        f"""SELECT {keys}, 'numeric_attribute_conflict' AS kind, attribute || '|' || unit AS claim, CAST(CAST(value AS DOUBLE) AS VARCHAR) AS value FROM {prefix}_numeric
            UNION ALL SELECT {keys}, 'boolean_attribute_conflict', lower(feature), CASE WHEN contains(status, 'not') OR contains(status, 'disabled') THEN 'true' ELSE 'false' END FROM {prefix}_support""",
        f"{prefix}_numeric", f"{prefix}_support",
    )


fragment("claim_rows", f"SELECT query_id, chunk_id, position, {CLAIM_SQL} AS text FROM evid", "evid")
claims_fragments("cl", "claim_rows", "query_id, chunk_id, position")
fragment("claim_corpus", f"SELECT chunk_id, {CLAIM_SQL} AS text FROM chunks", "chunks")
claims_fragments("cc", "claim_corpus", "chunk_id")


@register("merged_route_evidence", "F1, F2", sql(
    """SELECT query_id, chunk_id, retrieval_rank, round(retrieval_score, 6) AS retrieval_score, retrieval_method, all_routes, document_id, contradictory,
        round(rerank_score, 6) AS rerank_score, 'C' || row_number() OVER (PARTITION BY query_id ORDER BY retrieval_rank, chunk_id) AS citation_id FROM (
        SELECT query_id, chunk_id, min(rank) AS retrieval_rank, arg_min(score, o) AS retrieval_score, arg_min(method, o) AS retrieval_method,
          string_agg(DISTINCT method, ',' ORDER BY method) AS all_routes, arg_min(document_id, o) AS document_id, count(DISTINCT title) > 1 AS contradictory,
          CASE WHEN count(*) > 1 AND max(rr) IS NOT NULL THEN greatest(max(rr), 0) ELSE max(rr) END AS rerank_score
        FROM (SELECT r.*, r.rank * 2 + (method = 'sparse')::INT AS o, c.document_id, CASE WHEN method = 'dense' AND r.rank % 5 = 0 THEN c.title || '*' ELSE c.title END AS title,
                CASE WHEN r.rank % 2 = 0 THEN r.score - 0.5 END AS rr
              FROM (SELECT query_id, chunk_id, rank, score, 'sparse' AS method FROM bq_sparse UNION ALL SELECT query_id, chunk_id, rank, score, 'dense' FROM bq_dense) r
              JOIN chunks c USING (chunk_id)) GROUP BY query_id, chunk_id)""", "bq_sparse", "bq_dense", "chunks"))
def merged_route_evidence(spark, folder):
    legs = [inp.run(spark, folder, m).select("query_id", "chunk_id", "rank", "score", F.lit(m).alias("method")) for m in ("sparse", "dense")]
    rows = fusion.hydrate(legs[0].unionByName(legs[1]), inp.chunks(spark, folder))
    rows = rows.withColumn("title", F.when((F.col("method") == "dense") & (F.col("rank") % 5 == 0), F.concat("title", F.lit("*"))).otherwise(F.col("title")))
    rows = rows.withColumn("rerank_score", F.when(F.col("rank") % 2 == 0, F.col("score") - 0.5))
    return ev.merge_routes(rows).select(
        "query_id", "chunk_id", "retrieval_rank", "retrieval_score", "retrieval_method", "all_routes", "document_id", "contradictory", "rerank_score", "citation_id"
    )


@register("prose_without_code", "F3", sql(
    f"SELECT query_id, chunk_id, length(p) AS chars, sha256(p) AS digest FROM cl_prose", "cl_prose"))
def prose_without_code(spark, folder):
    p = claim_rows(spark, folder).select("query_id", "chunk_id", ev.prose(F.col("text")).alias("p"))
    return p.select("query_id", "chunk_id", F.length("p").alias("chars"), F.sha2("p", 256).alias("digest"))


@register("numeric_claims", "F4", sql("SELECT chunk_id, attribute, unit, value FROM cc_numeric", "cc_numeric"))
def numeric_claims(spark, folder):
    return ev.numeric_claims(claim_corpus(spark, folder), "chunk_id")


@register("support_claims", "F5", sql(
    "SELECT chunk_id, feature, status, contains(status, 'not') OR contains(status, 'disabled') AS negated FROM cc_support", "cc_support"))
def support_claims(spark, folder):
    return ev.support_claims(claim_corpus(spark, folder), "chunk_id")


def claim_corpus(spark, folder):
    """Every chunk of the corpus with the differing statements appended."""
    base = inp.chunks(spark, folder)
    return base.select("chunk_id", "doc_id", F.concat(
        "text", F.lit(".\nThe cache timeout is "), F.col("doc_id") % 4, F.lit(" seconds. The cache timeout is "), F.col("doc_id") % 3,
        F.lit(" seconds. Live reload is "), F.when(F.col("doc_id") % 2 == 0, "supported").otherwise("not supported"),
        F.lit(". Old sync is "), F.when(F.col("doc_id") % 5 == 0, "disabled").otherwise("deprecated"),
        F.lit(".\n```\nretry limit is 9\n```\nsize: int = 4 and depth is 8\n"),
    ).alias("text"))


PAIRS_SQL = """SELECT DISTINCT a.query_id, a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, a.kind AS reason FROM cl_claims a JOIN cl_claims b
    ON a.query_id = b.query_id AND a.kind = b.kind AND a.claim = b.claim AND a.position < b.position AND a.value <> b.value"""
fragment("cl_pairs", PAIRS_SQL, "cl_claims")


@register("evidence_conflict_pairs", "F6", sql("SELECT * FROM cl_pairs", "cl_pairs"))
def evidence_conflict_pairs(spark, folder):
    return ev.conflict_pairs(claim_rows(spark, folder))


@register("evidence_conflict_scores", "F6", sql(
    """SELECT query_id, 0.75::DOUBLE AS conflict_score, count(DISTINCT chunk_a || chunk_b) AS conflicting_pairs, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons
       FROM cl_pairs GROUP BY query_id""", "cl_pairs"))
def evidence_conflict_scores(spark, folder):
    return ev.conflict_scores(ev.conflict_pairs(claim_rows(spark, folder)))


@register("corpus_claim_conflicts", "F6", sql(
    """SELECT kind, claim, count(*) AS distinct_values, sum(n)::BIGINT AS chunks, ((sum(n) * sum(n) - sum(n * n)) / 2)::BIGINT AS conflicting_pairs
       FROM (SELECT kind, claim, value, count(*) AS n FROM cc_claims GROUP BY ALL) GROUP BY kind, claim HAVING count(*) > 1""", "cc_claims"))
def corpus_claim_conflicts(spark, folder):
    return ev.corpus_conflicts(claim_corpus(spark, folder))


COVER_STOP = "[" + ",".join(f"'{w}'" for w in ev.COVERAGE_STOPWORDS) + "]"


def sufficiency_fragments(prefix: str, queries_cte: str, evidence_cte: str) -> None:
    p = prefix
    fragment(
        f"{p}_words",
        f"SELECT query_id, list_filter(list_transform({inp.sql_ascii_words('query')}, lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains({COVER_STOP}, w)) AS words FROM {queries_cte}",
        queries_cte,
    )
    fragment(
        f"{p}_texts",
        f"""SELECT query_id, string_agg(lower(text), ' ' ORDER BY position) AS everything, count(*) AS n, count(DISTINCT document_id) AS docs,
            avg(rerank_score) FILTER (position <= 5) AS rerank, min(retrieval_rank) FILTER (position = 1) AS first_rank,
            bool_or(position <= 5 AND regexp_matches(text, '{tx.bounded(ev.DEFINITE)}')) AS definite, bool_or(position <= 5 AND contains(text, '```')) AS code
            FROM {evidence_cte} GROUP BY query_id""",
        evidence_cte,
    )
    fragment(
        f"{p}_parts",
        f"""SELECT query_id, n, rerank, first_rank, docs, definite, code, CASE WHEN n IS NULL THEN 0 WHEN len(words) = 0 THEN 1 ELSE
              len(list_filter(words, lambda w: contains(everything, w) OR (ends_with(w, 's') AND length(w) > 3 AND contains(everything, w[1:length(w)-1])))) / len(words) END AS coverage
            FROM {p}_words LEFT JOIN {p}_texts USING (query_id)""",
        f"{p}_words", f"{p}_texts",
    )
    fragment(
        f"{p}_scores",
        f"""SELECT *, CASE WHEN n IS NULL THEN 0 ELSE greatest(0, least(1, 0.45::DOUBLE * relevance + 0.25::DOUBLE * coverage + 0.15::DOUBLE * diversity + 0.15::DOUBLE * answerability)) END AS score FROM (
            SELECT *, CASE WHEN n IS NULL THEN 0 WHEN rerank IS NOT NULL THEN greatest(0, least(1, rerank)) WHEN coverage = 0 THEN 0 ELSE greatest(0, least(1, 1.0::DOUBLE / first_rank)) END AS relevance,
              CASE WHEN n IS NULL THEN 0 WHEN n > 1 THEN least(1, docs / 2.0::DOUBLE) ELSE 0.7::DOUBLE END AS diversity,
              CASE WHEN coverage > 0 THEN least(1, 0.5::DOUBLE + CASE WHEN definite THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN code THEN 0.2::DOUBLE ELSE 0 END) ELSE 0 END AS answerability FROM {p}_parts)""",
        f"{p}_parts",
    )


sufficiency_fragments("su", "bench_queries", "evid")


@register("evidence_sufficiency", "F7", sql(
    """SELECT query_id, round(relevance, 6) AS relevance, round(coverage, 6) AS coverage, round(diversity, 6) AS diversity, round(answerability, 6) AS answerability,
        round(score, 6) AS score, CASE WHEN round(score, 9) >= 0.72 THEN 'sufficient' ELSE 'insufficient' END AS status, round(score, 9) < 0.35 AS low_evidence FROM su_scores""", "su_scores"))
def evidence_sufficiency(spark, folder):
    return ev.sufficiency(inp.queries(spark, folder), evidence_rows(spark, folder))


ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def esc(expr: str, quote: bool) -> str:
    out = ESC.format(expr)
    return f"replace(replace({out}, '\"', '&quot;'), chr(39), '&#x27;')" if quote else out


def pack_fragments(prefix: str, evidence_cte: str, *, limit: int, budget: int) -> None:
    p = prefix
    fragment(
        f"{p}_items",
        f"""SELECT query_id, chunk_id, '" chunk_id="' || {esc('chunk_id', True)} || '" title="' || {esc('title', True)} || '" source="' || {esc('source_uri', True)} || '">' || chr(10)
              || {esc('text', False)} || chr(10) || '</evidence>' || chr(10) AS rest,
            row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rerank_score, -1e300) DESC, retrieval_rank, chunk_id) AS n FROM {evidence_cte}""",
        evidence_cte,
    )
    head = ev.PACK_HEADER.replace("\n", "' || chr(10) || '")
    frame = len(ev.PACK_HEADER) + len(ev.PACK_FOOTER)
    fragment(
        f"{p}_fold",
        f"""SELECT DISTINCT query_id, 0::BIGINT AS n, {frame}::BIGINT AS used, 0::BIGINT AS taken, ''::VARCHAR AS sel, ''::VARCHAR AS om, ''::VARCHAR AS body FROM {p}_items
            UNION ALL SELECT f.query_id, i.n, CASE WHEN fits THEN f.used + size ELSE f.used END, CASE WHEN fits THEN f.taken + 1 ELSE f.taken END,
              CASE WHEN fits THEN f.sel || i.chunk_id || '|' ELSE f.sel END, CASE WHEN fits THEN f.om ELSE f.om || i.chunk_id || '|' END,
              CASE WHEN fits THEN f.body || '<evidence id="C' || (f.taken + 1) || i.rest ELSE f.body END
            FROM {p}_fold f JOIN {p}_items i ON i.query_id = f.query_id AND i.n = f.n + 1,
            LATERAL (SELECT length('<evidence id="C' || (f.taken + 1) || i.rest) AS size), LATERAL (SELECT f.taken < {limit} AND f.used + size <= {budget} AS fits)""",
        f"{p}_items",
    )
    fragment(
        f"{p}_packed",
        f"""SELECT query_id, rtrim(sel, '|') AS selected, rtrim(om, '|') AS omitted, CASE WHEN taken > 0 THEN '{head}' || body || '{ev.PACK_FOOTER}' ELSE '' END AS context
            FROM (SELECT *, max(n) OVER (PARTITION BY query_id) AS last FROM {p}_fold) WHERE n = last""",
        f"{p}_fold",
    )


pack_fragments("pk", "evid", limit=4, budget=12000)


@register("packed_context", "F8", sql(
    "SELECT query_id, selected, omitted, sha256(context) AS context_digest, length(context) AS total_characters FROM pk_packed", "pk_packed"))
def packed_context(spark, folder):
    out = ev.pack_context(evidence_rows(spark, folder), max_chunks=4, max_characters=12_000)
    return out.select(
        "query_id", F.array_join("selected", "|").alias("selected"), F.array_join("omitted", "|").alias("omitted"),
        F.sha2("context", 256).alias("context_digest"), "total_characters",
    )


def cited_answers(spark, folder):
    """Assistant turns as answers that cite evidence, some of them wrongly."""
    tail = (
        F.when(F.col("conv_id") % 6 == 0, " [C1] and [C2], again [C1].").when(F.col("conv_id") % 6 == 1, " [C9].")
        .when(F.col("conv_id") % 6 == 2, " [c1] [2] [citation 3].").when(F.col("conv_id") % 6 == 3, " [C 2] [C1].")
        .when(F.col("conv_id") % 6 == 4, " I am unable to answer.").otherwise(" [C3][C2] [C0].")
    )
    return inp.table(spark, folder, "conversations").filter("role = 'assistant'").select(
        F.concat_ws(":", "conv_id", "turn").alias("answer_id"), "conv_id", "turn", F.concat("text", tail).alias("answer")
    )


fragment("cited", """SELECT conv_id || ':' || turn AS answer_id, conv_id, turn, text || CASE conv_id % 6 WHEN 0 THEN ' [C1] and [C2], again [C1].' WHEN 1 THEN ' [C9].'
    WHEN 2 THEN ' [c1] [2] [citation 3].' WHEN 3 THEN ' [C 2] [C1].' WHEN 4 THEN ' I am unable to answer.' ELSE ' [C3][C2] [C0].' END AS answer FROM conversations WHERE role = 'assistant'""")
INLINE_SQL = "list_transform(list_sort(list_transform(list_distinct({0}), lambda c: {{'p': list_position({0}, c), 'c': c}})), lambda s: s.c)"
fragment("cited_ids", f"SELECT *, regexp_extract_all(answer, '{ev.CITATION}', 1) AS hits FROM cited", "cited")
fragment("cited_first", f"SELECT *, {INLINE_SQL.format('hits')} AS ids FROM cited_ids", "cited_ids")


@register("inline_citations", "F9, F12", sql(
    f"""SELECT answer_id, array_to_string(ids, ',') AS cited, regexp_matches(lower(answer), '{"|".join(ev.ABSTENTION_PHRASES)}') AS abstains FROM cited_first""", "cited_first"))
def inline_citations(spark, folder):
    a = cited_answers(spark, folder)
    return a.select("answer_id", F.array_join(ev.inline_citations(F.col("answer")), ",").alias("cited"), ev.says_abstain(F.col("answer")).alias("abstains"))


@register("citation_validation", "F10", sql(
    rf"""SELECT answer_id, array_to_string(list_concat(
        list_transform(list_filter(ids, lambda c: NOT list_contains(['C1','C2','C3'], c)), lambda c: 'unknown:' || c),
        CASE WHEN len(ids) = 0 THEN ['missing'] ELSE [] END,
        list_transform(list_filter(regexp_extract_all(answer, '{ev.MALFORMED}'), lambda t: NOT regexp_full_match(t, '{ev.CITATION}')), lambda t: 'malformed:' || t),
        CASE WHEN regexp_matches(regexp_replace(answer, '{ev.CITATION}', '', 'g'), '{ev.REMAINDER}') THEN ['malformed_remainder'] ELSE [] END), ';') AS errors FROM cited_first""", "cited_first"))
def citation_validation(spark, folder):
    allowed = F.array(F.lit("C1"), F.lit("C2"), F.lit("C3"))
    return cited_answers(spark, folder).select("answer_id", F.array_join(ev.citation_errors(F.col("answer"), allowed), ";").alias("errors"))


@register("package_citation_check", "F11", sql(
    rf"""SELECT answer_id, array_to_string(valid, ',') AS valid_evidence_ids, array_to_string(bad, ',') AS invalid_tokens, len(bad) = 0 AND len(valid) > 0 AS is_valid FROM (
        SELECT answer_id, list_transform(list_filter(u, lambda t: regexp_matches(t, '^\[C[12]\]$')), lambda t: 'ev-' || answer_id || '-' || t[3:3]) AS valid,
          list_filter(u, lambda t: NOT regexp_matches(t, '^\[C[12]\]$')) AS bad FROM (
          SELECT answer_id, {INLINE_SQL.format('toks')} AS u FROM (SELECT answer_id, regexp_extract_all(answer, '{ev.PACKAGE_TOKEN}') AS toks FROM cited)))""", "cited"))
def package_citation_check(spark, folder):
    a = cited_answers(spark, folder)
    n = F.explode(F.array(F.lit(1), F.lit(2))).alias("n")
    e = a.select(F.col("answer_id").alias("package_id"), n).select(
        "package_id", F.concat(F.lit("C"), F.col("n")).alias("citation_id"), F.concat_ws("-", F.lit("ev"), "package_id", "n").alias("evidence_id")
    )
    out = ev.package_citations(a.select(F.col("answer_id").alias("package_id"), "answer"), e)
    return out.select(
        F.col("package_id").alias("answer_id"), F.array_join("valid_evidence_ids", ",").alias("valid_evidence_ids"),
        F.array_join("invalid_tokens", ",").alias("invalid_tokens"), "is_valid",
    )


@register("citation_excerpts", "F13", sql(
    """SELECT a.query_id, 'C' || e.position AS citation_id, a.place, e.chunk_id, e.document_id, e.title, substr(e.text, 1, 300) AS excerpt
       FROM (SELECT query_id, unnest([0, 1]) AS place, unnest([query_id % 3 + 1, 5]) AS c FROM bench_queries) a JOIN evid e ON e.query_id = a.query_id AND e.position = a.c""", "bench_queries", "evid"))
def citation_excerpts(spark, folder):
    answers = inp.queries(spark, folder).select("query_id", F.concat(F.lit("As [C"), F.col("query_id") % 3 + 1, F.lit("] and [C5] say.")).alias("answer"))
    e = evidence_rows(spark, folder).withColumn("citation_id", F.concat(F.lit("C"), F.col("position")))
    return ev.citation_excerpts(answers, e)


@register("evidence_projection", "E10", sql(
    """SELECT query_id, chunk_id, document_id, 'reranked' AS retrieval_method, position AS retrieval_rank, round(retrieval_score, 6) AS retrieval_score,
        CASE WHEN position % 3 = 0 THEN NULL ELSE round(rerank_score, 4) END AS rerank_score, 'C' || position AS citation_id FROM evid""", "evid"))
def evidence_projection(spark, folder):
    value = F.when(F.col("position") % 3 == 0, "not a number").otherwise(F.round("rerank_score", 4).cast("string"))
    rows = evidence_rows(spark, folder).withColumn("metadata", F.create_map(F.lit("rerank_score"), value)).withColumns(
        {"method": F.lit("reranked"), "rank": F.col("position"), "score": F.col("retrieval_score")}
    )
    return fusion.to_evidence(rows).select(
        "query_id", "chunk_id", "document_id", "retrieval_method", "retrieval_rank", "retrieval_score", "rerank_score", "citation_id"
    )


@register("chunk_and_source_lookup", "E7, E8, E9", sql(
    """SELECT w.chunk_id, coalesce(c.chunk_id IS NOT NULL, false) AS found, c.ordinal, d.source_uri, d.source_type, d.content_sha256 FROM (
        SELECT chunk_id FROM chunks WHERE ordinal = 1 UNION SELECT 'no-' || query_id FROM bench_queries) w LEFT JOIN chunks c USING (chunk_id) LEFT JOIN docs d ON d.document_id = c.document_id""",
    "chunks", "docs", "bench_queries"))
def chunk_and_source_lookup(spark, folder):
    base = inp.chunks(spark, folder)
    ids = base.filter("ordinal = 1").select("chunk_id").unionByName(inp.queries(spark, folder).select(F.concat(F.lit("no-"), "query_id").alias("chunk_id")))
    got = fusion.lookup(ids, base.select("chunk_id", "document_id", "ordinal"), "chunk_id")
    sources = inp.store(spark, folder).documents.select("document_id", "source_uri", "source_type", "content_sha256")
    return got.join(sources, "document_id", "left").select("chunk_id", "found", "ordinal", "source_uri", "source_type", "content_sha256")


@register("uniform_hits", "H13", sql(
    """SELECT CAST(conv_id AS VARCHAR) AS query_id, CASE WHEN turn % 3 = 0 THEN 'c_' || (turn + 1) ELSE 'h' || turn END AS chunk_id,
        CASE WHEN turn % 4 = 0 THEN 'doc' ELSE role END AS document_id, CASE WHEN turn % 5 = 0 THEN 'placeholder text' ELSE text END AS text,
        CASE WHEN turn % 4 = 0 THEN 'doc' ELSE role END AS title, turn + 1 AS rank, CASE WHEN turn % 2 = 0 THEN 1.0::DOUBLE ELSE turn / 4.0::DOUBLE END AS score, 'dense' AS method FROM conversations"""))
def uniform_hits(spark, folder):
    c = inp.table(spark, folder, "conversations")
    hits = c.select(
        F.col("conv_id").cast("string").alias("query_id"), F.when(F.col("turn") % 3 != 0, F.concat(F.lit("h"), "turn")).alias("chunk_id"),
        F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("role")).alias("document_id"),
        F.when(F.col("turn") % 5 == 0, "  ").otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("title"),
        (F.col("turn") + 1).alias("position"), F.when(F.col("turn") % 2 == 0, "n/a").otherwise((F.col("turn") / 4).cast("string")).alias("score"), F.lit("dense").alias("method"),
    )
    return fusion.uniform_hits(hits)


@register("web_hit_candidates", "E11", sql(
    """SELECT page_id, u, rank, problem, candidate_id FROM (
        SELECT page_id, u, rank, CASE WHEN u NOT LIKE 'https://%' THEN 'not_https' WHEN contains(u, '@') THEN 'credentials' WHEN contains(u, '#') THEN 'fragment'
            WHEN hp = '' THEN 'no_host' WHEN contains(hp, ':') AND regexp_extract(hp, '^[^:]*:(.*)$', 1) <> '443' THEN 'port'
            WHEN regexp_matches(split_part(hp, ':', 1), '^\\d+(\\.\\d+){3}$') THEN 'ip_literal' END AS problem,
          'cand_web_' || rank || '_' || substr(sha256(snippet), 1, 8) AS candidate_id FROM (
          SELECT page_id, u, snippet, regexp_extract(substr(u, 9), '^[^/?]*') AS hp, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) AS rank FROM (
            SELECT page_id, CASE page_id % 11 WHEN 0 THEN ' ' WHEN 1 THEN 'https://user@host.org/' WHEN 2 THEN 'https://10.0.0.7/x' WHEN 3 THEN 'https://host.org:8443/x'
               WHEN 4 THEN 'https:///x' WHEN 5 THEN 'https://host.org:443/y' ELSE replace(url, 'http://', 'https://') END AS u, CASE WHEN page_id % 13 = 5 THEN '' ELSE html END AS snippet FROM pages)
          WHERE trim(u) <> '' AND snippet <> ''))"""))
def web_hit_candidates(spark, folder):
    m = F.col("page_id") % 11
    url = (
        F.when(m == 0, " ").when(m == 1, "https://user@host.org/").when(m == 2, "https://10.0.0.7/x").when(m == 3, "https://host.org:8443/x")
        .when(m == 4, "https:///x").when(m == 5, "https://host.org:443/y").otherwise(F.replace("url", F.lit("http://"), F.lit("https://")))
    )
    hits = inp.table(spark, folder, "pages").select(
        (F.col("page_id") % 40).alias("query_id"), F.lit("t").alias("title"), url.alias("url"),
        F.when(F.col("page_id") % 13 == 5, "").otherwise(F.col("html")).alias("snippet"), F.col("page_id").alias("position"),
    )
    good, bad = fusion.web_candidates(hits, "web_search")
    back = hits.select("query_id", "position").withColumn("page_id", F.col("position"))
    keyed = hits.filter(~tx.is_blank(F.col("url")) & (F.col("snippet") != "")).select("query_id", "position", "url")
    from pyspark.sql import Window

    place = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))
    both = good.select("query_id", "rank", "candidate_id", F.lit(None).cast("string").alias("problem")).unionByName(
        bad.select("query_id", "rank", F.lit(None).cast("string").alias("candidate_id"), "problem")
    )
    joined = place.join(both, ["query_id", "rank"])
    text = hits.select("position", "snippet")
    full = joined.join(text, "position")
    identifier = F.concat_ws("_", F.lit("cand_web"), "rank", F.substring(F.sha2("snippet", 256), 1, 8))
    return full.select(F.col("position").alias("page_id"), F.col("url").alias("u"), "rank", "problem", F.coalesce("candidate_id", identifier).alias("candidate_id"))


@register("corpus_result_candidates", "E12", sql(
    """SELECT query_id, chunk_id AS candidate_id, 'local_document' AS source_kind, 'corpus_docs' AS source_id, document_id, title, '' AS section, source_uri AS source_label, 'hybrid' AS retrieval_route, h.rank, round(h.score, 6) AS score, sha256(text) AS text_digest
       FROM bq_hybrid h JOIN chunks c USING (chunk_id) WHERE h.rank <= 6""", "bq_hybrid", "chunks"))
def corpus_result_candidates(spark, folder):
    top = inp.hybrid_top(spark, folder).filter("rank <= 6").select("query_id", "chunk_id", "rank", "score", F.lit("hybrid").alias("method"), F.lit(None).cast("string").alias("heading_path"))
    out = fusion.corpus_candidates(fusion.hydrate(top, inp.chunks(spark, folder)), "corpus_docs")
    return out.select("query_id", "candidate_id", "source_kind", "source_id", "document_id", "title", "section", "source_label", "retrieval_route", "rank", "score", F.sha2("text", 256).alias("text_digest"))
