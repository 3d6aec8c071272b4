"""Context packages, their compression and answers, for every benchmark question."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators import answers as an
from citeloom.operators import compression as co
from citeloom.operators import fusion
from citeloom.operators import packages as pk
from citeloom.queries import control
from citeloom.queries import inputs as inp
from citeloom.queries.base import fragment, register, sql

POLICY = pk.PackagePolicy(max_items=4, max_chars=12_000, max_tokens=2_600)
SQUEEZE = co.CompressionPolicy(target_chars=1_600, target_tokens=400, max_sentences=3, deduplicate=True, allow_drop=True)
_reasons = ("invalid_profile", "web_call_budget_exhausted", "local_source_unavailable", "external_query_not_allowed")


def package_requests(spark, folder):
    m = F.col("query_id") % 8
    reason = F.element_at(F.array(*[F.lit(r) for r in _reasons]), ((F.col("query_id") / 8).cast("int") % 4 + 1))
    return inp.queries(spark, folder).select(
        "query_id", F.concat(F.lit("  "), "query", F.lit("\n")).alias("query"),
        F.when(m == 7, "blocked").otherwise("local").alias("route"), F.when(m != 7, "corpus_docs").alias("source_id"),
        F.when(m == 7, reason).otherwise("default_local").alias("reasons"), F.lit("local_only").alias("execution_profile"),
        F.lit(1).alias("max_retrieval_calls"), F.lit(0).alias("max_web_calls"), F.lit(0).alias("max_cost"),
    )


def packages(spark, folder):
    return inp.stored(spark, folder, "packages", lambda: fresh_packages(spark, folder))


def fresh_packages(spark, folder):
    """Packages of the fused results; the first two items of some queries are exact copies."""
    top = inp.hybrid_top(spark, folder).select(
        "query_id", "chunk_id", "rank", "score", F.lit("hybrid").alias("method"), F.lit(None).cast("string").alias("heading_path")
    )
    cand = fusion.corpus_candidates(fusion.hydrate(top, inp.chunks(spark, folder)), "corpus_docs")
    again = cand.filter("rank = 1 and query_id % 3 = 0").withColumns({"candidate_id": F.concat("candidate_id", F.lit("-copy")), "rank": F.lit(0)})
    shifted = cand.withColumn("rank", F.col("rank").cast("int")).unionByName(again).withColumn("rank", F.col("rank") + 1)
    short = shifted.filter("query_id % 8 <> 5")
    return pk.build_packages(package_requests(spark, folder), short, POLICY)


_r = "[" + ",".join(f"'{r}'" for r in _reasons) + "]"
fragment("pkg_requests", f"""SELECT query_id, '  ' || query || chr(10) AS raw, {inp.sql_strip('query')} AS normalized, query_id % 8 = 7 AS blocked,
    CASE WHEN query_id % 8 = 7 THEN {_r}[(query_id // 8) % 4 + 1] ELSE 'default_local' END AS reasons FROM bench_queries""", "bench_queries")
fragment("pkg_candidates", """SELECT query_id, candidate_id, rank + 1 AS rank, document_id, chunk_id, title, source_label, text, score FROM (
    SELECT h.query_id, h.chunk_id AS candidate_id, h.rank, c.document_id, c.chunk_id, c.title, c.source_uri AS source_label, c.text, h.score FROM bq_hybrid h JOIN chunks c USING (chunk_id)
    UNION ALL SELECT h.query_id, h.chunk_id || '-copy', 0, c.document_id, c.chunk_id, c.title, c.source_uri, c.text, h.score FROM bq_hybrid h JOIN chunks c USING (chunk_id) WHERE h.rank = 1 AND h.query_id % 3 = 0)
    WHERE query_id % 8 NOT IN (5, 7)""", "bq_hybrid", "chunks")
BLOCK = "'Source: ' || source_label || chr(10) || 'Title: ' || title || chr(10) || 'Section: ' || chr(10) || 'Content:' || chr(10) || {0} || chr(10) || chr(10) || '[END '"
fragment("pkg_items", f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, length({BLOCK.format('text')}) + 8 AS block_chars FROM pkg_candidates""", "pkg_candidates")
_H = len(pk.HEADER)
fragment("pkg_fold", f"""SELECT query_id, 0::BIGINT AS n, {_H}::BIGINT AS used, 0::BIGINT AS taken, []::BIGINT[] AS sel FROM pkg_requests
    UNION ALL SELECT f.query_id, i.n, CASE WHEN fits THEN size ELSE f.used END, CASE WHEN fits THEN f.taken + 1 ELSE f.taken END, CASE WHEN fits THEN list_append(f.sel, i.n) ELSE f.sel END
    FROM pkg_fold f JOIN pkg_items i ON i.query_id = f.query_id AND i.n = f.n + 1, LATERAL (SELECT f.used + i.block_chars + 2 AS size),
    LATERAL (SELECT f.taken < 4 AND size <= 12000 AND ceil(size / 4.0) <= 2600 AS fits)""", "pkg_requests", "pkg_items")
fragment("pkg_final", "SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY query_id) AS last FROM pkg_fold) WHERE n = last", "pkg_fold")
fragment("pkg_evidence", """SELECT i.*, list_position(f.sel, i.n) AS cite FROM pkg_final f JOIN pkg_items i ON i.query_id = f.query_id AND list_contains(f.sel, i.n)""", "pkg_final", "pkg_items")
fragment("pkg_text", f"""SELECT query_id, '{pk.HEADER}' || chr(10) || chr(10) || string_agg('[C' || cite || ']' || chr(10) || {BLOCK.format('text')} || 'C' || cite || ']', chr(10) || chr(10) ORDER BY cite) AS context_text,
    string_agg(candidate_id || ':C' || cite || ':' || substr(sha256(text), 1, 16), ',' ORDER BY cite) AS prints FROM pkg_evidence GROUP BY query_id""", "pkg_evidence")
fragment("pkg", f"""SELECT r.query_id, sha256(normalized) AS query_hash, length(raw) AS query_length, normalized, coalesce(context_text, '') AS context_text, length(coalesce(context_text, '')) AS context_chars,
    ceil(length(coalesce(context_text, '')) / 4.0)::BIGINT AS estimated_tokens, f.last - f.taken AS excluded,
    CASE WHEN blocked THEN CASE reasons WHEN 'invalid_profile' THEN 'unsupported_profile' WHEN 'web_call_budget_exhausted' THEN 'budget_exceeded' WHEN 'local_source_unavailable' THEN 'source_unavailable' ELSE 'unsupported_profile' END
      WHEN f.last = 0 THEN 'no_evidence' WHEN f.last > f.taken THEN 'budget_exceeded' ELSE 'success' END AS stop_reason,
    'pkg_' || substr(sha256(sha256(normalized) || ':local_only:hybrid:4:12000:2600:' || coalesce(prints, '') || ':budget=1,0,0:planner=deterministic_heuristic:l4_v1:' ||
      CASE WHEN blocked THEN 'blocked:None' ELSE 'local:corpus_docs' END || ':[' || reasons || ']'), 1, 16) AS package_id
    FROM pkg_requests r JOIN pkg_final f USING (query_id) LEFT JOIN pkg_text t USING (query_id)""", "pkg_requests", "pkg_final", "pkg_text")


@register("context_packages", "I1, I2, I3, I4, I5, I6", sql(
    """SELECT query_id, package_id, query_hash, query_length, context_chars, estimated_tokens, excluded, stop_reason, sha256(context_text) AS context_digest FROM pkg""", "pkg"))
def context_packages(spark, folder):
    return fresh_packages(spark, folder).select(
        "query_id", "package_id", "query_hash", "query_length", "context_chars", "estimated_tokens", "excluded", "stop_reason", F.sha2("context_text", 256).alias("context_digest")
    )


_abbr = "|".join(sorted(a.replace(".", r"\.") for a in co.ABBREVIATIONS))
_protect = rf"(^|\s)((?i:{_abbr}|[a-z]\.)|\S*[0-9]\.)(\s)"
_brk = "([.?!][\"'']?)(\\s+)([A-Z0-9\"''])"


def sentences_fragment(name: str, source: str, keys: str, text: str) -> None:
    """Sentence boundaries of texts without blank lines and bullets."""
    once = f"regexp_replace(trim({text}, chr(10) || ' '), '{_protect}', '\\1\\2' || chr(4) || '\\3', 'g')"
    twice = f"regexp_replace({once}, '{_protect}', '\\1\\2' || chr(4) || '\\3', 'g')"
    marked = f"replace(regexp_replace({twice}, '{_brk}', '\\1' || chr(2) || '\\2' || chr(3) || '\\3', 'g'), chr(4), '')"
    fragment(
        name,
        f"""SELECT {keys}, idx, {inp.sql_strip("CASE WHEN idx = 0 THEN piece ELSE split_part(piece, chr(3), 2) END")} AS sentence,
              CASE WHEN nxt IS NULL THEN '' ELSE split_part(nxt, chr(3), 1) END AS sep, n FROM (
              SELECT {keys}, unnest(range(len(p))) AS idx, unnest(p) AS piece, unnest(list_append(p[2:], NULL)) AS nxt, len(p) AS n FROM (
                SELECT {keys}, string_split({marked}, chr(2)) AS p FROM {source}))""",
        source,
    )


sentences_fragment("doc_sentences", "docs", "doc_id", "text")
sentences_fragment("pkg_sentences", "pkg_evidence", "query_id, cite", "text")


@register("sentence_boundaries", "I8", sql(
    """SELECT doc_id, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars, sha256(string_agg(sentence || chr(5) || sep, chr(6) ORDER BY idx)) AS digest FROM doc_sentences GROUP BY doc_id""", "doc_sentences"))
def sentence_boundaries(spark, folder):
    d = inp.docs(spark, folder).select("doc_id", co.boundaries(F.col("text")).alias("s"))
    glued = F.array_join(F.transform("s", lambda x: F.concat(x["text"], F.lit("\x05"), x["sep"])), "\x06")
    return d.select(
        "doc_id", F.size("s").alias("sentences"), F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x["text"])).alias("chars"), F.sha2(glued, 256).alias("digest")
    )


fragment("pkg_scored", f"""SELECT s.*, len(list_filter(regexp_extract_all(lower(sentence), '[{tx.WORD}]+'), lambda w: list_contains(qw, w))) AS score
    FROM pkg_sentences s JOIN (SELECT query_id, list_distinct(regexp_extract_all(lower(normalized), '[{tx.WORD}]+')) AS qw FROM pkg_requests) q USING (query_id)""", "pkg_sentences", "pkg_requests")
fragment("pkg_best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cite ORDER BY score DESC, idx) AS r FROM pkg_scored) WHERE r <= 3", "pkg_scored")
fragment("pkg_short", """SELECT e.*, b.n AS sentences, CASE WHEN b.n <= 3 THEN e.text ELSE b.joined END AS kept, min(e.n) OVER (PARTITION BY e.query_id, e.document_id, e.chunk_id, e.text) AS first_n
    FROM pkg_evidence e JOIN (SELECT query_id, cite, any_value(n) AS n, string_agg(sentence || CASE WHEN last THEN '' WHEN sep = '' THEN ' ' ELSE sep END, '' ORDER BY idx) AS joined FROM (
      SELECT *, idx = max(idx) OVER (PARTITION BY query_id, cite) AS last FROM pkg_best) GROUP BY query_id, cite) b USING (query_id, cite)""", "pkg_evidence", "pkg_best")
fragment("pkg_sized", f"""SELECT s.*, p.package_id, p.context_chars, p.estimated_tokens, p.context_chars <= 1600 AND p.estimated_tokens <= 400 AS untouched, s.first_n < s.n AS duplicate,
    {_H} + sum(CASE WHEN s.first_n < s.n THEN 0 ELSE length({BLOCK.format('kept')}) + 10 END) OVER (PARTITION BY s.query_id ORDER BY s.cite) AS upto FROM pkg_short s JOIN pkg p USING (query_id)""", "pkg_short", "pkg")
fragment("pkg_held", """SELECT *, NOT duplicate AND (untouched OR (upto <= 1600 AND ceil(upto / 4.0) <= 400) OR cite = 1) AS held FROM pkg_sized""", "pkg_sized")
fragment("pkg_report", """SELECT p.query_id, p.package_id, p.context_chars, p.estimated_tokens, coalesce(c.chars, 0) AS compressed_chars, ceil(coalesce(c.chars, 0) / 4.0)::BIGINT AS compressed_tokens, p.context_chars <= 1600 AND p.estimated_tokens <= 400 AS untouched
    FROM pkg p LEFT JOIN (SELECT query_id, max(CASE WHEN untouched THEN context_chars ELSE upto END) FILTER (held) AS chars FROM pkg_held GROUP BY query_id) c USING (query_id)""", "pkg", "pkg_held")


def compressed(spark, folder):
    return co.compress(packages(spark, folder), SQUEEZE, POLICY)


@register("compressed_packages", "I9, I10, I11, I12, I13", sql(
    """SELECT query_id, compressed_chars::BIGINT AS compressed_chars, compressed_tokens, CASE WHEN untouched THEN 'no_reduction' WHEN compressed_chars <= 1600 AND compressed_tokens <= 400 THEN 'reduced' ELSE 'target_unachievable' END AS outcome,
        greatest(context_chars - compressed_chars, 0)::BIGINT AS chars_removed, greatest(estimated_tokens - compressed_tokens, 0) AS tokens_removed,
        CASE WHEN estimated_tokens > 0 THEN greatest(0, (estimated_tokens - compressed_tokens) * 10000 // estimated_tokens) ELSE 0 END AS reduction_basis_points FROM pkg_report""", "pkg_report"))
def compressed_packages(spark, folder):
    return compressed(spark, folder).select(
        "query_id", "compressed_chars", "compressed_tokens", "outcome", "chars_removed", "tokens_removed", "reduction_basis_points"
    )


@register("compression_trace", "I9, I10, I11, I12", sql(
    """SELECT query_id, candidate_id AS evidence_id, 'C' || cite AS citation_id, CASE WHEN untouched THEN 'kept_whole' WHEN duplicate THEN 'dropped_duplicate' WHEN NOT held THEN 'dropped_for_target' WHEN sentences > 3 THEN 'extracted' ELSE 'kept_whole' END AS action,
        length(text) AS original_chars, CASE WHEN untouched THEN length(text) WHEN held THEN length(kept) ELSE 0 END AS retained_chars, sentences AS original_sentences,
        CASE WHEN untouched OR NOT duplicate THEN NULL ELSE chunk_id || '-copy' END AS duplicate_of FROM pkg_held""", "pkg_held"))
def compression_trace(spark, folder):
    t = co.compress(packages(spark, folder), SQUEEZE, POLICY).select("query_id", F.explode_outer("trace").alias("t")).filter("t is not null").select("query_id", "t.*")
    return t.drop("retained_sentences")


@register("compression_quality_violations", "I14, I15", sql(
    """SELECT package_id AS entity_id, rule FROM (SELECT p.package_id, unnest(list_filter([CASE WHEN r.compressed_chars > 0 AND p.query_id % 4 = 1 THEN 'renumbered' END, CASE WHEN r.compressed_chars > 0 AND p.query_id % 4 = 1 THEN 'provenance_changed' END,
        CASE WHEN p.query_id % 4 = 2 THEN 'char_count' END], lambda x: x IS NOT NULL)) AS rule FROM pkg p JOIN pkg_report r USING (query_id))""", "pkg", "pkg_report"))
def compression_quality_violations(spark, folder):
    """Tampered packages: a renumbered and retitled item, or a wrong size."""
    good = co.compress(packages(spark, folder), SQUEEZE, POLICY)
    names = good.schema["compressed"].dataType.elementType.names
    m = F.col("query_id") % 4
    forged = F.transform(
        "compressed",
        lambda e: F.struct(*[
            (F.concat(e[n], F.lit("*")) if n == "title" else F.concat(F.lit("C9"), e[n]) if n == "citation_id" else e[n]).alias(n) for n in names
        ]),
    )
    bad = good.withColumn("compressed", F.when(m == 1, forged).otherwise(F.col("compressed"))).withColumn(
        "compressed_text", F.when(m == 1, pk.render(F.col("compressed"))).otherwise(F.col("compressed_text"))
    )
    bad = bad.withColumn("compressed_chars", F.when(m == 1, F.length("compressed_text")).when(m == 2, F.col("compressed_chars") + 1).otherwise(F.col("compressed_chars")))
    bad = bad.withColumn("compressed_tokens", tx.estimate_tokens(F.length("compressed_text"))).withColumn("target_met", F.lit(False))
    return co.quality_problems(bad, SQUEEZE)


def providers(spark):
    rows = [("local_model", "local", "m-small", True), ("cloud_model", "hosted", "m-large", True), ("old_model", "local", "m-old", False)]
    return spark.createDataFrame(rows, "provider_id string, location string, model_id string, enabled boolean")


def answered(spark, folder):
    p = packages(spark, folder)
    q = F.col("query_id")
    wanted = F.element_at(F.array(*[F.lit(x) for x in ("local_model", "cloud_model", None, "old_model", "local_model")]), (q % 5 + 1).cast("int"))
    p = p.withColumns({
        "wanted_provider": wanted, "allow_external": q % 2 == 0, "allow_private_export": q % 4 == 0, "temperature": F.lit("0.0"),
        "max_output_tokens": F.lit(512), "timeout_ms": F.lit(30000),
    })
    said = inp.queries(spark, folder).select("query_id", F.when(q % 7 == 1, F.concat("query", F.lit(" [C8]"))).when(q % 7 != 2, F.concat("query", F.lit(" [C1]"))).alias("answer"))
    return an.gate_answers(p, p.select("query_id", "package_id").join(said, "query_id").select("package_id", "answer"), providers(spark))


fragment("gated", """SELECT *, CASE WHEN status = 'success' THEN answer WHEN status = 'abstained' THEN 'Insufficient evidence to generate an answer.' WHEN w IS NULL THEN 'No generation provider was specified.'
      WHEN w = 'old_model' THEN 'Configured generation provider is unavailable or disabled.' WHEN reason = 'external_generation_not_allowed' THEN 'External generation is not permitted by policy.'
      WHEN reason = 'private_evidence_export_not_allowed' THEN 'Private evidence export to hosted provider is not permitted by policy.' WHEN status = 'generation_failed' THEN 'Generation request failed.'
      ELSE 'Answer contained missing, malformed, or unknown citations.' END AS text, CASE WHEN status = 'success' THEN first_id ELSE '' END AS cited FROM (
    SELECT *, split_part(g, '|', 1) AS status, split_part(g, '|', 2) AS reason FROM (SELECT *, CASE WHEN first_id IS NULL THEN 'abstained|no_evidence' WHEN w IS NULL OR w = 'old_model' THEN 'provider_unavailable|provider_not_configured'
      WHEN w = 'cloud_model' AND query_id % 2 = 1 THEN 'policy_blocked|external_generation_not_allowed' WHEN w = 'cloud_model' AND query_id % 4 <> 0 THEN 'policy_blocked|private_evidence_export_not_allowed'
      WHEN answer IS NULL THEN 'generation_failed|provider_failure' WHEN query_id % 7 = 1 THEN 'invalid_citations|invalid_citations' ELSE 'success|' END AS g FROM (
      SELECT p.query_id, p.package_id, e.candidate_id AS first_id, ['local_model','cloud_model',NULL,'old_model','local_model'][p.query_id % 5 + 1] AS w,
        CASE WHEN p.query_id % 7 = 1 THEN b.query || ' [C8]' WHEN p.query_id % 7 <> 2 THEN b.query || ' [C1]' END AS answer
      FROM pkg p JOIN bench_queries b USING (query_id) LEFT JOIN pkg_evidence e ON e.query_id = p.query_id AND e.cite = 1)))""", "pkg", "bench_queries", "pkg_evidence")


@register("gated_answers", "I16, I17", sql(
    """SELECT query_id, status, nullif(reason, '') AS abstention_reason, text, cited AS cited_evidence_ids, status = 'success' AS citation_valid, 'ans_' || substr(sha256(
        encode(package_id || CASE WHEN status = 'abstained' THEN '' ELSE coalesce(w, '') END || CASE WHEN status IN ('abstained', 'provider_unavailable') THEN '' WHEN w = 'cloud_model' THEN 'm-large' ELSE 'm-small' END || coalesce(w, '') || '0.0' || '512' || '30000'
          || CASE WHEN query_id % 2 = 0 THEN 'True' ELSE 'False' END || CASE WHEN query_id % 4 = 0 THEN 'True' ELSE 'False' END) || unhex(sha256(text)) || encode(status || reason || cited)), 1, 24) AS answer_id FROM gated""", "gated"))
def gated_answers(spark, folder):
    return answered(spark, folder).select(
        "query_id", "status", "abstention_reason", "text", F.array_join("cited_evidence_ids", ",").alias("cited_evidence_ids"), "citation_valid", "answer_id"
    )


@register("capability_listing", "I18", sql(
    """SELECT kind, id, type, enabled, detail, requests FROM (SELECT 'source' AS kind, source_id AS id, source_kind AS type, enabled, array_to_string(profiles, ',') AS detail FROM sources
        UNION ALL SELECT * FROM (VALUES ('provider', 'local_model', 'local', true, 'm-small'), ('provider', 'cloud_model', 'hosted', true, 'm-large'), ('provider', 'old_model', 'local', false, 'm-old')))
       LEFT JOIN (SELECT source_id AS id, count(*) AS requests FROM planned WHERE source_id IS NOT NULL GROUP BY 1) USING (id)""", "sources", "planned"))
def capability_listing(spark, folder):
    """Public capabilities beside the number of requests each source was planned for."""
    used = control.planned(spark, folder).filter("plan.source_id is not null").groupBy(F.col("plan.source_id").alias("id")).agg(F.count("*").alias("requests"))
    return an.capabilities(control.source_table(spark), providers(spark)).join(used, "id", "left")
