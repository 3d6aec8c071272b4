"""The retrieval loop, its edges and gates, request modes and fixed systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import controller as ct
from citeloom.operators import evidence as ev
from citeloom.operators import fusion
from citeloom.plans import fixed_systems, retrieval_loop as rl
from citeloom.queries import control
from citeloom.queries import inputs as inp
from citeloom.queries.base import fragment, register, sql
from citeloom.queries.judgement import claims_fragments, pack_fragments, sufficiency_fragments


def loop_queries(spark, folder):
    """Benchmark passages with beginnings that lead to every route."""
    q = F.col("query_id")
    start = F.when(q % 4 == 0, "How to compare ").when(q % 4 == 1, "`run_task` ").otherwise("")
    text = F.when(q % 13 == 12, "hello there").otherwise(F.concat(start, "query"))
    return inp.queries(spark, folder).select("query_id", text.alias("query"), (q % 13 != 12).alias("require_citations"))


def searches(spark, folder):
    def hybrid(q):
        return fusion.reciprocal_rank_fusion(inp.sparse_top(spark, folder, 20, q), inp.dense_top(spark, folder, 20, q), 20)

    return {"sparse": lambda q: inp.sparse_top(spark, folder, 20, q), "dense": lambda q: inp.dense_top(spark, folder, 20, q), "hybrid": hybrid}


def looped(spark, folder):
    """The loop runs once per session; its evidence and states are kept as tables."""
    kept = {}

    def run():
        kept["state"], evidence = rl.run_loop(loop_queries(spark, folder), searches(spark, folder), inp.chunks(spark, folder))
        return evidence

    evidence = inp.stored(spark, folder, "loop_evidence", run)
    state = inp.stored(spark, folder, "loop_state", lambda: kept["state"])
    q = F.col("query_id")
    answers = inp.queries(spark, folder).select(
        "query_id", F.when(q % 9 == 3, "No citation here.").when(q % 13 == 12, "Hello!").otherwise(F.concat("query", F.lit(" [C1]"))).alias("first"),
        F.when(q % 2 == 0, F.concat("query", F.lit(" [C1]"))).alias("second"),
    )
    return rl.finish(state, evidence, answers), evidence


# ---------------------------------------------------------------- the loop in SQL: three rounds, written out

_STOP = "CASE WHEN {why} IS NOT NULL THEN 'abstained' ELSE status END AS status, coalesce(reason, {why}) AS reason"
_BASE = "query_id, original_query, cite, active_query, route, next_action, retrieval_calls, iteration_count, evidence_status, sufficiency_score, conflict_score, tried, attempts, last_ids, ready, chosen, \"at\""
fragment("loop_asked", f"""SELECT query_id, CASE WHEN query_id % 13 = 12 THEN 'hello there' ELSE CASE query_id % 4 WHEN 0 THEN 'How to compare ' WHEN 1 THEN '`run_task` ' ELSE '' END || query END AS query FROM bench_queries""", "bench_queries")
fragment("loop_r0", f"""SELECT query_id, query AS original_query, query_id % 13 <> 12 AS cite, query AS active_query, NULL::VARCHAR AS route, NULL::VARCHAR AS next_action, 0 AS retrieval_calls, 0 AS iteration_count,
    'unknown' AS evidence_status, 0::DOUBLE AS sufficiency_score, 0::DOUBLE AS conflict_score, []::VARCHAR[] AS tried, []::VARCHAR[] AS attempts, []::VARCHAR[] AS last_ids, false AS ready, []::VARCHAR[] AS chosen,
    'decide' AS "at", 'running' AS status, NULL::VARCHAR AS reason FROM loop_asked""", "loop_asked", stored=True)


def loop_round(r: int) -> None:
    """One round: decide, search on the chosen route, look for contradictions, rerank, pack, judge and widen."""
    p, before = f"lr{r}", f"loop_r{r - 1}"
    fragment(f"{p}_turn", f"""SELECT * FROM {before} WHERE status = 'running' AND "at" = 'decide'""", before)
    control.features_fragment(f"{p}_features", f"{p}_turn", "active_query")
    fragment(f"{p}_decided", f"""SELECT * REPLACE (split_part(d, '|', 1) AS next_action, coalesce(nullif(split_part(d, '|', 2), ''), route) AS route), split_part(d, '|', 3) AS why FROM (
        SELECT *, {control.RULE_SQL} AS d FROM (SELECT *, evidence_status = 'sufficient' AND conflict_score < 0.3 AS good, evidence_status = 'conflicting' OR conflict_score >= 0.6 AS conflicted,
            list_filter(['hybrid','sparse','dense'], lambda x: NOT list_contains(tried, x) AND x IS DISTINCT FROM route)[1] AS other FROM {p}_features))""", f"{p}_features")
    guard = """CASE WHEN next_action = 'abstain' THEN why WHEN goes AND retrieval_calls >= 3 THEN 'retrieval_budget_exhausted' WHEN goes AND iteration_count >= 3 THEN 'iteration_budget_exhausted'
        WHEN goes AND list_contains(attempts, route || chr(31) || active_query) THEN 'repeated_query_route' END"""
    fragment(f"{p}_state", f"""SELECT {_BASE.replace('"at"', "CASE WHEN goes THEN 'retrieve' WHEN next_action = 'reformulate' THEN 'reformulate' ELSE 'generate' END AS at")}, {_STOP.format(why=f'({guard})')}
            FROM (SELECT *, next_action LIKE 'retrieve_%' AS goes FROM {p}_decided)
        UNION ALL SELECT {_BASE}, status, reason FROM {before} WHERE NOT (status = 'running' AND "at" = 'decide')""", f"{p}_decided", before, stored=True)
    fragment(f"{p}_going", f"""SELECT * FROM {p}_state WHERE status = 'running' AND "at" = 'retrieve'""", f"{p}_state")
    fragment(f"{p}_ask", f"SELECT query_id, active_query AS query FROM {p}_going", f"{p}_going")
    inp.search_fragments(p, f"{p}_ask")
    fragment(f"{p}_cand", f"""SELECT f.query_id, f.chunk_id, f.rank, f.rank AS position, c.document_id, c.title, c.source_uri, c.text FROM {p}_going g JOIN (
            SELECT 'sparse' AS route, query_id, chunk_id, rank FROM {p}_sparse UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM {p}_dense UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM {p}_hybrid) f
        ON f.query_id = g.query_id AND f.route = g.route JOIN chunks c ON c.chunk_id = f.chunk_id""", f"{p}_going", f"{p}_sparse", f"{p}_dense", f"{p}_hybrid", "chunks", stored=True)
    claims_fragments(f"{p}_cl", f"{p}_cand", "query_id, chunk_id, position")
    fragment(f"{p}_found", f"""SELECT query_id, list_sort(list(DISTINCT chunk_id)) AS new_ids FROM {p}_cand GROUP BY query_id""", f"{p}_cand")
    fragment(f"{p}_clash", f"""SELECT DISTINCT a.query_id FROM {p}_cl_claims a JOIN {p}_cl_claims b ON a.query_id = b.query_id AND a.kind = b.kind AND a.claim = b.claim AND a.position < b.position AND a.value <> b.value""", f"{p}_cl_claims")
    hot = "conflict_now >= 0.6"
    fragment(f"{p}_recorded", f"""SELECT query_id, original_query, cite, active_query, route, next_action, calls AS retrieval_calls, iteration_count, CASE WHEN {hot} AND why IS NULL THEN 'conflicting' WHEN {hot} THEN 'conflicting' ELSE evidence_status END AS evidence_status,
            sufficiency_score, conflict_now AS conflict_score, tried, attempts, new_ids AS last_ids, false AS ready, chosen, "at", {_STOP.format(why='why')} FROM (
        SELECT *, CASE WHEN same AND {hot} THEN 'conflicting_evidence' WHEN same THEN 'unchanged_evidence' WHEN {hot} THEN 'conflicting_evidence' END AS why FROM (
            SELECT *, CASE WHEN NOT same AND clashes THEN greatest(conflict_score, 0.75) ELSE conflict_score END AS conflict_now FROM (
                SELECT g.* REPLACE (CASE WHEN list_contains(tried, route) THEN tried ELSE list_append(tried, route) END AS tried, list_append(attempts, route || chr(31) || active_query) AS attempts), retrieval_calls + 1 AS calls,
                    coalesce(f.new_ids, []) AS new_ids, retrieval_calls > 0 AND coalesce(f.new_ids, []) = last_ids AS same, c.query_id IS NOT NULL AS clashes
                FROM {p}_going g LEFT JOIN {p}_found f USING (query_id) LEFT JOIN {p}_clash c USING (query_id))))""", f"{p}_going", f"{p}_found", f"{p}_clash", stored=True)
    fragment(f"{p}_alive", f"SELECT query_id, original_query AS query FROM {p}_recorded WHERE status = 'running'", f"{p}_recorded")
    tokens = f"list_distinct({inp.sql_tokens('a.query')})"
    fragment(f"{p}_rows", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 12) DESC, retrieval_rank, chunk_id) AS place FROM (
            SELECT c.query_id, c.chunk_id, c.rank AS retrieval_rank, c.document_id, c.title, c.source_uri, c.text, len(list_intersect({tokens}, t.toks)) / greatest(len({tokens}), 1) AS rerank_score
            FROM {p}_cand c JOIN {p}_alive a USING (query_id) JOIN chunk_tokens t USING (chunk_id))) WHERE place <= 6""", f"{p}_cand", f"{p}_alive", "chunk_tokens", stored=True)
    pack_fragments(f"{p}_pk", f"{p}_rows", limit=6, budget=24000)
    fragment(f"{p}_kept", f"SELECT query_id, CASE WHEN selected = '' THEN [] ELSE string_split(selected, '|') END AS picked FROM {p}_pk_packed", f"{p}_pk_packed", stored=True)
    fragment(f"{p}_chosen", f"SELECT r.*, list_position(picked, r.chunk_id) AS position FROM {p}_rows r JOIN {p}_kept k USING (query_id) WHERE list_contains(picked, r.chunk_id)", f"{p}_rows", f"{p}_kept")
    sufficiency_fragments(f"{p}_su", f"{p}_alive", f"{p}_chosen")
    fragment(f"{p}_judged", f"""SELECT *, CASE WHEN es = 'sufficient' THEN 'generate' WHEN iteration_count < 3 AND retrieval_calls < 3 THEN 'reformulate' ELSE 'abstain' END AS next_at FROM (
            SELECT r.* EXCLUDE (chosen), coalesce(k.picked, []) AS chosen, s.score AS s, CASE WHEN round(s.score, 9) >= 0.72 THEN 'sufficient' ELSE 'insufficient' END AS es
            FROM {p}_recorded r JOIN {p}_su_scores s USING (query_id) LEFT JOIN {p}_kept k USING (query_id) WHERE status = 'running')""", f"{p}_recorded", f"{p}_su_scores", f"{p}_kept")
    base = "query_id, original_query, cite, active_query, route, next_action, retrieval_calls, iteration_count"
    fragment(f"{p}_scored", f"""SELECT {base}, es AS evidence_status, s AS sufficiency_score, conflict_score, tried, attempts, last_ids, ready, chosen, next_at AS "at", CASE WHEN next_at = 'abstain' THEN 'abstained' ELSE status END AS status,
            CASE WHEN next_at = 'abstain' THEN 'evidence_below_threshold' ELSE reason END AS reason FROM {p}_judged
        UNION ALL SELECT {_BASE}, status, reason FROM {p}_recorded WHERE status <> 'running'
        UNION ALL SELECT {_BASE}, status, reason FROM {p}_state WHERE NOT (status = 'running' AND "at" = 'retrieve')""", f"{p}_judged", f"{p}_recorded", f"{p}_state", stored=True)
    squash = lambda e: f"array_to_string({inp.sql_words(f'lower({e})')}, ' ')"
    wider = f"rtrim(active_query, '?') || '{ct.REFORMULATION_SUFFIX}'"
    asked = "list_concat(list_transform(attempts, lambda a: split_part(a, chr(31), 2)), [original_query, active_query])"
    refused = f"""CASE WHEN retrieval_calls >= 3 THEN 'retrieval_budget_exhausted' WHEN iteration_count >= 3 THEN 'iteration_budget_exhausted'
        WHEN length({wider}) > 1000 OR list_contains(list_transform({asked}, lambda q: {squash('q')}), {squash(wider)}) THEN 'duplicate_reformulation' END"""
    fragment(f"loop_r{r}", f"""SELECT query_id, original_query, cite, CASE WHEN refused IS NULL THEN {wider} ELSE active_query END AS active_query, route, next_action, retrieval_calls,
            iteration_count + CASE WHEN refused IS NULL THEN 1 ELSE 0 END AS iteration_count, evidence_status, sufficiency_score, conflict_score, tried, attempts, last_ids, ready OR refused IS NULL AS ready, chosen, 'decide' AS "at",
            CASE WHEN refused IS NOT NULL OR iteration_count + 1 >= 3 THEN 'abstained' ELSE status END AS status,
            coalesce(refused, CASE WHEN iteration_count + 1 >= 3 THEN 'iteration_budget_exhausted' END) AS reason
        FROM (SELECT *, {refused} AS refused FROM {p}_scored WHERE status = 'running' AND "at" = 'reformulate')
        UNION ALL SELECT {_BASE}, status, reason FROM {p}_scored WHERE NOT (status = 'running' AND "at" = 'reformulate')""", f"{p}_scored", stored=True)


for _round in (1, 2, 3):
    loop_round(_round)

# The supplied answers cite C1 or nothing, so an answer holds if its query has evidence (or needs none).
fragment("loop_gated", """SELECT *, CASE WHEN query_id % 9 = 3 THEN 'No citation here.' WHEN query_id % 13 = 12 THEN 'Hello!' ELSE 'cites' END AS first, CASE WHEN query_id % 2 = 0 THEN 'cites' END AS second,
        CASE WHEN status <> 'running' THEN NULL WHEN next_action = 'direct_answer' AND NOT cite THEN NULL WHEN conflict_score >= 0.3 THEN 'conflicting_evidence' WHEN len(chosen) = 0 THEN 'evidence_below_threshold'
            WHEN evidence_status <> 'sufficient' OR round(sufficiency_score, 9) < 0.72 THEN 'evidence_below_threshold' END AS gate FROM loop_r3""", "loop_r3")
fragment("loop_final", """SELECT query_id, route, retrieval_calls, iteration_count, evidence_status, sufficiency_score, conflict_score, chosen, next_action,
        CASE WHEN why IS NULL THEN 'completed' ELSE 'abstained' END AS status, why AS abstention_reason, CASE WHEN open AND one THEN 1 WHEN open THEN 2 ELSE 0 END AS generation_attempts,
        CASE WHEN why IS NULL AND (CASE WHEN one THEN first ELSE second END) = 'cites' THEN 'C1' ELSE '' END AS citations
    FROM (SELECT *, CASE WHEN NOT open THEN coalesce(reason, gate) WHEN NOT one AND NOT two THEN 'invalid_citations' END AS why FROM (
        SELECT *, status = 'running' AND gate IS NULL AS open, CASE WHEN first = 'cites' THEN len(chosen) > 0 ELSE route IS NOT DISTINCT FROM 'direct' END AS one,
            coalesce(second = 'cites' AND len(chosen) > 0, false) AS two FROM loop_gated))""", "loop_gated", stored=True)


@register("retrieval_loop", "H1, H2, H3, H4, H5, H8, H10", sql(
    """SELECT query_id, status, route, retrieval_calls, iteration_count, evidence_status, round(sufficiency_score, 6) AS sufficiency_score, conflict_score, abstention_reason, generation_attempts, citations FROM loop_final""", "loop_final"))
def retrieval_loop(spark, folder):
    """Final state of every query after at most three rounds."""
    state, _ = looped(spark, folder)
    return state.select(
        "query_id", "status", "route", "retrieval_calls", "iteration_count", "evidence_status", "sufficiency_score", "conflict_score", "abstention_reason", "generation_attempts",
        F.array_join("citations", ",").alias("citations"),
    )


@register("retrieval_loop_violations", "H14", "SELECT '' AS entity_id, '' AS rule WHERE false")
def retrieval_loop_violations(spark, folder):
    """Invariants of the loop's own final states: none may be broken."""
    state, evidence = looped(spark, folder)
    allowed = evidence.groupBy("query_id").agg(F.collect_list("citation_id").alias("allowed"))
    return rl.state_problems(state.join(allowed, "query_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>"))))


@register("loop_initial_states", "H1", sql(
    """SELECT query_id, query AS active_query, 'running' AS status, 0 AS retrieval_calls, 3 AS max_retrieval_calls, 'unknown' AS evidence_status FROM bench_queries""", "bench_queries"))
def loop_initial_states(spark, folder):
    return rl.initial_state(inp.queries(spark, folder)).select("query_id", "active_query", "status", "retrieval_calls", "max_retrieval_calls", "evidence_status")


@register("loop_edges", "H9", sql(
    """SELECT request_id, CASE WHEN ready THEN 'abstain' WHEN action IN ('direct_answer', 'stop') THEN 'generate' WHEN action LIKE 'retrieve_%' THEN 'retrieve' WHEN action = 'reformulate' THEN 'reformulate' ELSE 'abstain' END AS after_decision,
        CASE WHEN ready THEN 'abstain' WHEN turn % 5 = 1 THEN 'retrieve' WHEN evidence_status = 'sufficient' THEN 'generate' WHEN iteration_count < 3 AND retrieval_calls < 3 THEN 'reformulate' ELSE 'abstain' END AS after_evaluation,
        CASE WHEN ready THEN 'abstain' WHEN cite THEN 'finalize' WHEN turn % 3 < 2 THEN 'generate' ELSE 'abstain' END AS after_citations FROM ruled""", "ruled"))
def loop_edges(spark, folder):
    r = ct.query_features(control.requests(spark, folder)).withColumn("action", ct.rule_decision()["action"])
    reason = F.when(F.col("refinement_ready"), "stopped")
    return r.select(
        "request_id", rl.edge_after_decision(reason, F.col("action")).alias("after_decision"),
        rl.edge_after_evaluation(reason, F.col("evidence_status"), F.col("iteration_count"), F.lit(3), F.col("retrieval_calls"), F.lit(3), F.col("turn") % 5 == 1).alias("after_evaluation"),
        rl.edge_after_citations(F.when(F.col("refinement_ready"), "abstained").otherwise("running"), ~F.col("require_citations"), F.col("turn") % 3).alias("after_citations"),
    )


@register("loop_answer_gates", "H6, H7", sql(
    """SELECT request_id, CASE WHEN gate IS NOT NULL THEN gate WHEN turn % 7 = 6 THEN 'generator_unavailable' WHEN conv_id % 4 IN (0, 1) THEN NULL ELSE 'invalid_citations' END AS abstention_reason,
        CASE WHEN gate IS NOT NULL OR turn % 7 = 6 THEN 0 WHEN conv_id % 4 = 0 THEN 1 ELSE 2 END AS generation_attempts FROM (
        SELECT *, CASE WHEN conflict_score >= 0.3 THEN 'conflicting_evidence' WHEN turn % 6 = 5 THEN 'evidence_below_threshold' WHEN evidence_status <> 'sufficient' OR conv_id % 3 = 0 THEN 'evidence_below_threshold' END AS gate FROM requests)""", "requests"))
def loop_answer_gates(spark, folder):
    r = control.requests(spark, folder).withColumns({
        "query_id": F.col("request_id"), "original_query": F.col("query"), "next_action": F.lit("stop"), "status": F.lit("running"), "abstention_reason": F.lit(None).cast("string"),
        "at": F.lit("generate"), "sufficiency_score": F.when(F.col("conv_id") % 3 == 0, 0.5).otherwise(0.9), "route": F.lit("dense"),
    })
    e = r.filter("turn % 6 <> 5").select("query_id", F.explode(F.array(F.lit("C1"), F.lit("C2"))).alias("citation_id"))
    first = F.when(F.col("turn") % 7 == 6, None).when(F.col("conv_id") % 4 == 0, "yes [C1]").otherwise("no")
    second = F.when(F.col("conv_id") % 4 == 1, "now [C2]").otherwise("[c1]")
    out = rl.finish(r, e, r.select("query_id", first.alias("first"), second.alias("second")))
    return out.select(F.col("query_id").alias("request_id"), "abstention_reason", "generation_attempts")


@register("loop_state_problems", "H14", sql(
    """SELECT request_id AS entity_id, unnest(list_filter([CASE WHEN turn % 4 = 1 AND status = 'completed' THEN 'completed_without_answer' END, CASE WHEN turn % 4 IN (1, 2) AND status = 'completed' THEN 'completed_without_citation' END,
        CASE WHEN turn % 4 = 3 AND status = 'completed' THEN 'citation_not_allowed' END, CASE WHEN turn % 4 <> 0 AND status = 'completed' THEN 'citations_differ' END, CASE WHEN status = 'abstained' AND turn % 3 = 0 THEN 'abstained_without_reason' END,
        CASE WHEN retrieval_calls > 2 THEN 'too_many_calls' END, CASE WHEN status <> 'running' AND conv_id % 5 = 1 THEN 'terminal_with_action' END], lambda r: r IS NOT NULL)) AS rule
       FROM (SELECT *, ['completed', 'abstained', 'running'][conv_id % 3 + 1] AS status FROM requests)""", "requests"))
def loop_state_problems(spark, folder):
    t = F.col("turn") % 4
    r = control.requests(spark, folder).withColumns({
        "query_id": F.col("request_id"), "status": F.element_at(F.array(F.lit("completed"), F.lit("abstained"), F.lit("running")), (F.col("conv_id") % 3 + 1).cast("int")),
        "next_action": F.when(F.col("conv_id") % 5 == 1, "stop"), "answer": F.when(t == 1, " ").when(t == 2, "plain").when(t == 3, "x [C7]").otherwise("y [C1]"),
        "citations": F.array(F.lit("C1")), "allowed": F.array(F.lit("C1"), F.lit("C2")), "abstention_reason": F.when(F.col("turn") % 3 != 0, "why"),
        "route": F.lit("dense"), "max_retrieval_calls": F.lit(2),
    })
    return rl.state_problems(r)


@register("public_metadata", "H12", sql(
    """SELECT chunk_id, 'dense_rank,heading_path,source_type' AS public_keys, source_type FROM chunks""", "chunks"))
def public_metadata(spark, folder):
    m = F.create_map(F.lit("source_type"), F.col("source_type"), F.lit("heading_path"), F.lit(""), F.lit("dense_rank"), F.lit("1"), F.lit("internal_path"), F.col("source_uri"))
    p = inp.chunks(spark, folder).select("chunk_id", rl.public_metadata(m).alias("m"))
    return p.select("chunk_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("public_keys"), F.col("m")["source_type"].alias("source_type"))


@register("search_by_mode", "E6", sql(
    """SELECT r.query_id, r.mode, r.chunk_id, r.rank FROM (SELECT 'sparse' AS mode, query_id, chunk_id, rank FROM bq_sparse UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM bq_dense UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM bq_hybrid UNION ALL SELECT 'reranked', query_id, chunk_id, rank FROM bq_reranked) r
       WHERE r.mode = ['sparse', 'dense', 'hybrid', 'reranked'][r.query_id % 4 + 1] AND r.rank <= 5""", "bq_sparse", "bq_dense", "bq_hybrid", "bq_reranked"))
def search_by_mode(spark, folder):
    """The mode is a column of the request; every leg is searched once for its own requests."""
    mode = F.element_at(F.array(*[F.lit(m) for m in ("sparse", "dense", "hybrid", "reranked")]), (F.col("query_id") % 4 + 1).cast("int"))
    asked = inp.queries(spark, folder).withColumn("mode", mode)
    out = None
    for name in ("sparse", "dense", "hybrid", "reranked"):
        q = asked.filter(F.col("mode") == name).drop("mode")
        part = inp.all_modes(spark, folder, q)[name].filter("rank <= 5").select("query_id", F.lit(name).alias("mode"), "chunk_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


SYSTEM_TOP = 6


def two_pass(spark, folder, top=SYSTEM_TOP):
    """The first ``2 * top`` fused results, reordered by overlap."""
    pool = inp.run(spark, folder, "hybrid").filter(F.col("rank") <= 2 * top)
    pairs = fusion.hydrate(pool, inp.chunks(spark, folder), "text").join(inp.queries(spark, folder), "query_id")
    return fusion.reorder(pool, fusion.overlap_scores(pairs), top)


def system_rows(spark, folder):
    parts = {"dense": inp.run(spark, folder, "dense"), "sparse": inp.run(spark, folder, "sparse"), "two_pass": two_pass(spark, folder)}
    out = None
    for name, df in parts.items():
        rerank = F.col("rerank_score") if name == "two_pass" else F.lit(None).cast("double")
        rank = F.col("retrieval_rank") if name == "two_pass" else F.col("rank")
        part = df.filter("rank <= 6").select(F.lit(name).alias("system_name"), "query_id", "chunk_id", rank.alias("retrieval_rank"), rerank.alias("rerank_score"))
        out = part if out is None else out.unionByName(part)
    return out.join(inp.chunks(spark, folder).select("chunk_id", "document_id", "title", "source_uri", "text"), "chunk_id")


fragment("bq_two_pass", """SELECT * FROM (SELECT h.query_id, h.chunk_id, h.rank AS retrieval_rank, o.rerank_score,
        row_number() OVER (PARTITION BY h.query_id ORDER BY round(o.rerank_score, 12) DESC, h.rank, h.chunk_id) AS rank
    FROM bq_hybrid h JOIN bq_overlap o USING (query_id, chunk_id) WHERE h.rank <= 12) WHERE rank <= 6""", "bq_hybrid", "bq_overlap")
fragment("sys_rows", """SELECT s.name || ':' || r.query_id AS query_id, r.chunk_id, r.retrieval_rank, r.rerank_score, c.title, c.source_uri, c.text FROM (
    SELECT 'dense' AS name, query_id, chunk_id, rank AS retrieval_rank, NULL::DOUBLE AS rerank_score FROM bq_dense WHERE rank <= 6 UNION ALL SELECT 'sparse', query_id, chunk_id, rank, NULL FROM bq_sparse WHERE rank <= 6
    UNION ALL SELECT 'two_pass', query_id, chunk_id, retrieval_rank, rerank_score FROM bq_two_pass) r JOIN chunks c USING (chunk_id), LATERAL (SELECT r.name) s(name)""", "bq_dense", "bq_sparse", "bq_two_pass", "chunks")
pack_fragments("sy", "sys_rows", limit=6, budget=24000)


@register("fixed_system_outputs", "H11", sql(
    """SELECT n.name AS system_name, q.query_id, selected AS retrieved_chunk_ids, n.calls AS retrieval_calls, reason AS abstention_reason, CASE WHEN reason IS NULL THEN 'completed' ELSE 'abstained' END AS status
       FROM bench_queries q, (VALUES ('dense', 1), ('sparse', 1), ('two_pass', 2)) n(name, calls) JOIN sy_packed p ON p.query_id = n.name || ':' || q.query_id,
       LATERAL (SELECT CASE WHEN (q.query_id + n.calls) % 5 = 0 THEN 'generator_abstained' WHEN (q.query_id + n.calls) % 5 = 1 THEN 'invalid_citations' END AS reason)
       UNION ALL SELECT 'adaptive', query_id, array_to_string(chosen, '|'), retrieval_calls, abstention_reason, status FROM loop_final""", "bench_queries", "sy_packed", "loop_final"))
def fixed_system_outputs(spark, folder):
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("system_name"), F.lit(c).alias("c")) for n, c in fixed_systems.CALLS.items()]))
    asked = inp.queries(spark, folder).select("query_id", "query", names.alias("s")).select("query_id", "query", "s.*")
    kind = (F.col("query_id") + F.col("c")) % 5
    answers = asked.select("system_name", "query_id", F.when(kind == 0, "There is insufficient evidence.").when(kind == 1, F.concat("query", F.lit(" [C99]"))).otherwise(F.concat("query", F.lit(" [C1]"))).alias("answer"))
    out = fixed_systems.system_outputs(system_rows(spark, folder), answers).unionByName(fixed_systems.adaptive_outputs(*looped(spark, folder)))
    return out.select("system_name", "query_id", F.array_join("retrieved_chunk_ids", "|").alias("retrieved_chunk_ids"), "retrieval_calls", "abstention_reason", "status")
