"""Routing, control and source planning over conversation turns and benchmark questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.functions.checks import violations
from citeloom.operators import controller as ct
from citeloom.operators import sourcing as so
from citeloom.queries import inputs as inp
from citeloom.queries.base import fragment, register, sql

# Beginnings that make turns exercise every cue; turns beyond the list stay as they are.
CUES = (
    "What is the latest on ", "How to compare our docs with ", "`run_task` --fast for ", "Why vs ", "In this project, ",
    "Released 2024-05-01 as of ", "maxRetry config.path v3? ", "Tell NASA_X and Paris? ",
)


def requests(spark, folder):
    """Every conversation turn as a request with a control state and a source policy."""
    c = inp.table(spark, folder, "conversations")
    m = (F.col("conv_id") * 7 + F.col("turn")) % 12
    text = F.when(m == 8, "Hello there, thanks!")
    for i, cue in enumerate(CUES):
        text = text.when(m == i, F.concat(F.lit(cue), "text"))
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    a, b = F.col("conv_id"), F.col("turn")
    return c.select(
        F.concat_ws(":", "conv_id", "turn").alias("request_id"), text.otherwise(F.col("text")).alias("query"),
        (b % 4).cast("int").alias("retrieval_calls"), ((a + 1) % 4).cast("int").alias("iteration_count"),
        F.lit(3).alias("max_retrieval_calls"), F.lit(3).alias("max_iterations"),
        pick(["unknown", "insufficient", "sufficient", "conflicting"], (a + b) % 4).alias("evidence_status"),
        (((a * 3 + b) % 5) * 0.2).alias("conflict_score"),
        pick([None, "sparse", "hybrid"], b % 3).alias("route"),
        F.when(a % 3 == 0, F.array().cast("array<string>")).when(a % 3 == 1, F.array(F.lit("hybrid"))).otherwise(F.array(F.lit("hybrid"), F.lit("sparse"), F.lit("dense"))).alias("tried_routes"),
        (a % 5 == 0).alias("refinement_ready"), (a % 2 == 0).alias("require_citations"),
        F.size(tx.words(F.col("text"))).alias("evidence_count"), F.col("conv_id"), F.col("turn"),
    )


_cases = " ".join(f"WHEN {i} THEN '{c}' || text" for i, c in enumerate(CUES))
fragment("requests", f"""SELECT conv_id || ':' || turn AS request_id, CASE (conv_id * 7 + turn) % 12 {_cases} WHEN 8 THEN 'Hello there, thanks!' ELSE text END AS query,
    turn % 4 AS retrieval_calls, (conv_id + 1) % 4 AS iteration_count, 3 AS max_retrieval_calls, 3 AS max_iterations,
    ['unknown','insufficient','sufficient','conflicting'][(conv_id + turn) % 4 + 1] AS evidence_status, ((conv_id * 3 + turn) % 5) * 0.2::DOUBLE AS conflict_score,
    [NULL,'sparse','hybrid'][turn % 3 + 1] AS route, CASE conv_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['hybrid'] ELSE ['hybrid','sparse','dense'] END AS tried,
    conv_id % 5 = 0 AS ready, conv_id % 2 = 0 AS cite, len({inp.sql_words('text')}) AS evidence_count, conv_id, turn FROM conversations""")


def bounded(pattern: str) -> str:
    """A pattern that starts and ends at Unicode word boundaries, for an engine without them."""
    return rf"(?:^|[^{tx.WORD}])(?:{pattern})(?:$|[^{tx.WORD}])"


def features_fragment(name: str, source: str, column: str) -> None:
    mixed = rf"[{tx.WORD}]*(?:[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}])[{tx.WORD}]*"
    caps = f"list_filter(regexp_extract_all(regexp_replace(q, '{mixed}', chr(1), 'g'), '[A-Za-z0-9_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z0-9]+'))"
    code = " OR ".join(
        f"regexp_matches(q, '{p}')" for p in (
            bounded("[a-zA-Z]*[a-z][A-Z][a-zA-Z0-9]*"), bounded("[a-zA-Z0-9]+_[a-zA-Z0-9_]+"), ct.FLAG,
            bounded(r"[a-zA-Z_][a-zA-Z0-9_]*\.[a-zA-Z_][a-zA-Z0-9_.]*"), ct.BACKTICKS)
    )
    fragment(
        name,
        f"""SELECT *, CASE WHEN question_count > 0 THEN question_count WHEN has_comparison_terms THEN 2 ELSE 1 END AS estimated_subquestions,
            CASE WHEN regexp_matches(q, '{ct.GREETING}') THEN 0.05::DOUBLE WHEN has_code_terms OR has_comparison_terms OR has_temporal_terms THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS external_knowledge_probability
          FROM (SELECT *, len({inp.sql_words('q')}) AS token_count, length(q) - length(replace(q, '?', '')) AS question_count, {code} AS has_code_terms,
            regexp_matches(q, '{tx.bounded(ct.COMPARISON)}') AS has_comparison_terms, regexp_matches(q, '{tx.bounded(ct.TEMPORAL)}') AS has_temporal_terms,
            regexp_matches(q, '{tx.bounded(ct.MULTI_HOP)}') AS has_multi_hop_terms,
            greatest(0, len(caps) - CASE WHEN len(caps) > 0 AND starts_with(q, caps[1]) THEN 1 ELSE 0 END) AS named_entity_count
            FROM (SELECT *, {caps} AS caps FROM (SELECT *, {inp.sql_strip(column)} AS q FROM {source})))""",
        source,
    )


features_fragment("request_features", "requests", "query")

RULE_SQL = """CASE WHEN (retrieval_calls >= 3 OR iteration_count >= 3) AND good THEN 'stop||stop_evidence_sufficient_at_budget|0.85'
    WHEN retrieval_calls >= 3 THEN 'abstain||abstain_retrieval_budget_exhausted|0.9' WHEN iteration_count >= 3 THEN 'abstain||abstain_iteration_budget_exhausted|0.9'
    WHEN good THEN 'stop||stop_evidence_sufficient|0.95'
    WHEN conflicted AND other IS NOT NULL THEN 'retrieve_' || other || '|' || other || '|route_conflict_alternate_' || other || '|0.7'
    WHEN conflicted THEN 'abstain||abstain_conflicting_evidence_unresolvable|0.85'
    WHEN ready AND route IS NOT NULL AND route <> 'direct' THEN 'retrieve_' || route || '|' || route || '|route_refined_query|1'
    WHEN retrieval_calls > iteration_count THEN 'reformulate||reformulate_uncertain_evidence|0.8'
    WHEN NOT cite AND external_knowledge_probability < 0.2 THEN 'direct_answer|direct|direct_answer_non_factual_greeting|0.95'
    WHEN has_comparison_terms OR has_multi_hop_terms THEN 'retrieve_hybrid|hybrid|route_hybrid_complex_query|0.8'
    WHEN has_code_terms THEN 'retrieve_sparse|sparse|route_sparse_exact_identifier|0.85' ELSE 'retrieve_dense|dense|route_dense_semantic_query|0.8' END"""
fragment("ruled", f"""SELECT *, split_part(d, '|', 1) AS action, nullif(split_part(d, '|', 2), '') AS chosen, split_part(d, '|', 3) AS reason, CAST(split_part(d, '|', 4) AS DOUBLE) AS confidence FROM (
    SELECT *, {RULE_SQL} AS d FROM (SELECT *, evidence_status = 'sufficient' AND conflict_score < 0.3 AS good, evidence_status = 'conflicting' OR conflict_score >= 0.6 AS conflicted,
      list_filter(['hybrid','sparse','dense'], lambda r: NOT list_contains(tried, r) AND r IS DISTINCT FROM route)[1] AS other FROM request_features))""", "request_features")


@register("query_features", "G1, G2", sql(
    """SELECT request_id, token_count, question_count, has_code_terms, has_comparison_terms, has_temporal_terms, has_multi_hop_terms, named_entity_count,
        estimated_subquestions, external_knowledge_probability FROM request_features""", "request_features"))
def query_features(spark, folder):
    return ct.query_features(requests(spark, folder)).select(
        "request_id", "token_count", "question_count", "has_code_terms", "has_comparison_terms", "has_temporal_terms", "has_multi_hop_terms",
        "named_entity_count", "estimated_subquestions", "external_knowledge_probability",
    )


@register("rule_decisions", "G3, G4", sql("SELECT request_id, action, chosen AS route, reason, confidence FROM ruled", "ruled"))
def rule_decisions(spark, folder):
    return ct.query_features(requests(spark, folder)).select("request_id", ct.rule_decision().alias("d")).select("request_id", "d.*")


def samples(spark, folder):
    """Benchmark questions as evaluation samples: a question without a gold chunk must be refused."""
    gold = inp.qrels(spark, folder).groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("gold"))
    kinds = F.array(*[F.lit(k) for k in ("single_fact", "multi_hop", "contrastive", "definition")])
    return inp.queries(spark, folder).join(gold, "query_id", "left").select(
        F.col("query_id").alias("sample_id"), F.col("query").alias("question"),
        F.coalesce("gold", F.array().cast("array<string>")).alias("gold"), F.col("gold").isNull().alias("requires_abstention"),
        F.when(F.col("query_id") % 4 == 3, "test").otherwise("dev").alias("split"),
        F.element_at(kinds, (F.col("query_id") % 4 + 1).cast("int")).alias("sample_type"),
    )


fragment("samples", """SELECT q.query_id AS sample_id, q.query AS question, coalesce(g.gold, []) AS gold, g.gold IS NULL AS requires_abstention,
    CASE WHEN q.query_id % 4 = 3 THEN 'test' ELSE 'dev' END AS split, ['single_fact','multi_hop','contrastive','definition'][q.query_id % 4 + 1] AS sample_type
    FROM bench_queries q LEFT JOIN (SELECT query_id, list_sort(list(DISTINCT chunk_id)) AS gold FROM qrels GROUP BY 1) g USING (query_id)""", "bench_queries", "qrels")

BEST_SQL = """CASE WHEN requires_abstention OR sample_type = 'unanswerable' THEN 'abstain|oracle_unanswerable_abstain'
    WHEN len(gold) > 0 AND list_has_all(retrieved, gold) THEN 'stop|oracle_gold_evidence_satisfied'
    WHEN (calls >= 3 OR rounds >= 3) AND list_has_any(gold, retrieved) THEN 'stop|oracle_budget_partial_evidence_stop'
    WHEN calls >= 3 OR rounds >= 3 THEN 'abstain|oracle_budget_exhausted_abstain'
    WHEN calls = 0 AND sample_type = 'single_fact' THEN 'retrieve_sparse|oracle_initial_single_fact_sparse'
    WHEN calls = 0 AND sample_type IN ('multi_hop', 'contrastive') THEN 'retrieve_hybrid|oracle_initial_complex_hybrid'
    WHEN calls = 0 THEN 'retrieve_dense|oracle_initial_dense' WHEN NOT reformulated THEN 'reformulate|oracle_missing_gold_reformulate'
    ELSE 'retrieve_hybrid|oracle_subsequent_hybrid_fallback' END"""


@register("supervised_actions", "G5", sql(
    f"""SELECT sample_id, calls AS retrieval_calls, split_part(d, '|', 1) AS action, split_part(d, '|', 2) AS reason FROM (SELECT *, {BEST_SQL} AS d FROM (
        SELECT *, unnest(range(0, 4)) AS calls, sample_id % 3 AS rounds, sample_id % 2 = 1 AS reformulated FROM samples s LEFT JOIN
          (SELECT query_id, list(chunk_id) AS got FROM bq_sparse WHERE rank <= 2 GROUP BY 1) r ON r.query_id = s.sample_id), LATERAL (SELECT coalesce(got, []) AS retrieved))""", "samples", "bq_sparse"))
def supervised_actions(spark, folder):
    got = inp.run(spark, folder, "sparse").filter("rank <= 2").groupBy(F.col("query_id").alias("sample_id")).agg(F.collect_set("chunk_id").alias("got"))
    rows = samples(spark, folder).join(got, "sample_id", "left").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("retrieval_calls"), F.coalesce("got", F.array().cast("array<string>")).alias("retrieved"),
        (F.col("sample_id") % 3).alias("iteration_count"), (F.col("sample_id") % 2 == 1).alias("reformulated"),
        F.lit(3).alias("max_retrieval_calls"), F.lit(3).alias("max_iterations"),
    )
    return rows.select("sample_id", "retrieval_calls", ct.best_action().alias("d")).select("sample_id", "retrieval_calls", "d.action", "d.reason")


@register("supervision_leaks", "G5", sql("SELECT CAST(sample_id AS VARCHAR) AS entity_id, 'not_dev_split' AS rule FROM samples WHERE split <> 'dev'", "samples"))
def supervision_leaks(spark, folder):
    return ct.supervision_leaks(samples(spark, folder))


features_fragment("sample_features", "samples", "question")
fragment("training", f"""SELECT sample_id, state, [calls, rounds, evidence_count, 0, (status = 'sufficient')::INT, 0, token_count, has_code_terms::INT, has_multi_hop_terms::INT, has_comparison_terms::INT] AS features,
    split_part(d, '|', 1) AS label, split_part(d, '|', 2) AS reason FROM (SELECT *, {BEST_SQL} AS d FROM (
      SELECT *, 'initial' AS state, 0 AS calls, 0 AS rounds, 'unknown' AS status, []::VARCHAR[] AS retrieved, 0 AS evidence_count, false AS reformulated FROM sample_features WHERE split = 'dev'
      UNION ALL SELECT *, 'satisfied', 1, 1, 'sufficient', gold, len(gold), false FROM sample_features WHERE split = 'dev' AND NOT requires_abstention AND len(gold) > 0
      UNION ALL SELECT *, 'exhausted', 2, 2, 'insufficient', [], 0, false FROM sample_features WHERE split = 'dev' AND requires_abstention))""", "sample_features")


def feature_text(name: str = "features"):
    return F.array_join(F.transform(name, lambda x: x.cast("long").cast("string")), ",")


@register("policy_training_rows", "G6, G7", sql("SELECT sample_id, state, array_to_string(features, ',') AS features, label, reason FROM training", "training"))
def policy_training_rows(spark, folder):
    return ct.training_rows(samples(spark, folder)).withColumn("features", feature_text())


@register("policy_fit", "G8", None)
def policy_fit(spark, folder):
    """Fit on the development samples and count predictions against labels."""
    rows = ct.training_rows(samples(spark, folder))
    return ct.score_policy(rows, ct.fit_policy(rows)).groupBy("label", "predicted").agg(F.count("*").alias("n"))


# Hand-set parameters of three classes, so that scoring can be checked digit by digit.
POLICY = [
    ("abstain", [0.4, -0.2, -0.01, 0.5, -1.0, 1.5, 0.01, 0.0, 0.1, 0.0], -0.3),
    ("retrieve_hybrid", [-0.6, -0.3, 0.0, 0.0, -0.5, 0.0, 0.015, 0.2, 0.8, 0.9], 0.4),
    ("stop", [0.1, 0.1, 0.02, -0.9, 2.0, -1.0, 0.0, 0.0, 0.0, 0.0], 0.1),
]


def fixed_policy(spark):
    return spark.createDataFrame(POLICY, "label string, weights array<double>, intercept double")


_z = {n: f"({b} + " + " + ".join(f"({w}) * f[{i + 1}]" for i, w in enumerate(ws)) + ")" for n, ws, b in POLICY}
_best_z = "greatest(" + ", ".join(f"z_{n}" for n in _z) + ")"
fragment("scored", f"""SELECT *, CASE {' '.join(f"WHEN z_{n} = top THEN '{n}'" for n in _z)} END AS predicted, 1.0::DOUBLE / ({' + '.join(f'exp(z_{n} - top)' for n in _z)}) AS probability FROM (
    SELECT *, {_best_z} AS top FROM (SELECT *, {', '.join(f'{e} AS z_{n}' for n, e in _z.items())} FROM (
      SELECT *, [retrieval_calls, iteration_count, evidence_count, conflict_score, (evidence_status = 'sufficient')::INT, (evidence_status = 'conflicting')::INT, token_count,
        has_code_terms::INT, has_multi_hop_terms::INT, has_comparison_terms::INT]::DOUBLE[] AS f FROM ruled)))""", "ruled")
fragment("learned", """SELECT *, CASE WHEN spent AND good THEN 'stop' WHEN spent THEN 'abstain' WHEN probability < 0.5 THEN action ELSE predicted END AS l_action,
    CASE WHEN spent AND good THEN 'learned_guardrail_budget_sufficient_stop' WHEN spent THEN 'learned_guardrail_budget_exhausted_abstain'
      WHEN probability < 0.5 THEN 'heuristic_low_confidence_fallback_' || reason ELSE 'learned_model_prediction' END AS l_reason,
    CASE WHEN spent THEN NULL WHEN probability < 0.5 THEN chosen WHEN predicted LIKE 'retrieve_%' THEN substr(predicted, 10) END AS l_route
    FROM (SELECT *, retrieval_calls >= 3 OR iteration_count >= 3 AS spent FROM scored)""", "scored")


def scored_requests(spark, folder):
    rows = ct.query_features(requests(spark, folder)).withColumn("features", ct.feature_vector())
    return ct.score_policy(rows, fixed_policy(spark))


@register("policy_scoring", "G9", sql("SELECT request_id, predicted, round(probability, 6) AS probability FROM scored", "scored"))
def policy_scoring(spark, folder):
    return scored_requests(spark, folder).select("request_id", "predicted", "probability")


@register("learned_decisions", "G10", sql("SELECT request_id, l_action AS action, l_route AS route, l_reason AS reason FROM learned", "learned"))
def learned_decisions(spark, folder):
    return scored_requests(spark, folder).select("request_id", ct.learned_decision().alias("d")).select("request_id", "d.action", "d.route", "d.reason")


fragment("cells", "SELECT action AS truth, l_action AS predicted, count(*) AS n FROM learned GROUP BY 1, 2", "learned")
fragment("per_class", """SELECT label, support, CASE WHEN called > 0 THEN hit / called ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, hit FROM (
    SELECT label, (SELECT coalesce(sum(n), 0) FROM cells WHERE truth = label) AS support, (SELECT coalesce(sum(n), 0) FROM cells WHERE predicted = label) AS called,
      (SELECT coalesce(sum(n), 0) FROM cells WHERE truth = label AND predicted = label) AS hit FROM (SELECT truth AS label FROM cells UNION SELECT predicted FROM cells))""", "cells")
fragment("per_class_f1", "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM per_class", "per_class")


def decision_pairs(spark, folder):
    rows = scored_requests(spark, folder)
    return rows.select(ct.rule_decision()["action"].alias("truth"), ct.learned_decision()["action"].alias("predicted"))


@register("decision_confusion", "G11", sql("SELECT truth, predicted, n FROM cells", "cells"))
def decision_confusion(spark, folder):
    return ct.diagnostics(decision_pairs(spark, folder))[0]


@register("decision_class_metrics", "G11", sql("SELECT label, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per_class_f1", "per_class_f1"))
def decision_class_metrics(spark, folder):
    return ct.diagnostics(decision_pairs(spark, folder))[1]


@register("decision_totals", "G11", sql("SELECT sum(support)::BIGINT AS total_decisions, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM per_class_f1", "per_class_f1"))
def decision_totals(spark, folder):
    return ct.diagnostics(decision_pairs(spark, folder))[2]


@register("reformulated_queries", "G20", sql(
    f"""SELECT request_id, CASE WHEN problem IS NULL THEN wider END AS refined, problem FROM (
        SELECT *, CASE WHEN length(wider) > 1000 THEN 'invalid_length' WHEN turn % 5 = 2 THEN 'duplicate_reformulation' END AS problem FROM (
          SELECT *, rtrim(query, '?') || ' documentation usage' AS wider FROM (SELECT * REPLACE (query || CASE WHEN turn % 2 = 0 THEN '??' ELSE '' END AS query) FROM requests)))""", "requests"))
def reformulated_queries(spark, folder):
    rows = requests(spark, folder).withColumn("query", F.concat("query", F.when(F.col("turn") % 2 == 0, "??").otherwise("")))
    again = F.lower(F.concat(F.rtrim("query", F.lit("?")), F.lit("  documentation usage ")))
    previous = F.when(F.col("turn") % 5 == 2, F.array(again)).otherwise(F.array(F.lit("other")))
    out = rows.select("request_id", ct.reformulate(F.col("query"), previous).alias("r"))
    return out.select("request_id", F.col("r.query").alias("refined"), "r.problem")


# ---------------------------------------------------------------- sources


def source_table(spark):
    """Registered sources are configuration: a handful of rows beside the requests table."""
    rows = [
        ("docs_main", "local_document", True, ["local_only", "hybrid"], 0, True, 1),
        ("docs_old", "local_document", False, ["local_only"], 0, False, 2),
        ("docs_strict", "local_document", True, ["local_only"], 0, False, 3),
        ("web_main", "web_search_snippet", True, ["hybrid"], 800, False, 4),
        ("web_off", "web_search_snippet", False, ["hybrid"], 500, False, 5),
    ]
    return spark.createDataFrame(rows, "source_id string, source_kind string, enabled boolean, profiles array<string>, cost long, is_default boolean, registered int")


fragment("sources", """SELECT * FROM (VALUES ('docs_main', 'local_document', true, ['local_only', 'hybrid'], 0, true, 1), ('docs_old', 'local_document', false, ['local_only'], 0, false, 2),
    ('docs_strict', 'local_document', true, ['local_only'], 0, false, 3), ('web_main', 'web_search_snippet', true, ['hybrid'], 800, false, 4),
    ('web_off', 'web_search_snippet', false, ['hybrid'], 500, false, 5)) t(source_id, source_kind, enabled, profiles, cost, is_default, registered)""")


def source_requests(spark, folder):
    return shaped_requests(requests(spark, folder))


def shaped_requests(rows):
    """Requests with policy inputs (profile, consent, budgets, wanted source) taken from ``conv_id`` and ``turn``."""
    a, b = F.col("conv_id"), F.col("turn")
    wanted = F.element_at(F.array(*[F.lit(x) for x in (None, "web_main", "docs_old", "web_off", "docs_strict", "web_search", "nowhere", None, None)]), ((a * 5 + b) % 9 + 1).cast("int"))
    base = rows.select("request_id", "query", "conv_id", "turn", wanted.alias("wanted_source"))
    shaped = base.withColumns({
        "execution_profile": F.when((a + b) % 3 == 0, "local_only").otherwise("hybrid"),
        "allow_external_query": b % 2 == 0,
        "max_retrieval_calls": F.when(a % 11 == 0, 0), "max_web_calls": F.when(a % 7 == 0, 0), "max_cost": F.when(a % 6 == 0, 700),
    })
    return so.default_budget(so.planner_features(shaped))


def request_fragments(prefix: str, base: str) -> None:
    fragment(f"{prefix}source_requests", f"""SELECT *, (execution_profile = 'hybrid' AND allow_external_query) AS open_web,
    CASE WHEN conv_id % 11 = 0 THEN 0 ELSE 1 END AS p_calls, CASE WHEN conv_id % 7 = 0 THEN 0 WHEN execution_profile = 'hybrid' AND allow_external_query THEN 1 ELSE 0 END AS p_web,
    CASE WHEN conv_id % 6 = 0 THEN 700 WHEN execution_profile = 'hybrid' AND allow_external_query THEN 1000000 ELSE 0 END AS p_cost,
    length(q) AS normalized_length, len({inp.sql_words('q')}) AS token_like_count, regexp_matches(lower(q), '{tx.bounded(so.FRESHNESS)}') AS fresh,
    regexp_matches(lower(q), '{tx.bounded(so.LOCAL_REFERENCE)}') AS localref, regexp_matches(lower(q), '{tx.bounded(so.TIME_REFERENCE)}') AS timeref
    FROM (SELECT request_id, conv_id, turn, query, {inp.sql_strip('query')} AS q, [NULL,'web_main','docs_old','web_off','docs_strict','web_search','nowhere',NULL,NULL][(conv_id * 5 + turn) % 9 + 1] AS wanted,
      CASE WHEN (conv_id + turn) % 3 = 0 THEN 'local_only' ELSE 'hybrid' END AS execution_profile, turn % 2 = 0 AS allow_external_query FROM {base})""", base)
    fragment(f"{prefix}planned", f"""SELECT *, split_part(d, '|', 1) AS route, nullif(split_part(d, '|', 2), '') AS source_id, split_part(d, '|', 3) AS reasons FROM (SELECT *, CASE
    WHEN p_calls = 0 THEN 'blocked||retrieval_budget_exhausted'
    WHEN wanted = 'web_search' THEN 'blocked||web_source_unavailable' WHEN wanted = 'nowhere' THEN 'unknown_source||unknown_source'
    WHEN wanted = 'web_off' THEN 'blocked||web_source_unavailable' WHEN wanted = 'docs_old' THEN 'blocked||local_source_unavailable'
    WHEN wanted = 'web_main' THEN CASE WHEN web_no IS NOT NULL THEN 'blocked||' || web_no ELSE 'web|web_main|caller_selected_source' END
    WHEN wanted = 'docs_strict' THEN CASE WHEN execution_profile = 'local_only' THEN 'local|docs_strict|caller_selected_source' ELSE 'blocked||invalid_profile' END
    WHEN localref THEN 'local|docs_main|default_local' WHEN fresh AND web_no IS NULL THEN 'web|web_main|freshness_cue'
    WHEN fresh THEN 'local|docs_main|' || web_no || ',default_local' ELSE 'local|docs_main|default_local' END AS d
    FROM (SELECT *, CASE WHEN execution_profile <> 'hybrid' THEN 'invalid_profile' WHEN NOT allow_external_query THEN 'external_query_not_allowed'
        WHEN p_web < 1 THEN 'web_call_budget_exhausted' WHEN p_cost < 800 THEN 'external_cost_budget_exhausted' END AS web_no FROM {prefix}source_requests))""", f"{prefix}source_requests")


request_fragments("", "requests")


@register("planner_features", "G12, G22", sql(
    """SELECT request_id, normalized_length, token_like_count, fresh AS has_freshness_cue, localref AS has_local_reference_cue, timeref AS has_explicit_time_reference,
        p_calls AS max_retrieval_calls, p_web AS max_web_calls, p_cost AS max_cost FROM source_requests""", "source_requests"))
def planner_features(spark, folder):
    return source_requests(spark, folder).select(
        "request_id", "normalized_length", "token_like_count", "has_freshness_cue", "has_local_reference_cue", "has_explicit_time_reference",
        "max_retrieval_calls", "max_web_calls", "max_cost",
    )


def planned(spark, folder):
    return so.plan_sources(source_requests(spark, folder), source_table(spark))


@register("source_plans", "G13", sql("SELECT request_id, route, source_id, reasons FROM planned", "planned"))
def source_plans(spark, folder):
    return planned(spark, folder).select("request_id", "plan.*")


@register("source_resolution", "G14", sql(
    """SELECT request_id, coalesce(wanted, 'docs_main') AS source_id, CASE WHEN s.source_id IS NULL THEN 'unknown_source' WHEN NOT enabled THEN 'source_disabled'
        WHEN NOT list_contains(profiles, execution_profile) THEN 'profile_not_supported' END AS problem
       FROM source_requests r LEFT JOIN sources s ON s.source_id = coalesce(wanted, 'docs_main')""", "source_requests", "sources"))
def source_resolution(spark, folder):
    return so.resolve_sources(source_requests(spark, folder), source_table(spark)).select("request_id", "source_id", "problem")


@register("budget_preflight", "G15, G16, G17", sql(
    """SELECT request_id, reason IS NULL AS allowed, reason, (web_used * coalesce(cost, 0))::BIGINT AS cost_used, web_used, CASE WHEN elapsed > 400 THEN 'budget_exceeded' ELSE 'success' END AS stop_reason,
        CASE WHEN elapsed > 400 THEN 1 ELSE 0 END AS warnings FROM (
        SELECT *, CASE WHEN route = 'blocked' THEN split_part(reasons, ',', 1) WHEN p_calls < 1 THEN 'retrieval_budget_exhausted' WHEN is_web AND p_web < 1 THEN 'web_call_budget_exhausted'
          WHEN (coalesce(cost, 0) > 0 OR is_web) AND p_cost < cost THEN 'external_cost_budget_exhausted' END AS reason, CASE WHEN route = 'web' THEN turn % 3 ELSE 0 END AS web_used,
          (conv_id * 37 + turn * 11) % 800 AS elapsed FROM (
          SELECT p.*, s.cost, route = 'web' OR coalesce(s.source_kind = 'web_search_snippet', false) AS is_web FROM planned p LEFT JOIN sources s ON s.source_id = p.source_id))""", "planned", "sources"))
def budget_preflight(spark, folder):
    p = planned(spark, folder).select("*", "plan.route", "plan.source_id", "plan.reasons").join(source_table(spark).select("source_id", "cost", "source_kind"), "source_id", "left")
    elapsed = (F.col("conv_id") * 37 + F.col("turn") * 11) % 800
    calls = F.when(F.col("route") == "web", F.col("turn") % 3).otherwise(0)
    used = so.budget_used(F.lit(1), calls, elapsed.cast("double"), F.col("cost"))
    out = p.select(
        "request_id", so.preflight(F.col("route"), F.col("reasons"), F.col("source_kind"), F.col("cost")).alias("f"), used.alias("u"),
        so.wall_clock(elapsed, F.lit(400), F.lit("success"), F.array().cast("array<string>")).alias("w"),
    )
    return out.select(
        "request_id", "f.allowed", "f.reason", F.col("u")["estimated_external_cost_microusd"].alias("cost_used"), F.col("u")["web_calls"].alias("web_used"),
        "w.stop_reason", F.size("w.warnings").alias("warnings"),
    )


@register("plan_consistency", "G21, G22, I7", sql(
    """SELECT request_id AS entity_id, rule FROM (
        SELECT request_id, unnest(list_filter([CASE WHEN turn % 9 = 4 AND route = 'blocked' THEN 'blocked_with_source' END, CASE WHEN turn % 9 = 5 AND route IN ('local','web') THEN 'route_without_source' END,
          CASE WHEN turn % 9 = 6 THEN 'budget_keys' END, CASE WHEN turn % 9 = 7 THEN 'negative_budget' END], lambda r: r IS NOT NULL)) AS rule FROM planned)""", "planned"))
def plan_consistency(spark, folder):
    t = F.col("turn") % 9
    p = planned(spark, folder).select("request_id", "turn", "plan.route", "plan.source_id")
    broken = p.withColumn("source_id", F.when((t == 4) & (F.col("route") == "blocked"), "x").when(t == 5, None).otherwise(F.col("source_id")))
    used = so.budget_used(F.lit(1), F.lit(0), F.when(t == 7, -5.0).otherwise(3.0), F.lit(0))
    broken = broken.withColumn("budget_used", F.when(t == 6, F.map_filter(used, lambda k, v: k != "web_calls")).otherwise(used))
    return violations(broken, F.col("request_id"), so.decision_rules())


@register("source_consistency", "G14, G21", sql(
    """SELECT CAST(item_id AS VARCHAR) AS entity_id, unnest(list_filter([CASE WHEN item_id % 6 = 1 THEN 'bad_source_id' END, CASE WHEN item_id % 6 = 2 THEN 'blank_name' END,
        CASE WHEN item_id % 2 = 0 AND item_id % 3 = 1 THEN 'local_not_private' END, CASE WHEN item_id % 2 = 1 AND item_id % 3 = 0 THEN 'web_not_live' END,
        CASE WHEN item_id % 2 = 1 AND item_id % 5 = 0 THEN 'web_not_hybrid_only' END], lambda r: r IS NOT NULL)) AS rule FROM benchmark"""))
def source_consistency(spark, folder):
    i = F.col("item_id")
    local = i % 2 == 0
    rows = inp.table(spark, folder, "benchmark").select(
        "item_id", F.when(i % 6 == 1, "Bad Id").otherwise(F.concat(F.lit("src_"), i)).alias("source_id"), F.lit("adapter-1").alias("adapter_id"),
        F.when(i % 6 == 2, "  ").otherwise("Name").alias("display_name"), F.when(local, so.LOCAL).otherwise(so.WEB).alias("source_kind"),
        F.when(local & (i % 3 != 1), "private").otherwise("public_web").alias("privacy"),
        F.when(local, "snapshot").when(i % 3 == 0, "snapshot").otherwise("live").alias("freshness"),
        F.when(local, F.array(F.lit("local_only"))).when(i % 5 == 0, F.array(F.lit("hybrid"), F.lit("hosted"))).otherwise(F.array(F.lit("hybrid"))).alias("profiles"),
    )
    return violations(rows, i, so.source_rules())


def router_cases(spark, folder):
    p = planned(spark, folder).select("*", F.col("plan.route").alias("rule_route"))
    return so.router_features(p).withColumns({
        "expected_route": F.when(F.col("conv_id") % 10 == 0, "blocked").otherwise(F.col("rule_route")),
        "split": F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("conv_id") % 3 + 1).cast("int")),
    })


@register("router_features", "G18", sql(
    f"""SELECT request_id, round(least(length(query) / 200.0, 1), 6) AS f1, round(least(token_like_count / 30.0, 1), 6) AS f2, regexp_matches(lower(query), '{so.ROUTER_FRESH}')::INT::DOUBLE AS f3,
        regexp_matches(lower(query), '{so.ROUTER_LOCAL}')::INT::DOUBLE AS f4, regexp_matches(lower(query), '{tx.bounded("202[0-9]")}')::INT::DOUBLE AS f5, (wanted IS NOT NULL)::INT::DOUBLE AS f6,
        allow_external_query::INT::DOUBLE AS f7, (p_calls > 0 AND (NOT allow_external_query OR (p_web > 0 AND p_cost > 0)))::INT::DOUBLE AS f8 FROM source_requests""", "source_requests"))
def router_features(spark, folder):
    return router_cases(spark, folder).select("request_id", *[F.col("features")[i].alias(f"f{i + 1}") for i in range(8)])


@register("router_adoption_gate", "G18, G19", None)
def router_adoption_gate(spark, folder):
    """Fit on the training split only, then report accuracy on every split."""
    cases = router_cases(spark, folder)
    policy = ct.fit_policy(cases.filter("split = 'train'").select("features", F.col("expected_route").alias("label")), balanced=False, max_iter=200)
    return so.gate_report(ct.score_policy(cases, policy))


@register("route_gate_accuracy", "G19", sql(
    """SELECT ['train','validation','test'][conv_id % 3 + 1] AS split, count(*) AS samples, round(avg(((CASE WHEN conv_id % 10 = 0 THEN 'blocked' ELSE route END) = (CASE WHEN turn % 4 = 0 THEN 'web' ELSE route END))::INT), 6) AS learned_accuracy,
        round(avg((CASE WHEN conv_id % 10 = 0 THEN 'blocked' ELSE route END = route)::INT), 6) AS rule_accuracy FROM planned GROUP BY 1""", "planned"))
def route_gate_accuracy(spark, folder):
    rows = router_cases(spark, folder).withColumn("predicted", F.when(F.col("turn") % 4 == 0, "web").otherwise(F.col("rule_route")))
    return so.gate_report(rows)
