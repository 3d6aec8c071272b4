"""The retrieval loop with exchanged parts, on a small corpus with supplied search results."""

import pytest
from pyspark.sql import functions as F

from citeloom.operators import controller as ct
from citeloom.plans import fixed_systems, retrieval_loop as rl

CHUNKS = [
    ("a", "d1", "Cache", "u1", "The cache timeout is 30 seconds and it is enabled by default."),
    ("b", "d2", "Sync", "u2", "Live sync of the cache is configured with a timeout value."),
    ("c", "d3", "Other", "u3", "Nothing related at all."),
    ("x", "d4", "Old", "u4", "The cache timeout is 60 seconds."),
]
QUERIES = [(1, "cache timeout"), (2, "`run_task` cache timeout"), (3, "unrelated words here")]


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, document_id string, title string, source_uri string, text string")
    return spark.createDataFrame(QUERIES, "query_id long, query string"), chunks


def found(*ids):
    """A search that finds the same chunks for every query."""

    def search(q):
        hits = F.explode(F.array(*[F.struct(F.lit(c).alias("chunk_id"), F.lit(i + 1).alias("rank"), F.lit(1.0 / (i + 1)).alias("score")) for i, c in enumerate(ids)]))
        return q.select("query_id", hits.alias("h")).select("query_id", "h.*")

    return search


SEARCH = {"sparse": found("a", "b"), "dense": found("b", "a"), "hybrid": found("a", "b", "c")}


def states(result):
    return {r.query_id: r for r in result[0].collect()}


def test_a_python_controller_gives_what_the_rules_give(tables):
    queries, chunks = tables
    plain = states(rl.run_loop(queries, SEARCH, chunks))

    def decide(frame):
        for r in frame.itertuples():
            if r.evidence_status == "sufficient" and r.conflict_score < 0.3:
                yield {"action": "stop", "route": None, "reason": "enough", "confidence": 1.0}
            elif r.retrieval_calls > r.iteration_count:
                yield {"action": "reformulate", "route": None, "reason": "again", "confidence": 1.0}
            else:
                route = r.route if r.refinement_ready and r.route else "sparse" if r.has_code_terms else "dense"
                yield {"action": f"retrieve_{route}", "route": route, "reason": "look", "confidence": 1.0}

    own = states(rl.run_loop(queries, SEARCH, chunks, controller=rl.by_function("decision", rl.DECISION, decide)))
    for i, r in plain.items():
        assert (own[i].status, own[i].route, own[i].retrieval_calls, own[i].abstention_reason) == (r.status, r.route, r.retrieval_calls, r.abstention_reason)


def test_a_learned_policy_chooses_the_route(spark, tables):
    queries, chunks = tables
    rows = [("retrieve_hybrid", [0.0] * 10, 5.0), ("stop", [0.0] * 4 + [50.0] + [0.0] * 5, 0.0)]
    policy = spark.createDataFrame(rows, "label string, weights array<double>, intercept double")
    got = states(rl.run_loop(queries, SEARCH, chunks, controller=rl.learned_controller(policy)))
    assert {r.route for r in got.values()} == {"hybrid"}
    unsure = states(rl.run_loop(queries, SEARCH, chunks, controller=rl.learned_controller(policy, threshold=1.1)))
    plain = states(rl.run_loop(queries, SEARCH, chunks))
    assert {i: (r.route, r.status, r.abstention_reason) for i, r in unsure.items()} == {i: (r.route, r.status, r.abstention_reason) for i, r in plain.items()}


def test_decisions_that_cannot_be_followed(tables):
    queries, chunks = tables
    bad = {1: ("fly", None), 2: ("retrieve_dense", "sparse"), 3: ("rerank", None)}

    def decide(frame):
        return [{"action": bad[i][0], "route": bad[i][1], "reason": "r", "confidence": 1.0} for i in frame["query_id"]]

    got = states(rl.run_loop(queries, SEARCH, chunks, controller=rl.by_function("decision", rl.DECISION, decide)))
    assert {i: (r.status, r.abstention_reason, r.retrieval_calls) for i, r in got.items()} == {
        1: ("abstained", "invalid_decision", 0), 2: ("abstained", "invalid_decision", 0), 3: ("abstained", "evidence_below_threshold", 0)}


def test_reformulators_and_their_refusals(tables):
    queries, chunks = tables
    poor = {r: found("c") for r in ("sparse", "dense", "hybrid")}
    asked = []

    def search(route):
        def run(q):
            asked.extend(r.query for r in q.collect())
            return poor[route](q)

        return run

    def rewrite(frame):
        for i, active in zip(frame["query_id"], frame["active_query"]):
            yield {1: {"query": active + " more", "problem": None}, 2: {"query": "  " + active.upper() + " ", "problem": None}, 3: None}[i]

    got = states(rl.run_loop(queries, {r: search(r) for r in poor}, chunks, reformulator=rl.by_function("refined", rl.REFINED, rewrite)))
    assert "cache timeout more" in asked
    assert got[1].abstention_reason == "unchanged_evidence" and got[1].active_query == "cache timeout more"
    assert got[2].abstention_reason == got[3].abstention_reason == "duplicate_reformulation"


def test_a_reformulation_before_any_search(tables):
    queries, chunks = tables

    def first_widen(df):
        start = (F.col("retrieval_calls") == 0) & (F.col("iteration_count") == 0)
        early = F.struct(F.lit("reformulate").alias("action"), F.lit(None).cast("string").alias("route"), F.lit("first").alias("reason"), F.lit(1.0).alias("confidence"))
        return df.withColumn("decision", F.when(start, early).otherwise(ct.rule_decision()))

    got = states(rl.run_loop(queries, SEARCH, chunks, controller=first_widen))
    assert all(r.iteration_count >= 1 and r.active_query.endswith("documentation usage") for r in got.values())
    assert all(r.status != "running" or r["at"] == "generate" for r in got.values())


def test_an_extractor_feeds_the_rules(tables):
    queries, chunks = tables
    plain = lambda df: rl.query_features(df).withColumn("has_code_terms", F.lit(True)).withColumn("has_multi_hop_terms", F.lit(False))
    got = states(rl.run_loop(queries, SEARCH, chunks, extractor=plain))
    assert {r.route for r in got.values()} == {"sparse"}


def test_adaptive_outputs_stand_beside_the_fixed_ones(spark, tables):
    queries, chunks = tables
    state, evidence = rl.run_loop(queries, SEARCH, chunks)
    answers = queries.select("query_id", F.lit("See [C1].").alias("first"), F.lit(None).cast("string").alias("second"))
    out = {r.query_id: r for r in fixed_systems.adaptive_outputs(rl.finish(state, evidence, answers), evidence).collect()}
    assert set(out) == {1, 2, 3} and {r.system_name for r in out.values()} == {"adaptive"}
    for r in out.values():
        assert r.status in ("completed", "abstained") and (r.abstention_reason is None) == (r.status == "completed")
        assert set(r.retrieved_chunk_ids) <= {"a", "b", "c"} and r.retrieval_calls <= 3
