"""Evidence, routing, packages and metrics on hand-computed cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions.quantiles import exact_quantiles
from citeloom.operators import compression as co
from citeloom.operators import controller as ct
from citeloom.operators import evidence as ev
from citeloom.operators import metrics, resampling, samples
from citeloom.plans import retrieval_loop as rl

EVIDENCE = "query_id long, chunk_id string, position int, document_id string, title string, source_uri string, text string, rerank_score double, retrieval_rank int"


def evidence(spark, *texts, scores=None):
    rows = [(1, f"c{i}", i + 1, f"d{i}", "T", f"u{i}", t, None if scores is None else scores[i], i + 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EVIDENCE)


@pytest.mark.parametrize("a,b,reason", [
    ("The default timeout is 30 seconds.", "The default timeout is 60 seconds.", "numeric_attribute_conflict"),
    ("Streaming is supported here.", "Streaming is not supported here.", "boolean_attribute_conflict"),
    ("Streaming is supported here.", "Streaming is deprecated here.", None),
    ("```\nlimit is 3\n```", "limit is 4", None),
])
def test_conflicts(spark, a, b, reason):
    got = [r.reason for r in ev.conflict_pairs(evidence(spark, a, b)).collect()]
    assert got == ([reason] if reason else [])


def test_sufficiency(spark):
    q = spark.createDataFrame([(1, "How does retrieval use ranking?"), (2, "nothing")], "query_id long, query string")
    got = {r.query_id: r for r in ev.sufficiency(q, evidence(spark, "retrieval uses ranking", "ranking is used", scores=[0.95, 0.9])).collect()}
    assert got[1].score >= 0.72 and got[1].status == "sufficient"
    assert got[2].score == 0 and got[2].low_evidence


def test_packing_budget_and_truncation(spark):
    ten = ev.pack_context(evidence(spark, *["x" * 5000] * 10), max_characters=12_000).head()
    assert len(ten.selected) == 2 and len(ten.omitted) == 8 and ten.total_characters <= 12_000
    cut = ev.pack_context(evidence(spark, "a<b&" * 2000), max_characters=1000).head()
    assert cut.selected == ["c0"] and cut.total_characters <= 1000 and ev.PACK_MARKER in cut.context
    assert "&" not in cut.context.replace("&amp;", "").replace("&lt;", "").replace("&gt;", "")
    assert cut.total_characters > 990


def test_citations(spark):
    df = spark.createDataFrame([("see [C2] [C1] [C2]",), ("[c1] x",), ("",), ("[C9]",)], "a string")
    got = [r.e for r in df.select(ev.citation_errors(F.col("a"), F.array(F.lit("C1"), F.lit("C2"))).alias("e")).collect()]
    assert got[0] == [] and "malformed:[c1]" in got[1] and "empty_answer" in got[2] and got[3] == ["unknown:C9"]


def test_sentences(spark):
    def cut(text):
        row = spark.createDataFrame([(text,)], "t string").select(co.boundaries(F.col("t")).alias("b")).first()
        return [tuple(e) for e in row.b]

    assert [t for t, _ in cut("See e.g. section 4.1 for details. Dr. Smith agreed with the result.")] == [
        "See e.g. section 4.1 for details.", "Dr. Smith agreed with the result."
    ]
    assert cut("- one\n- two\n  more\n\nNext. Last") == [("- one", "\n"), ("- two\n  more", "\n\n"), ("Next.", " "), ("Last", "")]
    assert cut("Item 3. Two. \"Three.\" x. Y") == [("Item 3. Two.", " "), ("\"Three.\" x. Y", "")] and cut(" \n\n ") == []
    three = "Aa bb. Cc dd. Ee ff."
    pairs = [(three, "Aa bb. Ee ff."), (three, "Cc dd. Aa bb."), (three, "Aa bb"), (three, three), (three, "")]
    df = spark.createDataFrame(pairs, "o string, k string").select(co.in_order(F.col("o"), F.col("k")).alias("x"))
    assert [r.x for r in df.collect()] == [True, False, False, True, False]


def test_rules_and_reformulation(spark):
    rows = [("hi there", 0, 0, "unknown", False), ("compare a vs b", 0, 0, "unknown", True), ("use `x_y`", 0, 0, "unknown", True), ("plain words", 1, 0, "insufficient", True), ("plain", 3, 0, "sufficient", True)]
    df = spark.createDataFrame(rows, "query string, retrieval_calls int, iteration_count int, evidence_status string, require_citations boolean")
    df = df.withColumns({"max_retrieval_calls": F.lit(3), "max_iterations": F.lit(3), "conflict_score": F.lit(0.0), "route": F.lit(None).cast("string"), "tried_routes": F.array().cast("array<string>"), "refinement_ready": F.lit(False)})
    got = [r.a for r in ct.query_features(df).select(ct.rule_decision()["action"].alias("a")).collect()]
    assert got == ["direct_answer", "retrieve_hybrid", "retrieve_sparse", "reformulate", "stop"]
    one = spark.createDataFrame([("what is x?",)], "q string").select(ct.reformulate(F.col("q"), F.array(F.lit("y"))).alias("r")).head().r
    assert one.query == "what is x documentation usage" and one.problem is None


def test_ranking_metrics(spark):
    s = spark.createDataFrame([(1,), (2,)], "query_id long")
    r = spark.createDataFrame([(1, "c1", 1), (1, "x", 2), (1, "c2", 3), (1, "c1", 4)], "query_id long, chunk_id string, rank int")
    g = spark.createDataFrame([(1, "c1"), (1, "c2")], "query_id long, chunk_id string")
    got = {x.query_id: x for x in metrics.ranking_metrics(s, r, g, ["query_id"]).collect()}
    ideal = 1 + 1 / np.log2(3)
    assert got[1].recall_at_1 == 0.5 and got[1].recall_at_3 == 1.0 and got[1].mrr == 1.0
    assert abs(got[1].ndcg_at_10 - (1 + 1 / 2) / ideal) < 1e-12
    assert got[2].recall_at_10 == 0.0 and got[2].ndcg_at_10 == 0.0


def test_exact_quantiles_match_numpy_for_small_and_large_groups(spark):
    rng = np.random.default_rng(3)
    values = {"small": [10.0, 20.0, 30.0, 40.0, 50.0], "large": list(np.round(rng.exponential(50, 60_000), 2))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "g string, v double")
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    for r in exact_quantiles(df, ["g"], "v", probs).collect():
        assert np.allclose([r[n] for n in probs], np.quantile(values[r.g], list(probs.values())))


def test_paired_test_finds_a_clear_gain(spark):
    rows = [(i, s, "m", 0.9 if s == "new" else 0.4 + 0.01 * (i % 3)) for i in range(50) for s in ("old", "new")]
    got = resampling.paired_tests(spark.createDataFrame(rows, "sample_id long, system_name string, metric string, score double"), "old", resamples=300).head()
    assert got.difference > 0.4 and got.ci_lower > 0.3 and got.p_value < 0.01 and got.significant


def test_substring_relevance_matches_a_plain_loop(spark):
    texts = [("Config guide", "set the max.retry value"), ("Notes", "maximum configuration"), ("Other", "nothing here at all")]
    e = spark.createDataFrame([(f"e{i}", t, x, i) for i, (t, x) in enumerate(texts)], "evidence_id string, title string, text string, position long")
    q = spark.createDataFrame([(1, "what is config max"), (2, "at ll")], "query_id long, query string")
    got = {(r.query_id, r.evidence_id): r.score for r in samples.substring_relevance(q, e, 5).collect()}
    want = {}
    for qid, words in ((1, ["config", "max"]), (2, ["ll"])):
        for i, (title, text) in enumerate(texts):
            score = sum(2 if w in title.lower() else 1 if w in text.lower() else 0 for w in words)
            if score:
                want[(qid, f"e{i}")] = float(score)
    assert got == want


@pytest.mark.parametrize("query_bytes, block_bytes", [(samples.QUERY_BYTES, samples.BLOCK_BYTES), (64, 64)])
def test_substring_relevance_keeps_k_rows_a_query_in_each_task(spark, monkeypatch, query_bytes, block_bytes):
    """Only the best rows leave a task; queries and evidence in blocks of any size and repeated ids give the same."""
    monkeypatch.setattr(samples, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(samples, "BLOCK_BYTES", block_bytes)
    words = ["red", "redder", "blue", "lue-x", "green", "ee"]
    rows = [(f"e{i % 90}", words[i % 6].upper() if i % 4 else None, None if i % 7 == 3 else f"{words[i % 5]} {words[i * i % 6]} re {i}", i) for i in range(100)]
    e = spark.createDataFrame(rows + [(None, "red", "red", 200)], "evidence_id string, title string, text string, position long").repartition(3)
    asked = [(1, "red ee the"), (2, "Lue lue gre"), (3, "nowhere"), (4, "1 re blue.")]
    q = spark.createDataFrame(asked + asked[:1], "query_id long, query string")
    scan = samples.substring_relevance(q, e, 4)
    got = {(r.query_id, r["rank"]): (r.evidence_id, r.score) for r in scan.collect()}
    want = {}
    for qid, text in asked:
        kept = {w for w in text.lower().split() if len(w) > 1 and w != "the"}
        score = lambda i: sum(2 if any(w in (t or "").lower() for e, t, _, _ in rows if e == i) else any(w in (x or "") for e, _, x, _ in rows if e == i) for w in kept)
        best = sorted(((-score(e), p, e) for e, _, _, p in rows if score(e)))[:4]
        want |= {(qid, n + 1): (e, float(-s)) for n, (s, _, e) in enumerate(best)}
    assert got == want


def test_loop_outcomes(spark):
    """Found at once, unchanged evidence, contradiction, and nothing found."""
    text = {"good": "alpha beta gamma is set", "weak": "unrelated", "c1": "limit is 3 alpha", "c2": "limit is 4 alpha"}
    chunks = spark.createDataFrame([(c, f"d{c}", "T", "u", t) for c, t in text.items()], "chunk_id string, document_id string, title string, source_uri string, text string")
    queries = spark.createDataFrame([(1, "alpha beta gamma"), (2, "omega psi chi"), (3, "alpha limit"), (4, "void empty")], "query_id long, query string")
    hits = spark.createDataFrame([(1, "good", 1), (2, "weak", 1), (3, "c1", 1), (3, "c2", 2)], "query_id long, chunk_id string, rank int").withColumn("score", F.lit(1.0))

    def search(q):
        return q.join(hits, "query_id").select("query_id", "chunk_id", "rank", "score")

    state, found = rl.run_loop(queries, {"dense": search}, chunks)
    answers = spark.createDataFrame([(1, "It is so [C1].", None)], "query_id long, first string, second string")
    got = {r.query_id: r for r in rl.finish(state, found, answers).collect()}
    assert got[1].status == "completed" and got[1].citations == ["C1"] and got[1].retrieval_calls == 1
    assert got[2].abstention_reason == "unchanged_evidence" and got[2].retrieval_calls == 2
    assert got[3].abstention_reason == "conflicting_evidence" and got[3].evidence_status == "conflicting"
    assert got[4].status == "abstained" and got[4].sufficiency_score == 0.0


def test_control_characters_of_a_text_are_kept_in_sentences(spark):
    running = "One \x05 two\x06 Three. \x07b Four\x07\x06! Five \x05\x06\x07c. Six"
    listed = "- a\x06b\n- c \x05\x07a d\n- e"
    for text, want in (
        (running, [("One \x05 two\x06 Three. \x07b Four\x07\x06!", " "), ("Five \x05\x06\x07c.", " "), ("Six", "")]),
        (listed, [("- a\x06b", "\n"), ("- c \x05\x07a d", "\n"), ("- e", "")]),
    ):
        row = spark.createDataFrame([(text,)], "t string").select(co.boundaries(F.col("t")).alias("b")).first()
        assert [tuple(e) for e in row.b] == want
        assert "".join(e.text + e.sep for e in row.b) == text


def test_texts_are_cut_into_sentences_in_one_go(spark):
    """The function gives what the expression gives, and no pattern of it runs in the row."""
    bits = ["a", "E.G.", "etc.", "fig.", "K.", "ſ.", "9.", "10)", "٣.", "é.", "Word.", "Xprof.", "-", "•", ".", "!\"", "?'", "\"", " ", " ", "　", "\x85", " ", "\x0b", "\x1d", "\r\n", "\n", "\n\n", "\t", "\x05", "\x06", "\x07a", "A", "É", "1", "😀"]
    texts = ["".join(random.Random(i).choices(bits, k=i % 40)) for i in range(600)] + [" ".join(random.Random(i).choices(bits, k=i % 30)) for i in range(600)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    both = df.select("i", co.boundaries(F.col("t")).alias("a"), co.boundaries_in_row(F.col("t")).alias("b"))
    assert both.filter("not (a <=> b)").count() == 0
    plan = df.select("i", co.boundaries(F.col("t")).alias("a")).select("i", F.size("a"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
