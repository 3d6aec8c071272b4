"""Models as functions, fitted policies, vector index checks and the support gate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import controller, fusion, samples, sourcing, vectors


def test_embedding_and_pair_models(spark):
    texts = spark.createDataFrame([(i, "w " * i) for i in range(20)], "id long, text string").repartition(3)
    got = vectors.embed_rows(texts, "text", lambda: lambda batch: [[float(len(t)), 1.0] for t in batch], batch=4).collect()
    assert len(got) == 20 and all(r.embedding == [float(len(r.text)), 1.0] for r in got)
    pairs = spark.createDataFrame([(1, f"c{i}", i, "q", "t" * i) for i in range(1, 26)], "query_id long, chunk_id string, rank int, query string, text string")
    scored = fusion.score_pairs(pairs, lambda: lambda qs, ts: [len(t) for t in ts]).collect()
    assert sorted((r.chunk_id, r.rerank_score) for r in scored) == sorted((f"c{i}", float(i)) for i in range(1, 21))


def test_index_config(spark):
    meta = spark.createDataFrame([(64, "cosine")], "dim int, metric string")
    vectors.check_index_config(meta, dim=64)
    vectors.check_index_config(meta.limit(0), dim=3)
    for wrong in ({"dim": 32}, {"dim": 64, "metric": "dot"}):
        with pytest.raises(ValueError):
            vectors.check_index_config(meta, **wrong)


def test_bucketed_search_scores_what_shares_a_bucket(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    x[100] = x[0] * 3
    df = spark.createDataFrame([(f"c{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id string, embedding array<float>")
    asked = df.filter("chunk_id in ('c000', 'c007')").withColumnRenamed("chunk_id", "query_id")
    got = vectors.lsh_top_k(asked, df, 5, dim=8, bits=4, tables=6).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in got:
        assert abs(r.score - unit[int(r.query_id[1:])] @ unit[int(r.chunk_id[1:])]) < 1e-6
    best = {(r.query_id, r["rank"]): r.chunk_id for r in got}
    assert {best["c000", 1], best["c000", 2]} == {"c000", "c100"} and best["c007", 1] == "c007"


def neighbours(x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-scores[i], kind="stable")[:k]}


@pytest.mark.parametrize("clusters", [0, 300])
def test_bucketed_search_finds_nine_of_ten_neighbours(spark, monkeypatch, clusters):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    if clusters:
        x = rng.normal(size=(clusters, 64))[np.arange(3000) % clusters] + 0.25 * x
        x = np.concatenate([x, rng.normal(size=(5, 64))])  # these share buckets with few others
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<double>")
    seen = []
    inside = vectors._in_buckets
    monkeypatch.setattr(vectors, "_in_buckets", lambda *a: seen.append(a[4:]) or inside(*a))
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    got = vectors.lsh_top_k(df.withColumnRenamed("chunk_id", "query_id"), df, 10, dim=64).collect()
    want = neighbours(x, 10)
    hits = {(r.query_id, r.chunk_id) for r in got} & want
    others = {p for p in want if p[0] != p[1]}
    assert len(hits & others) / len(others) >= 0.9 and len(got) == 10 * len(x)
    assert bool(seen) == bool(clusters)  # buckets where they save work, else the exact search


def test_scores_are_held_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<double>").coalesce(1)
    sizes, whole = [], vectors._score_block
    monkeypatch.setattr(vectors, "SCORE_BYTES", 1 << 15)
    monkeypatch.setattr(vectors, "_score_block", lambda q, v: sizes.append(8 * len(q) * len(v)) or whole(q, v))
    table = df.withColumnRenamed("chunk_id", "query_id").toArrow()
    source = df.withColumnRenamed("chunk_id", "vector_id").toArrow()
    out = list(vectors._scan_with(table, 5, False)(iter(source.to_batches())))[0].to_pydict()
    assert max(sizes) <= 1 << 15 and set(zip(out["query_id"], out["vector_id"])) == neighbours(x, 5)


def test_policy_is_fitted_saved_checked_and_scored(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        kind = ("retrieve_sparse", "retrieve_dense", "stop")[i % 3]
        rows.append((i, [float(v) for v in rng.normal(0, 0.2, 10) + np.eye(10)[i % 3] * 3], kind))
    df = spark.createDataFrame(rows, "request_id long, features array<double>, label string")
    policy = controller.fit_policy(df)
    controller.save_policy(policy, str(tmp_path / "p"))
    scored = controller.score_policy(df, controller.load_policy(spark, str(tmp_path / "p")))
    assert scored.filter("predicted = label").count() == 240 and scored.filter("probability <= 0 or probability > 1").count() == 0
    broken = spark.createDataFrame([("stop", [float("nan")] * 10, 0.0)], "label string, weights array<double>, intercept double")
    with pytest.raises(ValueError):
        controller.save_policy(broken, str(tmp_path / "q"))
    broken.write.parquet(str(tmp_path / "r"))
    with pytest.raises(ValueError):
        controller.load_policy(spark, str(tmp_path / "r"))


def test_adoption_report(spark):
    rows = [("train", "web", "web", "local"), ("train", "web", "local", "web"), ("test", "local", "local", "local")]
    got = {r.split: (r.samples, r.learned_accuracy, r.rule_accuracy) for r in sourcing.gate_report(
        spark.createDataFrame(rows, "split string, expected_route string, predicted string, rule_route string")).collect()}
    assert got == {"train": (2, 0.5, 0.5), "test": (1, 1.0, 1.0)}


def test_gate_closes_when_support_is_lost(spark):
    before = spark.createDataFrame([(1, "a", 100), (1, "b", 50), (2, "c", 80)], "case_id long, evidence_id string, chars long")
    want = spark.createDataFrame([(1, "a"), (2, "c"), (3, "z")], "case_id long, evidence_id string")
    kept = samples.compression_gate(before, before.withColumn("chars", F.col("chars") / 2), want).first()
    lost = samples.compression_gate(before, before.filter("evidence_id <> 'c'"), want).first()
    assert (kept.eligible, kept.support_rate, kept.gate_open) == (2, 1.0, True) and kept.reduction_pct == 50.0
    assert (lost.eligible, lost.preserved, lost.gate_open) == (2, 1, False)
