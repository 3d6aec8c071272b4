import zlib

import numpy as np
from pyspark.sql import functions as F

from citeloom.llm import toxicity

SCHEMA = "doc_id long, text string, score string"


def corpus(n=400):
    rng, rows, labels = np.random.default_rng(5), [], []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdeimnorst"), 5)) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[int(rng.integers(0, 30))] = ["grumpf", "zlurk", "qvex"][i % 3]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad), "x"))
    return rows, labels


def test_held_out_accuracy_and_clashing_columns(make):
    rows, labels = corpus()
    rows += [(None, "no id", "x"), (1000, "", "x"), (1001, None, "x"), (1002, "ab", "x"), (1003, "zlurk " * 20000, "x"), (3, rows[3][1], "x")]
    labels += [(None, 1, "x"), (5, None, "x"), (4, 1, "x"), (4, 0, "x")]
    docs, marks = make(rows, SCHEMA), make(labels, "doc_id long, toxic int, text string")
    model = toxicity.train(docs, marks, ~toxicity.held_out(F.col("doc_id")))
    got = {}
    for r in toxicity.score(docs, model).collect():
        assert got.setdefault((r.doc_id, r.text), r.score) == r.score and 0 <= r.score <= 1
    truth = {i: t for i, t, _ in labels if i is not None and t is not None and i % 4 == 0 or i}
    held = [(k, s) for (k, _), s in got.items() if k is not None and k < 400 and zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == (k % 4 == 0) for k, s in held]) > 0.95 and truth
    assert got[(1000, "")] == got[(1001, None)] == got[(1002, "ab")] < 0.5


def test_labels_held_out_are_not_read(make):
    rows, labels = corpus(200)
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in labels]
    docs = make(rows, SCHEMA)
    turned = [(i, 1 - t if h else t, x) for (i, t, x), h in zip(labels, held)]
    a, b = (toxicity.train(docs, make(m, "doc_id long, toxic int, text string"), ~toxicity.held_out(F.col("doc_id"))) for m in (labels, turned))
    assert a.prior == b.prior and (a.weights == b.weights).all()


def test_grams_are_distinct_and_complete():
    seen = np.zeros(toxicity.FEATURES, np.int32)
    text = "Abcabcé🙂abc"
    want = {text.lower()[i : i + n] for n in toxicity.ORDERS for i in range(len(text) - n + 1)}
    got = toxicity.grams(text, seen)
    assert len(got) == len(set(got.tolist())) == len(want)
    assert len(toxicity.grams("ab", seen)) == 0 and len(toxicity.grams("", seen)) == 0


def test_one_class_none_and_empty(make):
    assert toxicity.fit([], np.array([])).score("x y z", np.zeros(toxicity.FEATURES, np.int32)) < 0.01
    assert toxicity.fit(["abc"], np.array([True])).score("anything", np.zeros(toxicity.FEATURES, np.int32)) > 0.99
    empty = make([], SCHEMA)
    model = toxicity.train(empty, make([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(empty, model).count() == 0


def test_sample_is_fitted_in_a_task(make, monkeypatch):
    rows, labels = corpus(80)
    docs, marks = make(rows, SCHEMA), make(labels, "doc_id long, toxic int, text string")
    monkeypatch.setattr(type(docs), "toArrow", lambda self: (_ for _ in ()).throw(AssertionError("texts on the driver")))
    assert toxicity.train(docs, marks, F.lit(True)).weights.any()


def brute_cost(z, toxic):
    best = None
    for t in [z.max() + 2, *((a + b) / 2 for a, b in zip(sorted(set(z), reverse=True), sorted(set(z), reverse=True)[1:])), z.min() - 2]:
        lost, missed = (z > t)[~toxic].mean(), (z <= t)[toxic].mean()
        if lost <= toxicity.CLEAN_LOSS and (best is None or missed + toxicity.CLEAN_WEIGHT * lost < best[0] - 1e-12):
            best = (missed + toxicity.CLEAN_WEIGHT * lost, t)
    return best[0]


def test_border_is_the_cheapest():
    rng = np.random.default_rng(4)
    for n in (10, 80, 400):
        toxic = rng.random(n) < 0.3
        toxic[:2] = [True, False]
        z = np.round(rng.normal(0, 1, n) + 1.5 * toxic, 1)  # with ties
        called = z > toxicity.border(z, toxic)
        assert called[~toxic].mean() <= toxicity.CLEAN_LOSS
        assert abs((~called[toxic]).mean() + toxicity.CLEAN_WEIGHT * called[~toxic].mean() - brute_cost(z, toxic)) < 1e-9


def test_clean_rows_stay_at_the_shipped_threshold(spark):
    """Held-out labels of two tables of different size: the share of classes in the sample does not depend on it."""
    for size, least in (("0.01", 0.3), ("0.1", 0.55)):
        folder = f"/root/testdata/sf{size}"
        docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
        model = toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id")))
        truth = {r.doc_id: bool(r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
        called = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).collect()}
        assert np.mean([not called[i] for i, t in truth.items() if not t]) >= 0.97
        assert np.mean([called[i] for i, t in truth.items() if t]) >= least


def test_sample_keeps_the_ratio_of_classes(make):
    rows, labels = corpus(400)
    chosen = toxicity.sample(make(rows, SCHEMA), make(labels, "doc_id long, toxic int, text string"), F.lit(True), rows=200).collect()
    assert len(chosen) == 200 and 0.15 < np.mean([r.toxic for r in chosen]) < 0.35
