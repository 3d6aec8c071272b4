import itertools
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import chain, language
from citeloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, score string"
SYLLABLES = {"aa": ["lo", "ri", "ma", "ta"], "bb": ["sch", "ung", "zt", "ein"], "cc": ["ció", "que", "ñas", "lla"]}


def brute_marginals(score, moves, starts):
    out = np.zeros(score.shape)
    for path in itertools.product(range(score.shape[1]), repeat=len(score)):
        weight = np.exp(starts[path[0]] + sum(score[i, p] for i, p in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        for i, p in enumerate(path):
            out[i, p] += weight
    return out / out.sum(axis=1, keepdims=True)


def corpus(n=150, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        lang = ["aa", "bb", "cc"][int(rng.choice(3, p=[0.6, 0.3, 0.1]))]
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 5)))) for _ in range(int(rng.integers(3, 60)))), lang, "x"))
    return rows


@pytest.mark.parametrize("segment", [2, 64])
def test_marginals_are_those_of_all_paths(monkeypatch, segment):
    monkeypatch.setattr(chain, "SEGMENT", segment)
    rng, sizes = np.random.default_rng(0), [3, 0, 1, 7, 5, 4, 2, 6]
    score, moves, starts = rng.normal(0, 1, (sum(sizes), 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    got = chain.marginals(score, moves, starts, bounds)
    for a, b in zip(bounds, bounds[1:]):
        assert b == a or np.allclose(got[a:b], brute_marginals(score[a:b], moves, starts))


def test_expectations_are_gradients():
    rng = np.random.default_rng(1)
    score, moves, starts = rng.normal(0, 1, (2, 4, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    _, each, moved, started = chain.expectations(score, moves, starts)
    for array, grad in ((score.reshape(-1, 3), each), (moves, moved), (starts, started)):
        for at in np.ndindex(*array.shape):
            array[at] += 1e-5
            up = chain.expectations(score, moves, starts)[0]
            array[at] -= 2e-5
            down = chain.expectations(score, moves, starts)[0]
            array[at] += 1e-5
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-4


def test_held_out_documents_and_odd_rows(make):
    rows = corpus()
    rows += [(None, "sch ein ung", "bb", "x"), (900, None, "aa", "x"), (901, "", None, "x"), (902, "12 -- 7", "aa", "x"), (903, "lorima " * 40000, None, "x"), (3, rows[3][1], rows[3][2], "x")]
    docs = make(rows, SCHEMA)
    model = language.train(docs, ~language.held_out(F.col("doc_id")))
    assert model.names == ["aa", "bb", "cc"]
    found = language.detect(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and found.count() == len(rows)
    got = found.collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by_id[903].lang_pred == "aa" and by_id[None].lang_pred == "bb"


def test_held_out_labels_and_their_own_are_not_read(make):
    rows = corpus(80)
    turned = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 4 == 2 else x, s) for i, t, x, s in rows]
    a, b = (language.train(make(r, SCHEMA), ~language.held_out(F.col("doc_id"))) for r in (rows, turned))
    assert a.chain.dump() == b.chain.dump()
    one = {r.doc_id: (r.lang_pred, r.score) for r in language.detect(make(rows, SCHEMA), a).collect()}
    assert one == {r.doc_id: (r.lang_pred, r.score) for r in language.detect(make([(i, t, "zz", "y") for i, t, *_ in rows], SCHEMA), a).collect()}


def test_code_switched_runs(make):
    rows = corpus()
    model = language.fit([r[1] for r in rows], [r[2] for r in rows])
    text = "lorima talo mari tari lo schung einzt ung schein einung lolo mata rima lota"
    runs = sorted(language.label_runs(make([(5, text, None, "x"), (6, None, None, "x"), (7, "..", None, "x")], SCHEMA), model).collect(), key=lambda r: r.start)
    assert [(r.lang, text[r.start : r.stop].split()[0], r.words) for r in runs] == [("aa", "lorima", 5), ("bb", "schung", 5), ("aa", "lolo", 4)]


def test_nothing_to_learn_and_empty(make):
    docs = make([(1, "abc", None, "x"), (2, None, "en", "x")], SCHEMA)
    got = language.detect(docs, language.train(docs, F.lit(True))).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in got} == {(1, "und", 0.0), (2, "und", 0.0)}
    empty = make([], SCHEMA)
    assert language.detect(empty, language.train(empty, F.lit(True))).count() == 0


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{folder}/documents.parquet'").fetchall())
    got = QUERIES["op11_crf_language"](spark, folder).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.97
