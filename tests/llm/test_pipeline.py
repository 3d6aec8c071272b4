"""Each stage of the pipeline against a brute-force version on its own input."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from citeloom.llm import toxicity
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_duplicates import brute as brute_groups
from tests.llm.test_packing import reference_ids

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_columns_stay(steps):
    assert [name for name, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    for _, _, before, after in steps[:-1]:
        assert tuple(before) == tuple(after) == cp.COLUMNS


def test_toxic_documents_go(steps, spark):
    before, after, *_ = steps[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert kept <= {r.doc_id for r in before}
    bad = [i for i, t in labels.items() if t and zlib.crc32(str(i).encode()) % 3 != 1]
    good = [i for i, t in labels.items() if not t]
    assert np.mean([i not in kept for i in bad]) > 0.8 and np.mean([i in kept for i in good]) > 0.95
    assert toxicity.THRESHOLD == 0.7


def test_lines(steps):
    before, after, *_ = steps[1]
    want = brute_lines([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == {r.doc_id: want[r.doc_id, r.text] for r in before}
    assert all(r.n_chars == len(r.text) for r in after)


def test_groups(steps):
    before, after, *_ = steps[2]
    want = Counter(r[0] for r in brute_groups([(r.doc_id, r.text) for r in before]) if r[0] == r[2])
    assert Counter(r.doc_id for r in after) == want


def test_mix(steps):
    before, after, *_ = steps[3]

    def words(text):
        return len((text or "").encode().split())

    sizes, taken, most = Counter(), Counter(), Counter()
    for r in before:
        sizes[r.source] += words(r.text)
        most[r.source] = max(most[r.source], words(r.text))
    for r in after:
        taken[r.source] += words(r.text)
    for s, want in brute_targets(sizes).items():
        assert abs(taken[s] - want) <= most[s]
    assert max(Counter(r.doc_id for r in after).values()) <= 3


def test_pieces(steps):
    before, after, *_ = steps[4]
    want, got = Counter(), Counter()
    for r in before:
        want[r.doc_id] += len(reference_ids(r.text)) if len(r.text or "") < 2000 else 0
    for r in after:
        got[r.doc_id] += r.length
    assert all(got[i] == n for i, n in want.items() if n and all(len(x.text or "") < 2000 for x in before if x.doc_id == i))
    assert len({r.sequence_id for r in after}) == len(after)


def test_run(spark):
    assert cp.run(spark, FOLDER).filter("offset <> 0 OR length > 1024").count() == 0
