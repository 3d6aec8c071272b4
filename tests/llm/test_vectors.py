import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import metric_tree, pruned_graph, vector_cells

SCHEMA = "vec_id long, embedding array<float>, id string, v string"


def table(n=700, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)], "x", "y") for i in range(n)]
    rows += [(n + i, rows[3][1], "x", "y") for i in range(60)]  # one vector many times
    rows += [(3, rows[3][1], "x", "y"), (None, rows[4][1], "x", "y"), (9000, None, "x", "y"), (9010, [], "x", "y"), (9020, [None] * dim, "x", "y"),
             (9030, [float("nan")] * dim, "x", "y"), (9040, [float("inf")] * dim, "x", "y"), (9050, [0.0] * dim, "x", "y"), (9060, [1.0, 2.0], "x", "y")]
    return rows


def usable(rows):
    return {r[0]: np.array(r[1], np.float64) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all()}


def test_tree_against_brute_force(make):
    rows = table()
    df = vector_cells.usable(make(rows, SCHEMA), "vec_id", "embedding").select("id", vector_cells.quantised(F.col("v")).alias("v"))
    got = {}
    for r in metric_tree.top_products(df, vector_cells.divisible(df, 20), 20, shard=200, block=30).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    held = {i: np.floor(64 * v) for i, v in usable(rows).items()}
    for q in (i for i in held if i % 20 == 0):
        scored = sorted((-int(held[q] @ v), i) for i, v in held.items() if i != q and len(v) == len(held[q]))[:20]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]


def test_stored_bounds_save_distances():
    rng = np.random.default_rng(0)
    centers = rng.integers(-60, 60, (12, 8))
    x = np.unique((centers[rng.integers(0, 12, 1500)] + rng.integers(-3, 4, (1500, 8))).astype(float), axis=0)
    import pandas as pd

    group = pd.DataFrame({"dim": 8, "shard": 0, "v": list(x), "ids": [[i] for i in range(len(x))]})
    tree = metric_tree.Tree(metric_tree.build(group))
    for q in x[:20]:
        got = tree.nearest(q, 5)
        want = sorted(((float(x[i] @ q), -i) for i in range(len(x))), reverse=True)[:5]
        assert [(s, -i[0]) for s, _, i in got] == want
    assert tree.computed < 0.5 * 20 * len(x)


def test_graph_recall_and_exact_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    df = vector_cells.usable(vectors, "vec_id", "embedding")
    got = pruned_graph.nearest(df, vector_cells.divisible(df, 50), 5, shard=1100).collect()
    held = usable([(r.vec_id, r.embedding) for r in vectors.collect()])
    ids = np.array(sorted(held))
    x = np.stack([held[i] for i in ids])
    norms, hits, total = np.sqrt((x * x).sum(1)), 0, 0
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i in held if i % 50 == 0}
    for q, rows in found.items():
        cos = x @ held[q] / norms / np.sqrt(held[q] @ held[q])
        order = [i for i in ids[np.lexsort((ids, -cos))] if i != q][:5]
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - cos[np.searchsorted(ids, r.vec_id)]) < 1e-12 for r in rows)
        hits, total = hits + len(set(order) & {r.vec_id for r in rows}), total + 5
    assert hits / total >= 0.9


def test_graph_cases(make):
    rows = table(120)
    df = vector_cells.usable(make(rows, SCHEMA), "vec_id", "embedding")
    got = {}
    for r in pruned_graph.nearest(df, vector_cells.divisible(df, 1).filter("id in (3, 0, 125, 9050, 9060)"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert set(got) == {3, 0, 125}  # a zero vector is no query, and nothing has the length of 9060 but itself
    assert sorted(got[3]) == [(k + 1, 120 + k, 1.0) for k in range(5)]
    assert sorted(got[125]) == [(1, 3, 1.0)] + [(k + 2, 120 + k, 1.0) for k in range(4)]


@pytest.mark.parametrize("op", [lambda a, b: metric_tree.top_products(a, b, 5), lambda a, b: pruned_graph.nearest(a, b, 5)])
def test_nothing_usable(make, op):
    df = vector_cells.usable(make([(1, None, "x", "y")], SCHEMA), "vec_id", "embedding")
    assert op(df, df).count() == 0
    few = vector_cells.usable(make([(1, [1.0, 0.0], "x", "y"), (2, [1.0, 1.0], "x", "y")], SCHEMA), "vec_id", "embedding")
    assert sorted((r.query_id, r.vec_id) for r in op(few, few).collect()) == [(1, 2), (2, 1)]
