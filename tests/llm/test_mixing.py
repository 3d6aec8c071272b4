import numpy as np

from citeloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, row string"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in full and out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def corpus(n=6000):
    rng = np.random.default_rng(3)
    sources = ["a", "b", "é", "z", None, "big"]
    rows = []
    for i in range(n):
        s = sources[min(5, int(rng.integers(0, 12)))]
        rows.append((i, " ".join(["w"] * int(rng.integers(1, 60))), s, "x"))
    return rows + [(None, None, "a", "x"), (7, "  ", "b", "x"), (8, "one two", "b", "x"), (8, "one two", "b", "x"), (9, "w " * 5000, "tiny", "x")]


def test_targets_and_copies(make):
    rows = corpus()
    got = mixing.mix(make(rows, SCHEMA), group=64).collect()
    assert len(got) == len(rows)
    sizes, taken, target, largest = {}, {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.copies
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= largest[s]
    shares = {r.source: r.target / r.source_size for r in got if r.source_size}
    assert all(int(shares[r.source]) <= r.copies <= int(shares[r.source]) + 1 for r in got if r["size"])


def test_reruns_agree_however_rows_are_split(make):
    rows = [r for r in corpus(800) if r[0] is not None and r[0] not in (7, 8)]
    one = sorted((r.doc_id, r.copies) for r in mixing.mix(make(rows, SCHEMA, 2), group=50).collect())
    two = sorted((r.doc_id, r.copies) for r in mixing.mix(make(rows[::-1], SCHEMA, 5), group=50).collect())
    assert one == two


def test_expected_copies_are_the_fractions():
    rng, hits = np.random.default_rng(0), np.zeros(7)
    p, size = np.array([0.3, 0.3, 0.9, 0.5, 0.25, 0.25, 0.5]), np.array([1.0, 5, 2, 9, 4, 4, 1])
    for _ in range(4000):
        out, left = mixing.pair_off(p, size, rng.random(7))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-9
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != left)
        hits += out
    assert np.abs(hits / 4000 - p).max() < 0.04


def test_mixed_corpus_and_empty_table(make):
    rows = corpus(300)
    mixed = mixing.mix_documents(make(rows, SCHEMA), group=40)
    assert mixed.columns == ["doc_id", "text", "source", "row"] and mixed.count() > 0
    assert mixing.mix(make([], SCHEMA)).count() == 0
    blank = mixing.mix(make([(1, "", "a", "x"), (2, None, None, "x")], SCHEMA)).collect()
    assert sorted(r.copies for r in blank) == [0, 0]
