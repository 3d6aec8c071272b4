import random

import numpy as np

from citeloom.llm import suffix_blocks as sb
from citeloom.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, name string, spans string"


def brute(texts):
    """(bytes, removed, runs, kept) of each text."""
    seen, raw = {}, [(t or "").encode() for t in texts]
    for t in raw:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)

    def words(n):
        return " ".join(rng.choice("abcdeéö") * rng.randint(1, 3) + rng.choice(["x", "yy", "ß"]) + str(rng.randrange(40)) for _ in range(n))

    shared = [words(rng.randint(20, 90)) for _ in range(6)]
    line = words(14)
    texts = []
    for i in range(60):
        parts = [words(rng.randint(5, 60))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), words(rng.randint(1, 30))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts)), line)
        texts.append(" ".join(parts))
    copy = texts[5]
    near = copy[:150] + "#" + copy[151:]
    return texts + [copy, copy, near, near + "!", None, "", "", "short", "a" * 700, "ab" * 300 + "c", "abc" * 120, ("long " + words(30)) * 9, "é" * 99, "é" * 100]


def test_against_brute_force(make):
    for seed, size in ((1, 1 << 22), (2, 3000)):
        texts = corpus(seed)
        rows = [(i if i != 3 else None, t, "x", "y") for i, t in enumerate(texts)]
        got = sd.remove_repeats(make(rows, SCHEMA), bucket_bytes=size).collect()
        want = [(r[0], *w) for r, w in zip(rows, brute(texts))]
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == sorted(want, key=repr)


def test_pieces_of_a_long_text(make, monkeypatch):
    rng = random.Random(9)
    body = "".join(rng.choice("abcdefgh") for _ in range(5000))
    texts = [body + "0" + body[1000:3000], "zz" + body[4500:4800] + "y" * 50]
    batch = __import__("pyarrow").RecordBatch.from_pydict({"text": texts[:1]})
    parts = list(sd.pieces(batch, 1024))
    raw = texts[0].encode()
    starts = {int(p[3][0]) + i for p in parts for i in range(len(p[0]) - sb.DEPTH + 1)}
    assert starts == set(range(len(raw) - sb.DEPTH + 1)) and sum(len(p[0]) - sb.DEPTH + 1 for p in parts) == len(starts)
    assert all(bytes(p[0]) == raw[int(p[3][0]) : int(p[3][0]) + len(p[0])] for p in parts)
    got = sd.remove_repeats(make([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == [(i, *w) for i, w in enumerate(brute(texts))]


def test_cover_and_comparison():
    assert {(a - b) % sb.PERIOD for a in sb.COVER for b in sb.COVER} == set(range(sb.PERIOD))
    rng = np.random.default_rng(0)
    base = rng.integers(97, 99, 900).astype(np.uint8)
    text = np.concatenate([base, base[100:700], rng.integers(97, 100, 300).astype(np.uint8), base[50:400]])
    s, data = sb.Suffixes(text), text.tobytes()
    a, b = (rng.integers(0, len(text) - sb.DEPTH, 4000) for _ in range(2))
    b[:1500] = np.where(a[:1500] >= 900, a[:1500] - 800, a[:1500] + 800)
    b = np.clip(b, 0, len(text) - sb.DEPTH)
    want = [(data[i : i + 200] > data[j : j + 200]) - (data[i : i + 200] < data[j : j + 200]) for i, j in zip(a, b)]
    assert s.compare(a, b).tolist() == want and 0 in want
    places = np.arange(len(text) - sb.DEPTH + 1)
    strings = [data[i : i + 200] for i in places]
    times = {x: strings.count(x) for x in set(strings)}
    assert s.repeated(places, s.word(places, 0)).tolist() == [times[x] > 1 for x in strings]


def test_frequent_runs_and_empty(make):
    line = b"the same line stands in every text of this sample, again"
    runs = sd.frequent_runs([bytes([97 + i % 26]) * 30 + line + str(i).encode() * 10 for i in range(60)])
    assert len(runs) >= len(line) - sd.GRAM + 1
    assert sd.remove_repeats(make([], SCHEMA)).count() == 0
    assert sd.remove_repeats(make([(1, None, "x", "y")], SCHEMA)).first().n_bytes == 0


def test_a_passage_that_no_sample_sees_fills_no_bucket(make):
    import zstandard

    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))
    passage = letters(260)
    texts = [letters(rng.randint(100, 300)) + passage + letters(rng.randint(100, 300)) for _ in range(800)]
    docs = make([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).select("doc_id", "text")
    bound = 32 << 10
    heavy = sd.heavy_anchors(docs, None, bound, 1)
    assert len(heavy)
    largest = {}
    for kind, args in (("before", ()), ("after", (heavy,))):
        size = {}
        for r in sd.deal(docs, 1 << 16, None, *args).filter("kind = 0").collect():
            size[r.bucket] = size.get(r.bucket, 0) + len(zstandard.ZstdDecompressor().decompress(bytes(r.payload)))
        largest[kind] = max(size.values())
    assert largest["before"] > 2 * bound and largest["after"] <= bound
    got = sd.remove_repeats(docs, bucket_bytes=bound).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == [(i, *w) for i, w in enumerate(brute(texts))]


def test_anchors_of_long_texts_are_counted_in_slices(make):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))
    passage = letters(260)
    texts = ["".join(letters(400) + passage for _ in range(600)) for _ in range(2)]
    docs = make([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).select("doc_id", "text")
    whole, some = (set(np.frombuffer(sd.heavy_anchors(docs, None, 100_000, every), np.uint64).tolist()) for every in (1, 4))
    assert whole and whole & some
