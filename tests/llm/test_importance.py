import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from citeloom.llm import importance, prefix_crc

SCHEMA = "doc_id long, text string, weight string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def parts(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(rows, target, least=20, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for r in rows for f in parts(r[1])[1]), Counter(bucket(f) for x in target for f in parts(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for doc, text, *_ in rows:
        words, found = parts(text)
        each = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in map(bucket, found)]
        weight = sum(each) // len(each) if each else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_crc_of_any_run():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 70000):
        data = rng.integers(0, 256, n, dtype=np.uint8)
        prefix = prefix_crc.running(data)
        a, b = np.sort(rng.integers(0, n + 1, (2, 300)), axis=0)
        assert prefix_crc.crc_of_runs(prefix, a, b).tolist() == [zlib.crc32(data[i:j].tobytes()) for i, j in zip(a, b)]


def test_brute_force_with_odd_rows(make):
    rng = np.random.default_rng(2)
    words = ["Alpha", "béta", "GAMMA9", "x", "日本", "ÀB", "the", "of"]
    rows = [(i, " ,\n-"[i % 4].join(rng.choice(words, int(rng.integers(0, 60)))), "w") for i in range(200)]
    rows += [(None, "no id " * 30, "w"), (None, None, "w"), (300, "", "w"), (301, None, "w"), (302, "Zz" * 5000 + " many words" * 9000, "w"), (3, rows[3][1], "w"), (3, rows[3][1], "w"), (7, "x " * 25, "w")]
    target = ["alpha beta the of", "日本 x x x", None, ""]
    got = importance.importance(make(rows, SCHEMA), make([(t,) for t in target], "text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == brute(rows, target)


def test_drawn_documents_keep_their_columns(make):
    rows = [(i, f"word{i} " * 25, "w") for i in range(40)]
    docs = make(rows, SCHEMA)
    drawn = importance.resample(docs, make([("word3 word3",)], "text string"))
    assert drawn.columns == docs.columns and drawn.count() == 10 and {tuple(r) for r in drawn.collect()} <= set(rows)


def test_empty_tables(make):
    empty = make([], SCHEMA)
    assert importance.importance(empty, make([("a b",)], "text string")).count() == 0
    rows = [(1, "a b c", "w"), (2, None, "w")]
    got = importance.importance(make(rows, SCHEMA), make([], "text string"), least=1, percent=100)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == brute(rows, [], 1, 100)
