import re
from collections import Counter

import numpy as np
import pytest

from citeloom.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string"


def brute_counts(rows, least, longest=5):
    out, total = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            out.update((lang, " ".join(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return {p: f for p, f in out.items() if f >= least}, {lang: n for lang, n in total.items() if n}


def brute(rows, least, top, percent=100):
    f, total = brute_counts(rows, least)
    found = {}
    for (lang, phrase), a in f.items():
        w = phrase.split(" ")
        if len(w) < 2:
            continue
        around = [b for (other, q), b in f.items() if other == lang and len(q.split(" ")) > len(w) and f" {phrase} " in f" {q} "]
        if any(100 * b >= percent * a for b in around):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, k, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, phrase.encode(), a, left, right))
    return sorted((lang, i + 1, r[2].decode(), r[3], r[4], r[5], total[lang], -r[0]) for lang, rs in found.items() for i, r in enumerate(sorted(rs)[:top]))


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["Of", "the", "a b", "été", "x", "y", "Z", "r$", "(a)", "\x01"]
    weights = np.array([9, 8, 3, 2, 2, 2, 1, 1, 1, 1]) / 30
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words, p=weights) + rng.choice([" ", "\t ", "  ", ". ", "\n", ","], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05]) for _ in range(int(rng.integers(0, 40))))
        rows.append((i, text, [None, "en", "fr", "und"][i % 4] if i % 3 else "en", "x"))
    return rows + [(None, "of the x of the x " * 40, "en", "x"), (5, None, "en", "x"), (6, "", None, "x"), (6, " .\t", None, "x"), (7, "x x x x x x x x. " * 30, None, "x")] + rows[:3]


@pytest.mark.parametrize("shards, bits", [(3, 1 << 14), (2, 64)])
def test_brute_force(make, shards, bits):
    rows = corpus(shards)
    counts = collocations.phrase_counts(make(rows, SCHEMA, 5), least=12, shards=shards, bits=bits)
    f, total = brute_counts(rows, 12)
    got = {(r.lang, r.phrase): r.f for r in counts.collect()}
    assert got == f | {(lang, ""): n for lang, n in total.items()}
    found = collocations.collocations(counts, top=7).drop("cut")
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 12, 7)


def test_long_phrases_reached_late(make):
    # words that pass the threshold only with the last shard: every length needs a round of its own
    rows = [(i, f"alpha beta gamma delta epsilon. filler{i}", "en", "x") for i in range(12)]
    counts = collocations.phrase_counts(make(rows, SCHEMA, 4), least=12, shards=4)
    assert {r.phrase: r.f for r in counts.filter("k = 5").collect()} == {"alpha beta gamma delta epsilon": 12}




def test_phrases_are_spelled_at_their_home_only(make, monkeypatch):
    # the same texts in each of 12 partitions: as many spelled rows as phrases, not as many as phrases times tasks
    spelled, plain = [], collocations.spellings
    monkeypatch.setattr(collocations, "spellings", lambda *args: spelled.append(plain(*args).localCheckpoint()) or spelled[0])
    rows = [(12 * j + i, "red green blue red green", "en", "x") for i in range(12) for j in range(4)]
    counts = collocations.phrase_counts(make(rows, SCHEMA, 12), least=12, shards=2)
    f, total = brute_counts(rows, 12)
    assert {(r.lang, r.phrase): r.f for r in counts.collect()} == f | {(lang, ""): n for lang, n in total.items()}
    assert spelled[0].count() == len(f) + len(total)


def test_scores_pass_64_bits(spark):
    big = 3 * 10**15
    rows = [("en", "", 0, big), ("en", "p", 1, 10**15), ("en", "q", 1, 2 * 10**15 + 1), ("en", "p q", 2, 10**15 - 7)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, phrase string, k int, f long")).first()
    assert got.score == 1000 * (10**15 - 7) * big // (10**15 * (2 * 10**15 + 1))


def test_empty_table(make):
    counts = collocations.phrase_counts(make([], SCHEMA))
    assert counts.count() == 0 and collocations.collocations(counts).count() == 0
