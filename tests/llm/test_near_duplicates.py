import random
import re

from citeloom.llm import graph, near_duplicates as nd

SCHEMA = "doc_id long, text string, n string, x string, node string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(s), low.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed, families=30, size=6):
    rng, rows = random.Random(seed), []
    for f in range(families):
        base = [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice("xyz") + str(rng.randrange(50))
            rows.append((len(rows), " ".join(words), "x", "x", "x"))
    return rows


def test_against_brute_force(make):
    rows = corpus(1)
    rows += [(5000, None, "x", "x", "x"), (5001, "", "x", "x", "x"), (5002, " \n\t", "x", "x", "x"), (None, "no id at all here friend", "x", "x", "x"),
             (5003, "A\x0bB c D\x0ce F", "x", "x", "x"), (5004, "a b c d e f", "x", "x", "x"), (5005, "a b c d e f", "x", "x", "x"), (5006, "A b", "x", "x", "x"), (5007, "a B", "x", "x", "x"),
             (7, rows[7][1], "x", "x", "x"), (5008, " ".join(f"w{i}" for i in range(30000)), "x", "x", "x"), (5009, "START " + " ".join(f"w{i}" for i in range(30000)), "x", "x", "x")]
    got = nd.groups(make(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_through_nodes_outside_the_best_pairs(make):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):  # a chain: each differs a little from the one before
        words = list(words)
        for _ in range(8):
            words[rng.randrange(400)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "x", "x", "x"))
    got = nd.groups(make(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_group_of_copies_and_dropping(make):
    rows = [(i, "the same long text with more than five words", "x", "x", "x") for i in range(500)] + [(900, "another", "x", "x", "x"), (None, "another", "x", "x", "x")]
    kept = nd.drop_near_copies(make(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n", "x", "node"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "900", "None"]
    assert nd.groups(make([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 90)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {i: root(i) for e in edges for i in e if e[0] != e[1]}
    assert got == want
