import random

from citeloom.llm import lines

SCHEMA = "doc_id long, text string, n_lines string, id string"


def brute(rows, width=3):
    """{(doc_id, text): remaining text}, the first of equal windows in order of id (None last)."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = set(), {(r[0], None): None for r in rows if r[1] is None}
    for doc_id, text in docs:
        parts, gone = text.split("\n"), set()
        for i in range(max(1, len(parts) - width + 1)):
            key = tuple(parts[i : i + width])
            if key in seen:
                gone |= set(range(i, min(i + width, len(parts))))
            seen.add(key)
        out[doc_id, text] = "\n".join(p for i, p in enumerate(parts) if i not in gone)
    return out


def test_against_brute_force(make):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))), "x", "y") for i in range(60)]
    rows += [(100, None, "x", "y"), (101, "", "x", "y"), (102, "", "x", "y"), (103, "\n\n\n\n", "x", "y"), (None, "no\nid\nhere\nat", "x", "y"),
             (104, "\n".join(str(i) for i in range(3000)) + "\nno\nid\nhere", "x", "y"), (5, rows[5][1], "x", "y")]
    got = lines.remove_repeats(make(rows, SCHEMA)).collect()
    want = brute(rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(want[r[0], r[1]])
    assert len(got) == len(rows)
    for r in got:
        assert r.text in by_id[r.doc_id] and r.id == "y"
        assert r.n_removed >= 0 and r.n_removed <= r.n_lines
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str((r[0], want[r[0], r[1]])) for r in rows)


def test_empty_and_no_python_in_the_plan(make):
    df = lines.remove_repeats(make([], SCHEMA))
    assert df.count() == 0 and df.columns == ["doc_id", "text", "id", "n_lines", "n_removed"]
    assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()


def test_long_texts_cost_what_they_hold(make):
    """Twice the lines, about twice the work: 24 000 lines with one repeated window."""
    from time import perf_counter

    def seconds(n):
        head = "one\ntwo\nthree\n"
        docs = make([(1, head, "x"), (2, head + "\n".join(f"line {n} {i}" for i in range(n)), "x")], "doc_id long, text string, extra string")
        start = perf_counter()
        got = {r.doc_id: r for r in lines.remove_repeats(docs).collect()}
        assert got[2].n_removed == 3 and got[2].text.startswith(f"line {n} 0")
        return perf_counter() - start

    seconds(100)
    small, large = seconds(12_000), seconds(24_000)
    assert large < 2.6 * small + 2
