"""Nothing is left out by length, rank or kind."""

from citeloom.queries.inputs import passage_matches


def test_passages_of_any_length(spark):
    texts = ["one two three four five six seven eight nine", "xone two threex", "a-b", "seven eight", "nothing", "o", ""]
    asked = ["one", "e", "one two", "two three", "one two three", "wo three four five six s", "one two three four five six seven", "a-b", "two three four five six seven eight ni", "zzz"]
    base = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = sorted((r.query_id, r.chunk_id) for r in passage_matches(queries, base).collect())
    assert got == sorted((i, f"c{j}") for i, q in enumerate(asked) for j, t in enumerate(texts) if q in t)
    assert passage_matches(queries.limit(0), base).count() == 0


def test_passages_sent_or_joined(spark):
    base = spark.createDataFrame([("a", "x\u00a0one two  three\nfour y"), ("a", "five six"), (None, "five six"), ("b", None), ("c", "öne two three föur"), ("d", "é five sixé")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "one two  three\nfour"), (2, "five six"), (2, "five six"), (None, "e two three f"), (3, None), (4, ""), (5, "two three four five six seven eight")], "query_id long, query string")
    pairs = lambda most: sorted(map(tuple, passage_matches(queries, base, most).collect()), key=str)
    assert pairs(1 << 20) == pairs(0) == sorted([(1, "a"), (2, "a"), (2, "d"), (None, "c")], key=str)
    plan = passage_matches(queries, base)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan
