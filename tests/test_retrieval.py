"""Search against plain-Python formulas on small fixtures, including ties, padding and odd indexes."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators import fusion, lexical, vectors


def tokens(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(tx.tokens(F.col("t")).alias("x")).head().x


def test_tokenizer_examples(spark):
    assert tokens(spark, "The Qdrant_Client.Models returns HTTP_422 for snake_case --flag /v1/items.") == [
        "qdrant_client.models", "returns", "http_422", "snake_case", "--flag", "/v1/items"
    ]
    assert tokens(spark, "if x == 10 and y != 20 and count <= 5 and limit >= 3:") == "if x == 10 y != 20 count <= 5 limit >= 3".split()
    assert tokens(spark, " ".join(tx.STOPWORDS)) == []
    assert tokens(spark, "ﬁne Ｗｏｒｄ") == ["fine", "word"]


def chunks(spark, texts):
    rows = [(f"c{i}", f"{i:03x}doc", 0, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, ordinal int, text string")


def brute_bm25(texts, query, k, k1=1.5, b=0.75):
    toks = [t.lower().split() for t in texts]
    avg = sum(map(len, toks)) / len(toks)
    nd = Counter(w for t in toks for w in set(t))
    raw = {w: math.log(len(toks) - n + 0.5) - math.log(n + 0.5) for w, n in nd.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    scores = []
    for i, t in enumerate(toks):
        tf = Counter(t)
        s = sum(idf.get(w, 0) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / avg)) for w in query.lower().split())
        scores.append((-round(s, 9), i))
    return [(f"c{i}", -s + 0.0) for s, i in sorted(scores)[:k]]


def stored(spark, texts, folder):
    lexical.save_index(lexical.build_index(chunks(spark, texts)), str(folder))
    return lexical.load_index(spark, str(folder))


def test_bm25_matches_the_formula_with_padding(spark, tmp_path):
    texts = ["alpha common beta", "beta common", "common gamma gamma", "common delta", "alpha alpha common", "eps", "beta beta beta common"]
    asked = ["alpha beta beta", "gamma", "zeta", "alpha common"]
    index = stored(spark, texts, tmp_path / "ix")
    q = spark.createDataFrame([*enumerate(asked), (7, " "), (8, "of the")], "query_id long, query string")
    got = {}
    for r in lexical.bm25_top_k(index, q, 6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.score))
    assert set(got) == set(range(len(asked)))
    for i, query in enumerate(asked):
        want = brute_bm25(texts, query, 6)
        mine = sorted(got[i])
        assert [c for _, c, _ in mine] == [c for c, _ in want]
        assert np.allclose([s for _, _, s in mine], [s for _, s in want])
    assert {(r.query_id, r.reason) for r in lexical.rejected_queries(q).collect()} == {(7, "blank_query"), (8, "no_tokens")}
    assert lexical.snapshot_problems(index).count() == 0


def test_negative_floor_ranks_padding_above_matches(spark, tmp_path):
    texts = ["same word", "same word", "same word other"]
    q = spark.createDataFrame([(1, "same")], "query_id long, query string")
    got = lexical.bm25_top_k(stored(spark, texts, tmp_path / "ix"), q, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [c for c, _ in brute_bm25(texts, "same", 3)]


def vector_table(spark, n, dim, seed, name):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim)], f"s{i % 3}") for i in range(n)]
    rows += [(n + i, rows[0][1], "s0") for i in range(5)]  # exact copies tie
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>, tag string")


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_cosine_paths_agree_with_numpy(spark, limit):
    q = vector_table(spark, 7, 8, 1, "query_id").withColumn("filter_value", F.when(F.col("query_id") % 2 == 0, F.col("tag")))
    v = vector_table(spark, 60, 8, 1, "chunk_id")
    got = {}
    for r in vectors.cosine_top_k(q, v, 4, filter_column="tag", broadcast_bytes=limit).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    vs = [(r.chunk_id, np.array(r.embedding, dtype=float), r.tag) for r in v.collect()]
    for r in q.collect():
        e = np.array(r.embedding, dtype=float)
        scored = sorted((-round(float(e @ x / np.linalg.norm(e) / np.linalg.norm(x)), 9), i) for i, x, t in vs if r.filter_value in (None, t))
        assert [c for _, c in sorted(got[r.query_id])] == [i for _, i in scored[:4]]


def results(spark, rows):
    return spark.createDataFrame([(1, c, r, 1.0 / r) for c, r in rows], "query_id long, chunk_id string, rank int, score double")


def test_rank_fusion_numbers_and_ties(spark):
    fused = fusion.reciprocal_rank_fusion(results(spark, [("c1", 1), ("c2", 2)]), results(spark, [("c3", 1), ("c1", 2)]), 10).orderBy("rank").collect()
    assert [r.chunk_id for r in fused] == ["c1", "c3", "c2"]
    assert np.allclose([r.score for r in fused], [1 / 61 + 1 / 62, 1 / 61, 1 / 62])
    tie = fusion.reciprocal_rank_fusion(results(spark, [("b", 1)]), results(spark, [("a", 1)]), 10).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["a", "b"] and tie[0].sparse_rank is None


def test_point_ids_are_uuid5(spark):
    import uuid

    df = spark.createDataFrame([("c1",), ("é",)], "c string")
    for r in df.select("c", vectors.point_id(F.col("c")).alias("u")).collect():
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, vectors.POINT_LABEL + r.c))


def test_index_problems_tokenise_each_chunk_once(spark):
    rows = [("a", "d", 0, "x y"), ("a", "d", 0, "x y"), ("b", "d", 1, "... of the"), ("b", "d", 1, "... of the"), ("c", "d", 2, "z"), (None, "d", 3, "of"), ("e", "d", 4, None)]
    found = lexical.index_problems(spark.createDataFrame(rows, "chunk_id string, document_id string, ordinal int, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    want = [("a", "duplicate_chunk_id", 2), ("b", "duplicate_chunk_id", 2), ("b", "empty_token_list", 1), ("b", "empty_token_list", 1), (None, "empty_token_list", 1)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_search_keeps_k_rows_a_query_in_each_task(spark, tmp_path):
    """The scan of the chunks gives what the join with the postings gives, and no row for every match leaves a task."""
    texts = [" ".join(f"w{(i * j) % 41}" for j in range(1, 9)) + f" own{i} rest{i % 5}" for i in range(120)]
    index = stored(spark, texts, tmp_path / "ix")
    q = spark.createDataFrame([(1, "w3 w5 w7"), (2, "own4 w1 w1"), (3, "rest2"), (4, "nothing"), (2, "w9")], "query_id long, query string")
    scan = lexical._scanned(index, q, 5, True)
    assert scan is not None and scan.count() <= 3 * 5 * scan.rdd.getNumPartitions()
    got = {(r.query_id, r["rank"]): (r.document_id, r.score) for r in lexical.bm25_top_k(index, q, 5).collect()}
    joined = lexical.LexicalIndex(index.postings, index.terms, index.chunks, index.meta, index.k1, index.b)
    want = {(r.query_id, r["rank"]): (r.document_id, r.score) for r in lexical.bm25_top_k(joined, q, 5).collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-8 for x in got)


@pytest.mark.parametrize("limit", [400_000, 10_000])
def test_search_of_many_queries_stays_in_the_task(spark, tmp_path, monkeypatch, limit):
    """300 queries with 600 words of their own: a dense matrix of these would be over its size, the scan is not; a
    query side beyond its size meets the chunks block by block. Both give what the join with the postings gives."""
    texts = [" ".join(f"w{(i * j) % 41}" for j in range(1, 9)) + f" own{i} rest{i % 5} a{i * 17} b{i * 17} b{i}" for i in range(120)]
    rows = [(i, f"w{i % 41} a{i} b{i} rest{i % 7}") for i in range(300)] + [(None, "w3 own5"), (5, "w9 w9")]
    extra = [(f"x{i}", f"{i:03x}more", 0, f"a{i} b{i}") for i in range(300)]
    both = chunks(spark, texts).unionByName(spark.createDataFrame(extra, "chunk_id string, document_id string, ordinal int, text string"))
    lexical.save_index(lexical.build_index(both), str(tmp_path / "both"))
    index = lexical.load_index(spark, str(tmp_path / "both"))
    q = spark.createDataFrame(rows, "query_id long, query string")
    monkeypatch.setattr(lexical, "MATRIX_BYTES", limit)
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 100)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 1 << 20)
    scan = lexical._scanned(index, q, 5, True)
    assert scan is not None and scan.count() <= 301 * 5 * max(5, scan.rdd.getNumPartitions())
    order = "query_id", "rank"
    got = lexical.bm25_top_k(index, q, 5).orderBy(*order).collect()
    joined = lexical.LexicalIndex(index.postings, index.terms, index.chunks, index.meta, index.k1, index.b)
    want = lexical.bm25_top_k(joined, q, 5).orderBy(*order).collect()
    key = lambda r: (r.query_id, r["rank"], r.chunk_id)
    assert len(got) == 301 * 5 and [key(r) for r in got] == [key(r) for r in want]
    assert all(abs(a.score - b.score) < 1e-8 for a, b in zip(got, want))


def test_store_counts_chunks_of_terms_once(spark, tmp_path):
    from citeloom.plans import corpus_store

    rows = [(i, "en", "s", f"file://{i}", str(i), "text", f"{i:03x}doc", t) for i, t in enumerate(["red green red", "green blue", "", "blue green kite"])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, source_uri string, title string, source_type string, document_id string, text string")
    corpus_store.build(docs, str(tmp_path / "store"), dim=8)
    # the weights and their floor read one stored table of counts
    counted = {r.term: r.nd for r in spark.read.parquet(str(tmp_path / "store" / "frequencies")).collect()}
    assert counted == {"red": 1, "green": 3, "blue": 2, "kite": 1}
    store = corpus_store.load(spark, str(tmp_path / "store"))
    plain = lexical.build_index(store.chunks)
    for name in ("terms", "meta"):
        columns = [F.round(c, 9) if kind == "double" else F.col(c) for c, kind in getattr(plain, name).dtypes]
        assert sorted(getattr(store.index, name).select(columns).collect()) == sorted(getattr(plain, name).select(columns).collect())


def test_terms_counted_quickly_are_those_of_the_pattern(spark):
    texts = ["", None, "The a.b. /p/q. /p/q.. /. --x-- == a==b é_É İx Σας ﬁne 10° “quoted” – …end. 漢字 한글 😀 a--b a-_b", "plain plain PLAIN. and", "\U0001e900x \u08c8y z", "ÀÖß x×y \u00ad w"]
    base = spark.createDataFrame([(str(i), "d", i, t) for i, t in enumerate([*texts, *(f"{c}a a{c} /{c}." for c in map(chr, range(1, 0x530)))])], "chunk_id string, document_id string, ordinal int, text string")
    want = lexical.with_term_counts(lexical.tokenised(base)).select("chunk_id", F.size("tokens").alias("dl"), "counts")
    rows = lambda df: sorted(map(tuple, df.select("chunk_id", "dl", "counts").collect()))
    assert rows(lexical.counted_chunks(base)) == rows(want)
    quick = base.select(tx.token_counts(F.col("text")).alias("q")).filter("q is null").count()
    assert 0 < quick < 0x530 // 4  # the others never meet the pattern


def test_blocks_of_vectors_meet_once_and_within_their_label(spark, monkeypatch):
    """A row travels once for every block of the other side, never to another label; ranks are those of a plain loop."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(60, 5)), 2, axis=0)
    x[::7] = x[3]  # copies tie by id
    x[11] = x[40] = 0.0
    rows = [(i, [float(a) for a in r], f"s{i % 4}" if i % 9 else None) for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, tag string")
    q = v.filter("tag is not null").select(F.col("chunk_id").alias("query_id"), "embedding", F.col("tag").alias("filter_value"))
    got = {}
    for r in vectors.cosine_top_k(q, v, 3, filter_column="tag", broadcast_bytes=0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    x = x.astype(np.float32).astype(float)
    unit = np.divide(x, (norm := np.linalg.norm(x, axis=1, keepdims=True)), out=np.zeros_like(x), where=norm > 0)
    for i, _, tag in rows:
        if tag:
            inside = [j for j, _, t in rows if t == tag]
            assert [c for _, c in sorted(got[i])] == sorted(inside, key=lambda j: (-round(float(unit[i] @ unit[j]), 9) + 0.0, j))[:3]
    left, right = q.select("query_id", F.col("filter_value").alias("tag")), v.select(F.col("chunk_id").alias("vector_id"), "tag")
    count = lambda a, b: a.group_by("tag").aggregate([("tag", "count")]).append_column("v", [[len(b)]]).rename_columns(["tag", "q", "v"])
    cells = vectors._cells(left, right, ["tag"], 20).applyInArrow(count, "tag string, q long, v long").collect()
    assert {r.tag for r in cells} == {"s0", "s1", "s2", "s3"} and len(cells) == 4 * 2 * 2
    assert sum(r.q for r in cells) == 2 * q.count() and sum(r.v for r in cells) == 2 * q.count()
    monkeypatch.undo()
    assert vectors._block_size(64) >= 16 * 4096 and 8 * vectors._block_size(4096) * 4096 <= vectors.BLOCK_BYTES


@pytest.mark.parametrize("held", [1 << 9, 1 << 20])
def test_best_scores_of_blocks_match_a_plain_loop(monkeypatch, held):
    """Ties, copies, zero vectors and filters, with scores held a few or all at a time and vectors in any batches."""
    import pyarrow as pa

    monkeypatch.setattr(vectors, "SCORE_BYTES", held)
    rng = np.random.default_rng(9)
    for whole in (True, False):
        v = rng.integers(-2, 3, (150, 4)).astype(float) if whole else rng.normal(size=(150, 4))
        v[::3], v[5::20] = v[1], 0.0
        q = np.concatenate([v[:30], rng.normal(size=(3, 4))])
        ids = [f"c{i // 2:03d}" for i in rng.permutation(150)]  # ids may repeat
        tags = [None if i % 11 == 0 else i % 3 for i in range(150)]
        want = [None if i % 4 == 0 else i % 5 for i in range(33)]
        lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
        asked = pa.table({"query_id": list(range(33)), "embedding": lists(q), "filter_0": want})
        given = pa.table({"vector_id": ids, "embedding": lists(v), "filter_0": pa.array(tags, pa.int64())})
        unit = vectors._normalised(v)
        for rows in (150, 13):
            got = list(vectors._scan_with(asked, 4, ["filter_0"])(iter(given.to_batches(max_chunksize=rows))))[0].to_pylist()
            got = sorted((r["query_id"], r["vector_id"], round(r["score"], 8)) for r in got)
            best = []
            for i, one in enumerate(vectors._normalised(q)):
                inside = sorted((-round(float(one @ unit[j]), 9) + 0.0, ids[j]) for j in range(150) if want[i] in (None, tags[j]))
                best += [(i, name, round(-s + 0.0, 8)) for s, name in inside[:4]]
            assert got == sorted(best)


def test_terms_travel_as_one_string_a_chunk(spark, tmp_path):
    """No list of structs is shuffled to meet the positions, and the index is that of the counts; what it holds is not kept twice."""
    from citeloom.plans import corpus_store

    texts = ["red green red", "", "of the", "a--b /p/q == x.y", "Ünï 漢字 😀_"]
    base = chunks(spark, [*texts, None]).withColumn("source", F.lit("s"))
    counted = lexical.counted_chunks(base, keep=("source",))
    forward = lexical.index_from_counts(counted).forward
    moved = forward._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(chunk_id", 1)[1].splitlines()[1]
    assert "array_join(counts" in moved and "AS counts" not in moved
    rows = lambda df: sorted(map(str, df.select("document_id", "source", "dl", "counts").collect()))
    assert rows(forward) == rows(counted) and forward.schema["counts"].dataType.simpleString() == "array<struct<term:string,tf:int>>"
    docs = [(i, "en", "s", f"file://{i}", str(i), "text", f"{i:03x}doc", t) for i, t in enumerate(texts)]
    corpus_store.build(spark.createDataFrame(docs, "doc_id long, lang string, source string, source_uri string, title string, source_type string, document_id string, text string"), str(tmp_path / "store"), dim=8)
    assert {p.name for p in (tmp_path / "store").iterdir() if p.is_dir()} == {"documents", "chunks", "frequencies", "lexical", "vectors"}
