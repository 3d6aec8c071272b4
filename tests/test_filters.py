"""Filters on both search legs, against plain loops over the unfiltered scores."""

import itertools

import pytest
from pyspark.sql import functions as F

from citeloom.operators import lexical, vectors
from citeloom.plans import corpus_store, filtered_search

TEXTS = ["red apple pie", "green apple", "red brick wall", "blue sky", "apple apple tree", "wall clock", "sky light red", "plain words only"]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(i, f"d{i % 4}-{i // 4}", "T", f"u{i}", "en", f"src{i % 2}", "text", t + f" extra{i}") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, document_id string, title string, source_uri string, lang string, source string, source_type string, text string")
    root = str(tmp_path_factory.mktemp("store") / "s")
    corpus_store.build(docs, root, dim=16)
    return corpus_store.load(spark, root)


def asked(spark):
    sources, documents = [None, "src0", "src1", "none"], [None, "d0-0", "d2-1", "gone"]
    rows = [(n, "red apple sky", s, d) for n, (s, d) in enumerate(itertools.product(sources, documents))]
    return spark.createDataFrame(rows, "query_id long, query string, source string, document_id string")


def embedded(q):
    return vectors.hashed_embedding(lexical.query_terms(q).withColumnRenamed("qtf", "tf"), "query_id", dim=16)


def test_both_legs_match_plain_loops(spark, store):
    q, k = asked(spark), 3
    legs = filtered_search.filtered_legs(store, q, embedded(q), k_leg=k)
    chunks = {r.chunk_id: r for r in store.chunks.collect()}
    places = {r.chunk_id: r.position for r in store.index.chunks.collect()}
    scores = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25_top_k(store.index, q.select("query_id", "query"), 100).collect()}
    near = {(r.query_id, r.chunk_id): r.score for r in vectors.cosine_top_k(embedded(q), store.vectors, 100).collect()}
    for name, table, order in (("sparse", scores, lambda q, c: (-scores[q, c], places[c])), ("dense", near, lambda q, c: (-near[q, c], c))):
        got = {}
        for r in sorted(legs[name].collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append(r.chunk_id)
        for r in q.collect():
            inside = [c for c, x in chunks.items() if r.source in (None, x.source) and r.document_id in (None, x.document_id)]
            assert got.get(r.query_id, []) == sorted(inside, key=lambda c: order(r.query_id, c))[:k], (name, r)


def test_dense_leg_alone(spark, store):
    q = asked(spark)
    legs = filtered_search.filtered_legs(store, q, embedded(q), filter_legs="dense")
    assert filtered_search.outside_filters(legs["dense"], store, q).count() == 0
    assert filtered_search.outside_filters(legs["sparse"], store, q).count() > 0
    both = filtered_search.filtered_hybrid(store, q, embedded(q))
    assert filtered_search.outside_filters(both, store, q).count() == 0


def test_a_filter_of_every_query_prunes_partitions(spark, store, monkeypatch):
    q = spark.createDataFrame([(1, "red", "src1")], "query_id long, query string, source string")
    dense = filtered_search.filtered_legs(store, q, embedded(q))["dense"]
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "src1" in plan.split("PartitionFilters", 1)[1].split("]")[0] and dense.count() == 4
    monkeypatch.setattr(vectors, "PRUNED_VALUES", 0)
    assert filtered_search.filtered_legs(store, q, embedded(q))["dense"].collect() == dense.collect()


def test_other_fields_are_refused(spark, store):
    q = spark.createDataFrame([(1, "red", "x")], "query_id long, query string, title string")
    with pytest.raises(ValueError):
        filtered_search.filtered_legs(store, q, embedded(q.select("query_id", "query")))
    with pytest.raises(ValueError):
        filtered_search.filtered_legs(store, asked(spark), embedded(asked(spark)), filter_legs="sparse")


def test_filtered_search_keeps_k_rows_a_query_in_each_task(spark, store, monkeypatch):
    """Filters are met in the scan of the chunks: no row for every match, and the same rows as the join with the postings."""
    q = asked(spark)
    again = spark.createDataFrame([(3, "apple", None, "d0-0"), (20, "wall red", "src1", None), (20, "wall", "src1", None), (None, "red", "src0", None)], q.schema)
    q, k, fields = q.unionByName(again), 2, ("source", "document_id")
    attributes = store.chunks.select("chunk_id", "source")
    found = lambda index: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in lexical.bm25_top_k(index, q, k, attributes=attributes, fields=fields).collect())
    x = store.index
    want = found(lexical.LexicalIndex(x.postings, x.terms, x.chunks, x.meta, x.k1, x.b))
    bare = lexical.LexicalIndex(x.postings, x.terms, x.chunks, x.meta, x.k1, x.b, x.forward.select("position", "dl", "counts"))
    with monkeypatch.context() as m:
        m.setattr(lexical, "bm25_scores", None)
        assert found(x) == want and found(bare) == want
        m.setattr(lexical, "MATRIX_BYTES", 1000)  # queries and chunks meet in blocks
        m.setattr(lexical, "BLOCK_CHUNKS", 3)
        assert found(x) == want
    scan = lexical._scanned(x, q, k, True, lexical.filter_places(x, attributes, fields), fields)
    assert 0 < scan.count() <= 17 * k * scan.rdd.getNumPartitions()
