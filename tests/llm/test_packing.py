import zlib

import numpy as np
import pytest

from citeloom.llm import packing

TEXTS = [
    (1, "Plain words, and more words."), (2, ""), (3, None), (None, "no id"), (5, "two  spaces   three \n tabs\t\t end "),
    (5, "two  spaces   three \n tabs\t\t end "), (6, "a<|endoftext|> b  c   d\n \n\n e's don't\n "), (7, "é ñ 漢字 🙂 \x1c x \x85 y"),
    (8, "word " * 3000), (9, " lead"), (10, "x" * 5000), (11, "tail "),
]


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_rebuild_every_document(make):
    df = make(TEXTS, "doc_id long, text string").selectExpr("*", "1 as length", "'a' as ids")
    rows = packing.pack(df).collect()
    want = sorted((r[0] if r[0] is not None else -1, tuple(reference_ids(r[1]))) for r in TEXTS)
    docs, current = [], {}
    for r in sorted(rows, key=lambda r: (r.doc_id if r.doc_id is not None else -1, r.sequence_id)):
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length == 2**r.bucket <= packing.LONGEST and r.offset == 0
        if r.start == 0:
            current = {"key": r.doc_id if r.doc_id is not None else -1, "ids": []}
            docs.append(current)
        assert r.start == len(current["ids"])
        current["ids"] += ids.tolist()
        current["n"] = r.doc_tokens
    assert sorted((d["key"], tuple(d["ids"])) for d in docs) == want
    assert all(d["n"] == len(d["ids"]) for d in docs)
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_decomposition():
    for n in (1, 2, 3, 1023, 1024, 1025, 4099):
        pieces = packing.decompose(n)
        assert sum(k for _, k in pieces) == n and all(k & (k - 1) == 0 for _, k in pieces)
        assert [s for s, _ in pieces] == [sum(k for _, k in pieces[:i]) for i in range(len(pieces))]
    with pytest.raises(ValueError):
        packing.pack(None, longest=1000)


def test_buckets_and_empty_table(make, tmp_path):
    assert packing.pack(make([], "doc_id long, text string")).count() == 0
    packing.write_buckets(packing.pack(make(TEXTS, "doc_id long, text string")), str(tmp_path / "b"))
    assert {p.name for p in (tmp_path / "b").glob("bucket=*")} >= {"bucket=0", "bucket=10"}


def test_query(spark):
    from citeloom.llm.queries import QUERIES

    rows = QUERIES["op1_power_of_two_packing"](spark, "/root/testdata/sf0.001").collect()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id = 7").first().text
    ids = np.array(reference_ids(text), "<u4")
    for r in rows:
        if r.doc_id == 7:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
