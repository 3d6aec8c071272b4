"""Streams give the batch answer, in one micro-batch or in several."""

import pytest
from pyspark.sql import functions as F

from citeloom.streaming import jobs


@pytest.mark.parametrize("files", [1, 3])
def test_last_handles(spark, tmp_path, files):
    rows = [(i % 4, f"2024-01-01 00:{i % 60:02d}:00", i) for i in range(57)]
    df = spark.createDataFrame(rows, "user_id long, t string, run_id long").select("user_id", F.to_timestamp("t").alias("ts"), "run_id")
    for k in range(files):
        df.filter(F.floor(F.col("run_id") * files / 57) == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}.parquet"))
    stream = jobs.table_stream(spark, str(tmp_path / "in" / "*"), "*.parquet", df.schema, files_per_batch=1)
    got = jobs.run_to_latest(jobs.last_handles(stream), "user_id", str(tmp_path / "out"), str(tmp_path / "ck"))
    want = {(u, p + 1, r) for u in range(4) for p, r in enumerate(sorted((i for i in range(57) if i % 4 == u), reverse=True)[:3])}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 12


def test_documents_sent_twice_are_stored_once(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(700))
    df = spark.createDataFrame([(f"d{i}", "T", "u", text) for i in range(4)], "document_id string, title string, source_uri string, text string")
    for k, ids in enumerate((["d0", "d1"], ["d1", "d2"], ["d3", "d0"])):
        df.filter(F.col("document_id").isin(ids)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}.parquet"))
    stream = jobs.table_stream(spark, str(tmp_path / "in" / "*"), "*.parquet", df.schema, files_per_batch=1)
    got = jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted((r.document_id, r.ordinal) for r in got.collect()) == [(f"d{i}", k) for i in range(4) for k in range(2)]


@pytest.mark.parametrize("files", [1, 3])
def test_repeats_are_served_by_what_went_through(spark, tmp_path, files):
    import random

    rng = random.Random(5)
    rows = sorted((rng.randrange(0, 7200), i % 5, i) for i in range(300))
    df = spark.createDataFrame([(k, s, i) for s, k, i in rows], "k long, s long, run_id long").select(
        F.concat(F.lit("k"), "k").alias("cache_key"), (F.to_timestamp(F.lit("2024-01-01 00:00:00")).cast("long") + F.col("s")).cast("timestamp").alias("ts"), "run_id", "s")
    for n in range(files):
        df.filter(F.floor(F.col("s") * files / 7200) == n).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}.parquet"))
    stream = jobs.table_stream(spark, str(tmp_path / "in" / "*"), "*.parquet", df.schema, files_per_batch=1)
    got = jobs.run_to_table(jobs.suppress_repeats(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    last, want = {}, set()
    for s, k, i in rows:
        if k not in last or s >= last[k] + 300:
            last[k] = s
            want.add((f"k{k}", i))
    assert {(r.cache_key, r.run_id) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("parts", [1, 3])
def test_a_stream_reads_a_table_that_is_a_folder_of_parts(spark, tmp_path, parts):
    df = spark.range(30).repartition(parts)
    df.write.parquet(str(tmp_path / "t.parquet"))
    stream = jobs.table_stream(spark, str(tmp_path), "t.parquet", df.schema, files_per_batch=1)
    got = jobs.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.id for r in got.collect()) == list(range(30))
