"""Structured Streaming jobs: incremental ingest, windowed telemetry, request suppression, sessions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from citeloom.operators.chunking import ChunkSizes, word_windows
from citeloom.sources.tables import holds_files, is_folder


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType, *, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files named ``name`` under ``folder``, or those in it if the name is a folder; the rate is bounded per batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, f"{folder}/{name}"):
        return stream.parquet(f"{folder}/{name}")
    return stream.option("pathGlobFilter", name).parquet(folder)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> DataFrame:
    """Process what is there and stop; the file sink commits each batch exactly once."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_latest(stream: DataFrame, key: str, path: str, checkpoint: str) -> DataFrame:
    """Process what is there and return, for every ``key``, the rows of the last batch that named it.

    Each batch replaces its own partition, so a replayed batch is stored once.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch_id", "long")).parquet(path)
    last = rows.groupBy(F.col(key).alias("k")).agg(F.max("batch_id").alias("last"))
    return rows.join(last, (F.col(key) == F.col("k")) & (F.col("batch_id") == F.col("last"))).drop("k", "last", "batch_id")


def ingest_stream(documents: DataFrame, path: str, checkpoint: str, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """Chunk arriving documents into the chunk table.

    Each batch writes its own partition ``batch_id`` and replaces it when the batch is replayed, and
    documents that an earlier batch has written are left out, so one sent twice is stored once.
    """
    spark = documents.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(["document_id"])
        if holds_files(batch.sparkSession, path):  # known documents are left out before any text is cut
            done = batch.sparkSession.read.parquet(path).filter(F.col("batch_id") != batch_id).select("document_id").distinct()
            fresh = fresh.join(done, "document_id", "left_anti")
        word_windows(fresh, sizes).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def windowed_metrics(events: DataFrame, *, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and latency per event-time window; rows later than the watermark are dropped.

    Also valid on a static table, where the watermark has no effect and every window is complete.
    """
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withWatermark("ts", late).groupBy(span.alias("w"), "status")
    out = grouped.agg(
        F.count("*").alias("n"), F.avg("latency_ms").alias("average_latency_ms"), F.max("latency_ms").alias("max_latency_ms"),
        F.percentile_approx("latency_ms", F.lit(0.95), F.lit(10_000)).alias("p95_approx"),
    )
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "n", "average_latency_ms", "max_latency_ms", "p95_approx")


def cache_key(df: DataFrame, *parts: str) -> DataFrame:
    """Key of a repeated request: source, query and policy."""
    return df.withColumn("cache_key", F.sha2(F.concat_ws(":", *[F.col(p).cast("string") for p in parts]), 256))


def suppress_repeats(requests: DataFrame, *, ttl_seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """``cache_key, run_id, ts`` of the requests that no remembered answer serves.

    A request that goes through is remembered for ``ttl_seconds`` of event time; the key's requests until then
    are repeats, and the next one after goes through and is remembered anew. Requests of a batch are taken in
    the order of time, then id; one that is older than the remembered request is served by it. A key's state
    is one time, and is dropped once the watermark has passed it.
    """
    ttl = ttl_seconds * 1_000_000

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        passed = []
        # The answer depends on the order of a key's requests in a batch, so its times and ids are put in order.
        rows = sorted((int(t), int(r)) for f in frames for t, r in zip(f["ts"].astype("datetime64[us]").astype("int64"), f["run_id"]))
        for t, run in rows:
            if last is None or t >= last + ttl:
                last = t
                passed.append((t, run))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"cache_key": [key[0]] * len(passed), "run_id": [r for _, r in passed], "ts": pd.to_datetime([t for t, _ in passed], unit="us")})

    return (
        requests.select("cache_key", "run_id", "ts").withWatermark("ts", late).groupBy("cache_key")
        .applyInPandasWithState(update, "cache_key string, run_id long, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def user_sessions(events: DataFrame, *, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def last_handles(events: DataFrame, *, keep: int = 3, ttl_ms: int | None = None, late: str = "10 minutes") -> DataFrame:
    """The latest ``keep`` handles per user, given anew by every batch that brings one of the user's events.

    The state of a user is at most ``keep`` rows, and a batch is folded into it frame by frame. With
    ``ttl_ms`` a user's state expires so long after the last event; without, no handle is forgotten.
    """

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        for frame in frames:
            held += list(zip(frame["ts"].astype("int64") // 1000, frame["run_id"]))
            held = sorted(held, reverse=True)[:keep]
        times, ids = [int(t) for t, _ in held], [int(i) for _, i in held]
        state.update((times, ids))
        if ttl_ms is not None:
            state.setTimeoutTimestamp(max(times[0] // 1000 + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(ids), "place": range(1, len(ids) + 1), "run_id": ids})

    return (
        events.withWatermark("ts", late).groupBy("user_id")
        .applyInPandasWithState(
            update, "user_id long, place int, run_id long", "times array<long>, ids array<long>", "update",
            GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.EventTimeTimeout,
        )
    )
