"""Helpers the operators of this folder share: Arrow text blocks, rolling hashes and written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from citeloom.session import checkpoint_root, cut_lineage, forget

__all__ = ["checkpoint_root", "cut_lineage", "forget", "read", "pick", "blocks", "text_bytes", "columns_of", "mix", "Prefix", "with_field"]

#: Bytes of text that one step of a task holds in memory at once (a single longer text is a step of its own).
BLOCK_BYTES = 16 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under the operator's own names, so other columns never clash."""
    return df.select(*(((df[c] if isinstance(c, str) else c).alias(name)) for name, c in columns.items()))


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array, and where each starts (null is empty)."""
    column = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def columns_of(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (overwrites ``h``)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Prefix:
    """Polynomial hashes of any run of a byte array: one pass, then two lookups per run."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers(self.BASE, n), out=self.sums[1:])
        self.back = self.powers(self.INVERSE, n + 1)

    _cache: dict[int, np.ndarray] = {}

    @classmethod
    def powers(cls, base: int, n: int) -> np.ndarray:
        held = cls._cache.get(base)
        if held is None or len(held) < n:
            held = np.full(max(n, 1 << 20), np.uint64(base), np.uint64)
            held[0] = 1
            held = np.multiply.accumulate(held)
            if n <= 1 << 22:  # those of a very long text are not kept
                cls._cache[base] = held
        return held[:n]

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start])

    def windows(self, k: int) -> np.ndarray:
        """Hash of every run of ``k`` bytes."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k])


def with_field(schema: T.StructType, name: str, kind: str) -> T.StructType:
    return T.StructType(list(schema.fields)).add(name, kind)
