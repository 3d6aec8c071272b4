"""Build the retrieval tables of a corpus once, then search them many times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from citeloom.operators import chunking, lexical, vectors
from citeloom.session import forget


@dataclass(frozen=True)
class CorpusStore:
    documents: DataFrame
    chunks: DataFrame
    index: lexical.LexicalIndex
    vectors: DataFrame


def build(docs: DataFrame, root: str, *, dim: int = 64, sizes: chunking.ChunkSizes = chunking.ChunkSizes()) -> None:
    """Write ``documents``, ``chunks``, the lexical index and ``vectors`` under ``root``.

    Each stage reads what the stage before has written, so nothing is computed twice and a lost
    executor repeats only its own tasks. Vectors are partitioned by ``source``, the attribute a
    search may filter on.
    """
    spark = docs.sparkSession
    put = lambda df, name: df.write.option("compression", "zstd").parquet(f"{root}/{name}")
    put(docs, "documents")
    stored = spark.read.parquet(f"{root}/documents")
    windows = chunking.word_windows(stored, sizes, keep=("doc_id", "source", "lang", "source_type"))
    put(windows, "chunks")
    chunks = spark.read.parquet(f"{root}/chunks")
    put(lexical.counted_chunks(chunks, keep=("source", "source_type")), "counts")
    counts = spark.read.parquet(f"{root}/counts")
    put(lexical.corpus_positions(counts).select("chunk_id", "position"), "positions")
    places = spark.read.parquet(f"{root}/positions")
    put(lexical.document_frequencies(counts), "frequencies")
    frequencies = spark.read.parquet(f"{root}/frequencies")
    lexical.save_index(lexical.index_from_counts(counts, places=places, frequencies=frequencies), f"{root}/lexical")
    embedded = vectors.counted_embedding(counts.filter("chunk_id is not null"), "chunk_id", "document_id", "source", dim=dim)
    embedded.write.partitionBy("source").option("compression", "zstd").parquet(f"{root}/vectors")
    for name in ("counts", "positions"):  # the index holds both
        forget(spark, f"{root}/{name}")


def load(spark: SparkSession, root: str) -> CorpusStore:
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    return CorpusStore(read("documents"), read("chunks"), lexical.load_index(spark, f"{root}/lexical"), read("vectors"))
