"""Ingest runs: classification, dispositions, manifests and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.functions.checks import duplicates, violations
from citeloom.functions.identity import content_hash, joined_hash
from citeloom.operators import chunking, markup

# File types by extension, size limit, title pattern and id patterns.
SOURCE_TYPES = {".md": "markdown", ".markdown": "markdown", ".txt": "text", ".html": "html", ".htm": "html"}
MAX_BYTES = 10_000_000
HEADING = r"(?m)^[ \t]{0,3}#{1,6}[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*$"
DOCUMENT_ID = r"^[a-zA-Z0-9_.:-]+$"
RUN_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"
HEX64 = r"^[0-9a-f]{64}$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def source_type(path: Column) -> Column:
    ext = extension(path)
    return F.coalesce(*[F.when(ext == e, F.lit(t)) for e, t in SOURCE_TYPES.items()])


def title_of(text: Column, stem: Column) -> Column:
    """First heading of the text, else the file stem."""
    return F.coalesce(F.nullif(tx.strip(F.regexp_extract(text, HEADING, 1)), F.lit("")), stem)


def prepare(sources: DataFrame, *, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(documents, failures)`` of ``source_uri, byte_size, content`` (text, NULL when not UTF-8).

    A source that fails is one row of the failures; the others are not held up by it.
    """
    kind = source_type(F.col("source_uri"))
    base = sources.withColumn("source_type", kind)
    lines = markup.unix_lines(F.regexp_replace("content", "^﻿", ""))
    base = base.withColumn("lines", lines)
    base = markup.with_visible_text(base, F.when(F.col("source_type") == "html", F.col("lines")), "raw")
    base = base.withColumn("raw", F.when(F.col("source_type") == "html", F.col("raw")).otherwise(F.col("lines")))
    problem = (
        F.when(F.col("source_type").isNull(), "unsupported_source")
        .when(F.col("byte_size") > max_bytes, "source_too_large")
        .when(F.col("content").isNull(), "invalid_encoding")
        .when(tx.is_blank(F.col("raw")), "empty_source")
    )
    judged = base.withColumn("problem", problem)
    failures = judged.filter("problem is not null").select("source_uri", F.col("problem").alias("code"))
    stem = F.regexp_extract("source_uri", r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    good = judged.filter("problem is null").withColumn("content_sha256", content_hash(F.col("raw")))
    documents = good.select(
        joined_hash(F.col("source_uri"), F.col("content_sha256")).alias("document_id"), "source_uri",
        title_of(F.col("raw"), stem).alias("title"), "source_type", "content_sha256", tx.strip(F.col("raw")).alias("text"), "byte_size",
    )
    return documents, failures


def chunk_documents(documents: DataFrame, sizes: chunking.ChunkSizes = chunking.ChunkSizes(), *, compat: bool = False) -> DataFrame:
    """Chunks by source type: Markdown and HTML by structure, plain text by words (or paragraphs)."""
    cols = ["chunk_id", "document_id", "ordinal", "text", "start_char", "end_char", "token_estimate"]
    plain = documents.filter("source_type = 'text'")
    plain_chunks = chunking.paragraph_chunks(plain, sizes) if compat else chunking.word_windows(plain, sizes)
    marked = chunking.markdown_chunks(documents.filter("source_type <> 'text'"), sizes)
    return plain_chunks.select(*cols, F.lit("").alias("heading_path")).unionByName(marked.select(*cols, "heading_path"))


def dispositions(incoming: DataFrame, existing: DataFrame, *, overwrite: Column | None = None) -> DataFrame:
    """What a write would do to each document: created, unchanged, overwritten or conflict.

    Only ids and payload hashes travel; the texts stay where they are.
    """
    may = F.lit(False) if overwrite is None else overwrite
    old = existing.select("document_id", F.col("payload_hash").alias("old_hash"))
    joined = incoming.join(old, "document_id", "left")
    kind = (
        F.when(F.col("old_hash").isNull(), "created")
        .when(F.col("old_hash") == F.col("payload_hash"), "unchanged")
        .when(may, "overwritten")
        .otherwise("conflict")
    )
    return joined.withColumn("disposition", kind).drop("old_hash")


def manifest(run_id: str, documents: DataFrame, chunks: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The run row and its source rows."""
    per = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    sources = documents.select("source_uri", "document_id", "source_type", "content_sha256", "byte_size").join(per, "document_id", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0))
    )
    failed = failures.agg(F.count("*").alias("n")).scalar()
    run = sources.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_count")).select(
        F.lit(run_id).alias("run_id"), "document_count", "chunk_count", failed.alias("failed_count"),
    )
    return run.withColumn("status", F.when(F.col("failed_count") > 0, "failed").otherwise("completed")), sources


def identity_problems(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources, documents and chunks that occur twice in one run."""
    return (
        duplicates(documents, ["source_uri"], "duplicate_source")
        .unionByName(duplicates(documents, ["document_id"], "duplicate_document"))
        .unionByName(duplicates(chunks, ["chunk_id"], "duplicate_chunk"))
    )


def manifest_problems(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """``runs``: ``run_id, status, started_at, completed_at, document_count, chunk_count, failures, warnings``."""
    real = sources.groupBy("run_id").agg(F.count("*").alias("docs"), F.sum("chunk_count").alias("chunks"))
    df = runs.join(real, "run_id", "left")
    done = F.col("status").isin("completed", "completed_with_warnings")
    rules = {
        "bad_run_id": ~F.col("run_id").rlike(RUN_ID),
        "completed_before_start": F.col("completed_at") < F.col("started_at"),
        "completed_without_time": done & F.col("completed_at").isNull(),
        "failed_without_failure": (F.col("status") == "failed") & (F.col("failures") == 0),
        "completed_with_failure": done & (F.col("failures") > 0),
        "warnings_missing": (F.col("status") == "completed_with_warnings") & (F.col("warnings") == 0),
        "document_count": F.col("document_count") != F.coalesce("docs", F.lit(0)),
        "chunk_count": F.col("chunk_count") != F.coalesce("chunks", F.lit(0)),
    }
    return violations(df, F.col("run_id"), rules)


def artifact_problems(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks without document, repeated or unordered positions, offsets outside the text.

    Positions are compared by their count and extremes per document, without sorting any document.
    """
    sizes = documents.select("document_id", F.length("text").alias("size"))
    joined = chunks.select("chunk_id", "document_id", "ordinal", "start_char", "end_char").join(sizes, "document_id", "left")
    rules = {
        "orphan_chunk": F.col("size").isNull(),
        "end_before_start": F.col("end_char") < F.col("start_char"),
        "outside_text": F.col("end_char") > F.col("size"),
        "negative_position": (F.col("ordinal") < 0) | (F.col("start_char") < 0),
    }
    per_row = violations(joined, F.col("chunk_id"), rules)
    twice = chunks.groupBy("document_id", "ordinal").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.concat_ws(":", "document_id", "ordinal").alias("entity_id"), F.lit("repeated_position").alias("rule")
    )
    return per_row.unionByName(twice)


def unordered_offsets(chunks: DataFrame) -> DataFrame:
    """Chunks that start before the chunk in front of them."""
    order = Window.partitionBy("document_id").orderBy("ordinal")
    before = F.lag("start_char").over(order)
    return chunks.withColumn("before", before).filter("start_char < before").select(F.col("chunk_id").alias("entity_id"), F.lit("unordered_offsets").alias("rule"))


def document_rules() -> dict[str, Column]:
    blank = {f"blank_{c}": tx.is_blank(F.col(c)) for c in ("document_id", "source_uri", "title", "source_type", "content_sha256", "text")}
    return {
        **blank,
        "bad_document_id": ~F.col("document_id").rlike(DOCUMENT_ID),
        "bad_hash": ~F.lower(tx.strip(F.col("content_sha256"))).rlike(HEX64),
        "negative_size": F.col("byte_size") < 0,
    }


def chunk_rules() -> dict[str, Column]:
    blank = {f"blank_{c}": tx.is_blank(F.col(c)) for c in ("chunk_id", "document_id", "text", "title")}
    return {
        **blank,
        "negative_ordinal": F.col("ordinal") < 0,
        "negative_offset": (F.col("start_char") < 0) | (F.col("end_char") < 0),
        "end_before_start": F.col("end_char") < F.col("start_char"),
        "no_tokens": F.col("token_estimate") < 1,
    }


def chunk_summary(chunks: DataFrame, *, width: int = 300, salt: int = 64) -> DataFrame:
    """Per document: number of chunks and the ordered list of ``(ordinal, chunk_id, snippet)``.

    The list is the report itself; it is first gathered per slice of ordinals, so that no task sorts
    more than its slice before the slices of one document are concatenated in order.
    """
    item = F.struct("ordinal", "chunk_id", F.substring("text", 1, width).alias("snippet"))
    slices = chunks.groupBy("document_id", F.floor(F.col("ordinal") / salt).alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return slices.groupBy("document_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "items"))), lambda s: s["items"])).alias("chunks")
    ).withColumn("chunk_count", F.size("chunks"))
