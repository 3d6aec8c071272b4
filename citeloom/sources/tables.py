"""Tables written by runs: documents, chunks, manifests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.checks import violations
from citeloom.operators.ingest import dispositions, document_rules


class ConflictError(ValueError):
    """A stored document differs from the incoming one and may not be overwritten."""


def holds_files(spark: SparkSession, path: str) -> bool:
    """Whether anything has been written under ``path``, on any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and len(files.listStatus(place)) > 0


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder, on any file system that Spark reads; patterns are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if holds_files(spark, path) else None


def payload_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("payload_hash", F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256))


def write_documents(documents: DataFrame, path: str, *, batch: str, overwrite: bool = False) -> DataFrame:
    """Append new or changed documents as one batch and return ``document_id, disposition``.

    Earlier batches are never rewritten: a reader takes the newest row per document
    (:func:`read_documents`), so a failed run leaves the table as it was.
    """
    spark = documents.sparkSession
    incoming = payload_hash(documents)
    stored = _existing(spark, path)
    if stored is None:
        judged = incoming.withColumn("disposition", F.lit("created"))
    else:
        judged = dispositions(incoming, newest(stored).select("document_id", "payload_hash"), overwrite=F.lit(overwrite))
    if judged.filter("disposition = 'conflict'").limit(1).count():
        raise ConflictError("a processed document already exists with other content")
    fresh = judged.filter("disposition <> 'unchanged'").withColumn("batch", F.lit(batch))
    fresh.write.mode("append").partitionBy("batch").parquet(path)
    return spark.read.parquet(path).filter(F.col("batch").cast("string") == batch).select("document_id", "disposition")


def newest(stored: DataFrame) -> DataFrame:
    """The latest row of every document; the winner is chosen by batch before any text is moved."""
    last = stored.groupBy("document_id").agg(F.max(F.col("batch").cast("string")).alias("b"))
    return stored.join(last, (stored["document_id"] == last["document_id"]) & (stored["batch"].cast("string") == last["b"])).select(stored["*"])


def read_documents(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    rows = newest(spark.read.parquet(path))
    return rows if ids is None else rows.join(ids.select("document_id").distinct(), "document_id", "left_semi")


#: A stored document as one JSON line.
ARTIFACT_SCHEMA = "document_id string, source_uri string, title string, source_type string, content_sha256 string, text string, byte_size long"


def write_artifacts(documents: DataFrame, path: str) -> None:
    """Documents as JSON lines, one file set a call; an existing path is an error."""
    names = [c.split()[0] for c in ARTIFACT_SCHEMA.split(", ")]
    documents.select(*names).write.mode("errorifexists").json(path)


def read_artifacts(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(documents, issues)`` of stored JSON documents; ``wanted(document_id)`` narrows what is asked for.

    A line that is no document of the declared form, or that breaks a rule of the record contract, is an
    issue (``document_id`` where it can be read, ``code``, ``detail``) and holds nothing else up; a wanted
    document without a usable line is ``artifact_not_found``.
    """
    # Lines are parsed whole: the JSON source parses only the columns a query asks for, and would miss faults in others.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    read = lines.select(F.from_json("value", ARTIFACT_SCHEMA + ", broken string", options).alias("p")).select("p.*")
    named = F.regexp_extract("broken", r'"document_id"\s*:\s*"([^"]*)"', 1)
    rows = read.withColumn("document_id", F.when(F.col("broken").isNotNull(), F.nullif(named, F.lit(""))).otherwise(F.col("document_id")))
    if wanted is not None:
        rows = rows.join(wanted.select("document_id").distinct(), "document_id", "left_semi")
    whole = rows.filter("broken is null").drop("broken")
    torn = rows.filter("broken is not null").select("document_id", F.lit("artifact_invalid").alias("code"), F.lit("malformed").alias("detail"))
    rules = violations(whole, F.col("document_id"), document_rules())
    bad = rules.select(F.col("entity_id").alias("document_id"), F.lit("artifact_invalid").alias("code"), F.col("rule").alias("detail"))
    good = whole.join(rules.select(F.col("entity_id").alias("document_id")).distinct(), "document_id", "left_anti")
    issues = torn.unionByName(bad)
    if wanted is not None:
        seen = good.select("document_id").unionByName(issues.select("document_id"))
        gone = wanted.select("document_id").distinct().join(seen, "document_id", "left_anti")
        issues = issues.unionByName(gone.select("document_id", F.lit("artifact_not_found").alias("code"), F.lit("").alias("detail")))
    return good, issues


def append_run(run: DataFrame, path: str) -> None:
    """Add a run manifest; a run id that is already there is refused."""
    stored = _existing(run.sparkSession, path)
    if stored is not None and run.join(stored.select("run_id"), "run_id", "left_semi").limit(1).count():
        raise ConflictError("run id already recorded")
    run.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Write a report once; an existing path is an error."""
    df.write.mode("errorifexists").parquet(path)
