"""Reading source files, fixtures and datasets, and checking them against declared hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeloom.functions.identity import content_hash
from citeloom.operators.ingest import SOURCE_TYPES, prepare, source_type


def discover(spark: SparkSession, root: str, *, recursive: bool = False) -> DataFrame:
    """``path, length, modificationTime`` of supported files under ``root``; contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return listing.select("path", "length", "modificationTime").filter(source_type(F.col("path")).isNotNull())


def resolved(path: Column, root: Column) -> Column:
    """An absolute path without scheme, empty, ``.`` and ``..`` parts; a relative path starts at ``root``.

    A path that climbs above the file system's own root is NULL.
    """
    bare = F.regexp_replace(path, "^file:/*", "/")
    whole = F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(F.regexp_replace(root, "^file:/*", "/"), F.lit("/"), bare))
    none = F.array().cast("array<string>")

    def step(held: Column, part: Column) -> Column:
        up = F.when(F.size(held) > 0, F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))))
        return F.when(part.isin("", "."), held).when(part == "..", up).otherwise(F.concat(held, F.array(part)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), none, step), "/"))


def inside_root(path: Column, root: Column) -> Column:
    base = resolved(root, F.lit("/"))
    return F.coalesce(F.startswith(path, F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"))), F.lit(False))


def guarded_paths(requests: DataFrame, listing: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)`` of requested ``path`` values, against the files listed below an allowed root.

    Accepted rows keep their columns with the ``resolved`` path; refused ones are ``path, code``:
    ``outside_root``, ``missing`` or ``unsupported_source``. Nothing is opened.
    """
    at = requests.withColumn("resolved", resolved(F.col("path"), F.lit(root)))
    held = listing.select(resolved(F.col("path"), F.lit(root)).alias("resolved"), F.lit(True).alias("listed")).distinct()
    code = (
        F.when(~inside_root(F.col("resolved"), F.lit(root)), "outside_root")
        .when(F.col("listed").isNull(), "missing")
        .when(source_type(F.col("resolved")).isNull(), "unsupported_source")
    )
    judged = at.join(held, "resolved", "left").withColumn("code", code)
    return judged.filter("code is null").drop("code", "listed"), judged.filter("code is not null").select("path", "code")


def require_inside(root: str, allowed_root: str) -> None:
    """Refuse to read a folder that is not the allowed root or below it."""
    import posixpath

    plain = lambda p: posixpath.normpath("/" + p.removeprefix("file:").lstrip("/"))
    if "://" in root.removeprefix("file:") or "://" in allowed_root.removeprefix("file:"):
        plain = lambda p: posixpath.normpath(p)
    if plain(root) != plain(allowed_root) and not plain(root).startswith(plain(allowed_root).rstrip("/") + "/"):
        raise ValueError("source path is outside the allowed root")


def load_sources(
    spark: SparkSession, root: str, *, recursive: bool = False, max_bytes: int = 10_000_000, uri_prefix: str = "file://data/raw/", allowed_root: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(documents, failures)`` of every supported file under ``root`` (which must lie in ``allowed_root``).

    The size limit is a filter on ``length`` that the source applies before a file is opened; files
    beyond it come back as failures from the listing alone.
    """
    if allowed_root is not None:
        require_inside(root, allowed_root)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = F.regexp_replace(F.lit(root), "/+$", "")
    inside = F.regexp_replace("path", "^file:/*", "/")
    relative = F.substring(inside, F.length(base) + 2, F.length(inside))
    named = read.select(F.concat(F.lit(uri_prefix), relative).alias("source_uri"), F.col("length").alias("byte_size"), "content", "path").filter(
        source_type(F.col("path")).isNotNull()
    )
    raw = F.col("content").cast("string")
    small = named.filter(F.col("byte_size") <= max_bytes).withColumn("content", F.when(F.is_valid_utf8(raw), raw)).drop("path")
    documents, failures = prepare(small, max_bytes=max_bytes)
    large = named.filter(F.col("byte_size") > max_bytes).select("source_uri", F.lit("source_too_large").alias("code"))
    return documents, failures.unionByName(large)


def supported_extensions() -> tuple[str, ...]:
    return tuple(SOURCE_TYPES)


def read_json_rows(spark: SparkSession, path: str, schema: StructType | str, *, lines: bool) -> DataFrame:
    """JSON lines, or one JSON array per file; a malformed row fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(not lines).lower()).json(path)


# Declared schemas of the evaluation inputs.
SAMPLE_SCHEMA = (
    "id string, question string, type string, split string, gold_chunk_ids array<string>, "
    "gold_citations array<struct<doc_id:string,chunk_id:string>>, "
    "atomic_facts array<struct<id:string,statement:string,required_for_answer:boolean>>, gold_answer string, "
    "requires_abstention boolean, target_doc_ids array<string>, provenance_notes string, fact_family_id string"
)
CASE_SCHEMA = (
    "case_id string, split string, query string, expected_route string, expected_source_id string, expected_evidence_ids array<string>, "
    "expected_answerable boolean, expected_stop_reason string, expected_external_use boolean, allow_external_query boolean, "
    "max_retrieval_calls int, max_web_calls int, max_estimated_external_cost_microusd int, source_id string, notes string"
)
EVIDENCE_SCHEMA = (
    "evidence_id string, text string, source_id string, source_type string, source_uri string, score double, "
    "metadata struct<title:string,section:string,published_date:string>"
)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return read_json_rows(spark, path, SAMPLE_SCHEMA, lines=False)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_json_rows(spark, path, CASE_SCHEMA, lines=True)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    return read_json_rows(spark, path, EVIDENCE_SCHEMA, lines=True)


def hash_problems(files: DataFrame, declared: DataFrame, *, normalise_lines: bool = False) -> DataFrame:
    """Compare ``name, content`` with ``name, sha256``: missing, undeclared or different files."""
    body = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n") if normalise_lines else F.col("content")
    found = files.select("name", content_hash(body).alias("actual"))
    both = found.join(declared.select("name", F.lower("sha256").alias("expected")), "name", "full")
    rule = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "undeclared").when(F.col("actual") != F.col("expected"), "hash_mismatch")
    return both.select(F.col("name").alias("entity_id"), rule.alias("rule")).filter("rule is not null")


def read_named_files(spark: SparkSession, root: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(name.alias("name"), "content", "length")


def source_manifest(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Verified corpus sources with their size; unverified files are left to :func:`hash_problems`."""
    body = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    found = files.select("name", content_hash(body).alias("sha256"), F.octet_length(body).alias("byte_size"))
    return found.join(declared, ["name", "sha256"]).select("name", "sha256", "byte_size")
