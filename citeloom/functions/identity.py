"""Content-derived identifiers and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# RFC 4122 URL name space.
_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by ``:``."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def uuid5(name: Column, label: str = "citeloom:chunk:") -> Column:
    """Name-based UUID (version 5, URL name space) of ``label + name``."""
    raw = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.concat(F.lit(label), name).cast("binary")))
    # Version nibble becomes 5; the variant nibble keeps its two low bits and sets the top bit.
    variant = F.element_at(
        F.array(*[F.lit(c) for c in "89ab89ab89ab89ab"]),
        (F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") + 1),
    )
    return F.concat_ws(
        "-",
        F.substring(raw, 1, 8),
        F.substring(raw, 9, 4),
        F.concat(F.lit("5"), F.substring(raw, 14, 3)),
        F.concat(variant, F.substring(raw, 18, 3)),
        F.substring(raw, 21, 12),
    )


def row_digest(*cols: Column) -> Column:
    """Digest of one row; NULL and the empty string stay different."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


#: Row digests that one leaf may hold on average, and leading hex digits by which a level of the tree splits.
LEAF_ROWS, DIGITS = 1024, 3


def fingerprint_depth(rows: int) -> int:
    """Leading hex digits that name a leaf: three, and three more for each time leaves would be too full."""
    depth = DIGITS
    while rows > LEAF_ROWS * 16**depth:
        depth += DIGITS
    return depth


def table_fingerprint(df: DataFrame, digest: Column, name: str = "fingerprint", *, rows: int | None = None) -> DataFrame:
    """Order-independent SHA-256 of a whole table as one row: the root of a tree over its row digests.

    A leaf holds the digests with the same leading hex digits, in order; equal digests are counted rather
    than repeated. Each level above joins at most 4096 children, so no string is longer than a few hundred
    thousand characters, whatever the table holds. The number of levels follows from the number of
    ``rows`` (counted, if it is not given), so equal tables have equal trees; one level stands for up to
    4 million rows.
    """
    depth = fingerprint_depth(df.count() if rows is None else rows)
    every = df.select(digest.alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    joined = lambda sep, *parts: F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(sep, *parts)))), 256)
    nodes = every.groupBy(F.substring("d", 1, depth).alias("b")).agg(joined("*", "d", F.col("n").cast("string")).alias("h"))
    for level in range(depth - DIGITS, 0, -DIGITS):
        nodes = nodes.groupBy(F.substring("b", 1, level).alias("p")).agg(joined(":", "b", "h").alias("h")).withColumnRenamed("p", "b")
    return nodes.agg(joined(":", "b", "h").alias(name))
