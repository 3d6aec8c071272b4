"""Near-duplicate groups by b-bit MinHash.

A document's set holds its distinct shingles of five lower-cased words (64-bit hashes; a shorter text is
one shingle). 128 minima form 42 bands of three; documents that share a band are candidates. Two low bits of
every minimum are kept as one signature of 256 bits; equal pairs are counted with ``bit_count``, chance
agreement (a quarter) is subtracted, and candidates estimated below ``CUT`` are left out, which lies six
standard deviations under the threshold. What passes is confirmed on the full sets. A pair at the threshold
shares no band with a probability of 1e-10.

Groups may be huge, so their pairs are never listed. Documents of equal sets are one node. In each band
bucket a node is paired with the bucket's least node; its best such pair is confirmed first, and gives first
components (a node goes with its head). Pairs estimated near enough join nodes to clusters; nodes of different clusters that share a
bucket are compared by their signatures, and what is near joins the clusters too. All candidate pairs then
lie inside clusters. In each, the nodes outside its largest component are met with those of all others, in
cells of at most ``CELL`` nodes a side, where full sets are compared and only links that join components are
returned; links inside a component change nothing.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; repeated rows are
linked by their equal sets; a null id takes part, but names no component (rows linked only with such rows
have a null component, and are kept if their id is null too); an empty table gives none; other columns
never take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import Prefix, blocks, cut_lineage, mix, pick, text_bytes
from citeloom.llm.graph import components

WORDS, PERCENT = 5, 75
MINIMA, ROWS, BANDS = 128, 3, 42
CUT = 0.48
#: Bytes of text hashed in one step; its arrays stay small.
STEP_BYTES = 1 << 20
#: Nodes and shingles of a side of a cell, and shingles compared at once.
CELL, CELL_SHINGLES, COLUMNS = 128, 1 << 18, 4096
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEEDS = np.random.default_rng(20)
FACTORS = _SEEDS.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
SHIFTS = _SEEDS.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
STEP = np.uint64(0xA0761D6478BD642F)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingle hashes of each text, one after the other."""
    texts = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    raw = LOWER[raw]
    inside = ~SPACES[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    word = Prefix(raw).runs(start, stop)
    bounds = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(texts), np.diff(bounds))
    run = np.zeros(len(word), np.uint64)
    for j in range(words):  # past the end of a text nothing is added
        ahead = np.zeros(len(word), np.uint64)
        ahead[: len(word) - j] = word[j:]
        if j:
            over = np.arange(len(word)) + j >= bounds[text + 1]
            ahead[over] = 0
        run = run * STEP + ahead
    counts = np.diff(bounds)
    keep = np.arange(len(word)) - bounds[text] <= np.maximum(counts - words, 0)[text]
    run, text = mix(run[keep]), text[keep]
    order = np.lexsort((run, text))
    run, text = run[order], text[order]
    fresh = np.ones(len(run), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    run, text = run[fresh], text[fresh]
    return run, np.searchsorted(text, np.arange(texts + 1))


def set_names(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set."""
    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)

    return sums(hashes), sums(mix(hashes ^ np.uint64(0x5DEECE66D1CE4E5B)))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, packed): band keys, and the two low bits of all minima in four words, of non-empty sets."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((len(bounds) - 1, MINIMA), np.uint32)
    lo = 0
    while lo < len(bounds) - 1:  # pieces that stay in cache
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 65536, side="right")) - 1)
        part, at = short[bounds[lo] : bounds[hi]], bounds[lo:hi] - bounds[lo]
        for j in range(MINIMA):
            minima[lo:hi, j] = np.minimum.reduceat(part * FACTORS[j] + SHIFTS[j], at)
        lo = hi
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.ones((len(minima), 1), np.uint64)
    for r in range(ROWS):
        key = key * STEP + minima[:, r : ROWS * BANDS : ROWS].astype(np.uint64) + np.uint64(1)
    low = mix(minima.astype(np.uint64)) & np.uint64(3)
    shift = (2 * np.arange(32, dtype=np.uint64))[None, None, :]
    packed = np.bitwise_or.reduce(low.reshape(-1, 4, 32) << shift, axis=2)
    return mix(key).view(np.int64), packed.view(np.int64)


FEATURES = "doc_id long, n long, x long, y long, bands array<long>, sig array<long>"


def features(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): size and name of its set, band keys, packed signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", STEP_BYTES):
            raw, offsets = text_bytes(batch, "text")
            hashes, bounds = shingle_sets(raw, offsets)
            n = np.diff(bounds)
            x, y = set_names(hashes, bounds)
            some = n > 0
            bands = np.zeros((len(n), BANDS), np.int64)
            packed = np.zeros((len(n), 4), np.int64)
            if some.any():
                bands[some], packed[some] = signatures(hashes, np.append(bounds[:-1][some], bounds[-1]))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.int64())) for a in (bands, packed)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(x), pa.array(y), *lists], ["doc_id", "n", "x", "y", "bands", "sig"])

    return docs.mapInArrow(work, FEATURES)


def full_sets(docs: DataFrame) -> DataFrame:
    """(n, x, y, shingles) of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", STEP_BYTES):
            raw, offsets = text_bytes(batch, "text")
            hashes, bounds = shingle_sets(raw, offsets)
            x, y = set_names(hashes, bounds)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(bounds)), pa.array(x), pa.array(y), lists], ["n", "x", "y", "shingles"])

    return docs.mapInArrow(work, "n long, x long, y long, shingles array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from the share of equal two-bit lanes, less what chance gives."""
    unequal = sum(
        (F.bit_count((d := F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))).bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
         for i in range(4)), F.lit(0))
    match = 1 - unequal / MINIMA
    return (match - 0.25) / 0.75


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("other"), F.col("n").alias("m")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), "shingles", "n"), "a")
    common = F.size(F.array_intersect("shingles", "other"))
    return both.filter(100 * common >= percent * (F.col("n") + F.col("m") - common)).select("a", "b")


def _across(placed: DataFrame, marks: DataFrame) -> DataFrame:
    """Near pairs (a, b) that share a bucket but no cluster, for ``placed``: (key, node, c)."""
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("key", "main")
    placed = cut_lineage(placed.join(mixed, "key").join(marks, "node"))
    outside = placed.filter("c <> main").select("key", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("sig").alias("sa"))
    every = placed.select("key", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("sig").alias("sb"), (F.col("c") == F.col("main")).alias("inside"))
    # A pair of two outside nodes is met from its larger one only.
    return outside.join(every, "key").filter((F.col("ca") != F.col("cb")) & (F.col("inside") | (F.col("b") < F.col("a"))) & (estimate("sa", "sb") >= CUT)).select("a", "b").distinct()


def cell_links(rows: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """Links of one cell that join components: its left nodes against its right ones, by full sets."""
    left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []})
    sizes = [np.array([len(x) for x in side["shingles"]]) for side in (left, right)]
    own = [np.concatenate(side["shingles"].to_numpy()) for side in (left, right)]
    shared = np.intersect1d(own[0], own[1])
    if not len(shared):
        return pd.DataFrame({"a": [], "b": []})
    places = [np.minimum(np.searchsorted(shared, x), len(shared) - 1) for x in own]
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), COLUMNS):
        width, parts = min(COLUMNS, len(shared) - start), []
        for x, at, n in zip(own, places, sizes, strict=True):
            part = np.zeros((len(n), width), np.float32)
            ok = (shared[at] == x) & (at >= start) & (at < start + width)
            part[np.repeat(np.arange(len(n)), n)[ok], at[ok] - start] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    c = [side["c"].to_numpy() for side in (left, right)]
    linked &= c[0][:, None] != c[1][None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out, nodes = [], [side["node"].to_numpy() for side in (left, right)]
    for i, j in np.argwhere(linked).tolist():
        x, y = root(int(c[0][i])), root(int(c[1][j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(nodes[0][i]), int(nodes[1][j])))
    return pd.DataFrame(out, columns=["a", "b"])


def inner_links(clusters: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of one cluster, for all pairs that ``found`` leaves apart."""
    placed = clusters.withColumnRenamed("component", "cluster").join(found, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("c"))
    placed = cut_lineage(placed.join(sets.select("node", "n"), "node"))
    each = placed.groupBy("cluster", "c").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    totals = each.groupBy("cluster").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.max("k").alias("km"), F.max_by("n", F.struct("k", "c")).alias("nm"), F.count("*").alias("parts"))

    def count(nodes: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(nodes / CELL), F.ceil(shingles / CELL_SHINGLES), F.lit(1)).cast("int")

    totals = cut_lineage(totals.filter("parts > 1").select(
        "cluster", "main", count(F.col("k") - F.col("km"), F.col("n") - F.col("nm")).alias("rows"), count(F.col("k"), F.col("n")).alias("columns")))
    each = placed.select("node", "cluster", "c").join(totals, "cluster").join(sets, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["cluster", "node", "c", "shingles"]
    left = each.filter("c <> main").select(*keep, F.lit(0).alias("side"), own("rows").alias("i"), other("columns").alias("j"))
    right = each.select(*keep, F.lit(1).alias("side"), own("columns").alias("j"), other("rows").alias("i"))
    return left.unionByName(right).groupBy("cluster", "i", "j").applyInPandas(lambda rows: cell_links(rows), "a long, b long")


def groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    source = pick(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    rows = cut_lineage(features(source))
    reps = rows.filter("n > 0").groupBy("n", "x", "y").agg(F.min("doc_id").alias("low"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    reps = cut_lineage(reps.withColumn("node", F.monotonically_increasing_id()))
    marks = reps.select("node", "sig")

    # Band buckets of more than one node.
    banded = reps.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).filter("head < tail").select("key", "head")
    members = cut_lineage(banded.join(shared, "key"))

    # Pairs of nodes with the heads of their buckets, and the best of each node.
    heads = members.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    rated = heads.join(marks.withColumnsRenamed({"node": "a", "sig": "sa"}), "a").join(marks.withColumnsRenamed({"node": "b", "sig": "sb"}), "b")
    near = cut_lineage(rated.select("a", "b", estimate("sa", "sb").alias("e")).filter(F.col("e") >= CUT))
    best = near.groupBy("a").agg(F.max_by("b", F.struct("e", -F.col("b"))).alias("b"))

    # Full sets of the nodes of shared buckets only.
    wanted = members.select("node").distinct().join(reps.select("node", "n", "x", "y", "low"), "node")
    candidates = source.join(wanted.select(F.col("low").alias("doc_id")).distinct(), "doc_id", "left_semi")
    unnamed = wanted.filter("low IS NULL").limit(1).count() > 0
    if unnamed:
        candidates = candidates.unionByName(source.filter("doc_id IS NULL"))
    sets = full_sets(candidates).join(wanted, ["n", "x", "y"]).dropDuplicates(["node"]).select("node", "n", "shingles")
    sets = cut_lineage(sets)
    links = cut_lineage(confirm(best, sets))
    # First components: a node goes with the head of its link, and once more with that head's.
    heads = links.select(F.col("a").alias("b"), F.col("b").alias("above"))
    found = cut_lineage(links.join(heads, "b", "left").select(F.col("a").alias("node"), F.coalesce("above", "b").alias("component")))

    # Clusters of near nodes, then pairs that share a bucket across clusters.
    clusters = cut_lineage(components(near))
    placed = members.join(clusters, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    bridges = cut_lineage(_across(placed, marks))
    if bridges.limit(1).count():
        clusters = components(near.select("a", "b").unionByName(bridges))

    further = inner_links(clusters, found, sets)
    final = cut_lineage(components(links.unionByName(further)))

    named = reps.join(final, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = named.groupBy("c").agg(F.min("low").alias("component_id"))
    named = cut_lineage(named.join(least, "c").select("n", "x", "y", "component_id"))
    keyed = named.withColumnsRenamed({"n": "kn", "x": "kx", "y": "ky"})
    out = rows.select("doc_id", "n", "x", "y").join(keyed, F.expr("n = kn AND x = kx AND y = ky"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: that of the least id. Rows without an id stay."""
    gone = groups(docs).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
