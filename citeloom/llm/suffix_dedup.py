"""Removal of every byte that lies in a 200-byte string which starts anywhere else too.

Every text position with 200 bytes ahead is a suffix. Suffixes are dealt to buckets by an anchor: the least
hash among the runs of ``GRAM`` bytes inside their 200 bytes. Equal strings have equal anchors, and neighbours
mostly share one, so consecutive suffixes travel together as one segment of text. A bucket is a few MB of
segments, whatever the input; suffixes whose anchor occurs in one segment only equal no other, the rest is
sorted one block at a time with difference-cover ranks (``suffix_blocks``). Bytes are compared, never hashes.

Runs of bytes that many documents hold are kept out of anchors where anything else can be one: a bounded
sample of documents (``SAMPLE`` texts) names the frequent runs, which rank behind all others. Then the bytes of
segments are counted for each anchor over a share of all text (``EVERY``), in partial sums. Suffixes of an anchor
that would fill a bucket alone (as of a passage that few, or only long texts hold) travel one by one, dealt by all
of their 200 bytes. Both only steer how the work is dealt. Segments that are equal within a task are recognised
there: one travels, and all are marked. So what many suffixes of a bucket share is whole 200-byte strings only,
and of each of these one travels for every ``BLOCK_BYTES`` of text.

Texts are named by 96 bits of a digest; equal texts share a name and the result. The texts themselves are
shuffled once, to meet their spans.

Defined cases: a null text is empty; texts shorter than 200 bytes keep all; texts of any length are read in
pieces of ``PIECE_BYTES``; repeated rows are copies of each other, and so are removed where they have 200
bytes; a null id stays null; an empty table gives none; other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import BLOCK_BYTES, Prefix, blocks, cut_lineage, mix, pick, text_bytes
from citeloom.llm.suffix_blocks import DEPTH, Suffixes

GRAM = 40
SPAN = DEPTH - GRAM + 1  # runs of GRAM bytes in a window
#: Text bytes for each bucket, and the sample that names frequent runs.
BUCKET_BYTES = 4 << 20
SAMPLE, SAMPLE_BYTES, OFTEN = 2000, 16384, 0.01
#: Anchors are counted over one in so many texts (or slices of ``SAMPLE_BYTES`` of longer ones), or all of a small input.
EVERY, SMALL_BYTES = 16, 64 << 20
#: Bytes hashed in one step (its arrays fit a core's cache), and of a piece of a longer text.
STEP_BYTES, PIECE_BYTES = 256 << 10, 2 << 20
NAME = 12
PLACE_BITS = 25
FLAGS = 1 << 22


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values: minima up to and from the ends of fixed blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    cells = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def flag_index(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(42)).astype(np.int64)


def segments(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Prefix]:
    """(place, count, anchor) of the runs of suffixes with one anchor, for texts ``raw[start:stop]``."""
    prefix = Prefix(raw)
    if len(raw) < DEPTH:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), prefix
    grams = prefix.windows(GRAM)
    value = grams >> np.uint64(1)
    if frequent is not None:
        value |= frequent[flag_index(grams)].astype(np.uint64) << np.uint64(63)
    shift = np.uint64(PLACE_BITS)
    value = (value >> shift << shift) | np.arange(len(value), dtype=np.uint64)
    least = window_minimum(value, SPAN)
    long = stops - starts >= DEPTH
    starts, stops = starts[long], stops[long]
    valid = np.zeros(len(raw) + 1, np.int32)
    np.add.at(valid, starts, 1)
    np.add.at(valid, stops - DEPTH + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)[: len(least)]
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[starts] = True
    after = ~valid
    edges = np.nonzero((new & valid) | np.concatenate([[False], after[1:] & valid[:-1]]))[0]
    ends = np.append(edges[1:], len(least))
    keep = valid[edges]
    place, count = edges[keep], (ends - edges)[keep]
    return place, count, least[place] >> shift, prefix


def one_by_one(place: np.ndarray, count: np.ndarray, anchor: np.ndarray, heavy: np.ndarray, prefix: Prefix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments, where those of ``heavy`` (sorted) anchors are cut into single suffixes, with a hash of their bytes as anchor."""
    full = heavy[np.minimum(np.searchsorted(heavy, anchor), len(heavy) - 1)] == anchor
    if not full.any():
        return place, count, anchor
    times = np.where(full, count, 1)
    first = np.repeat(np.cumsum(times) - times, times)
    apart = np.repeat(full, times)
    place = np.repeat(place, times) + np.where(apart, np.arange(len(first)) - first, 0)
    count, anchor = np.where(apart, 1, np.repeat(count, times)), np.repeat(anchor, times)
    anchor[apart] = prefix.runs(place[apart], place[apart] + DEPTH) >> np.uint64(PLACE_BITS)
    return place, count, anchor


def local_repeats(data: bytes, name: np.ndarray, place: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, forwarded): segments with an equal one among these, and one of each kind.

    ``name`` is a hash of a segment's bytes; segments of one name are compared byte by byte.
    """
    stop = place + count + DEPTH - 1
    order = np.argsort(name, kind="stable")
    repeated, forward = np.zeros(len(place), bool), np.ones(len(place), bool)
    head = -1
    for i in np.nonzero(name[order[:-1]] == name[order[1:]])[0].tolist():
        x, y = order[i], order[i + 1]
        if head < 0 or name[head] != name[y]:
            head = x
        if data[place[head] : stop[head]] == data[place[y] : stop[y]]:
            repeated[head] = repeated[y] = True
            forward[y] = False
    return repeated, forward


def joined_spans(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of one owner as one (sorted by owner and start)."""
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    if not len(owner):
        return owner, start, stop
    # A running maximum per owner: owners are lifted above all stops of earlier ones.
    _, dense = np.unique(owner, return_inverse=True)
    lift = dense.astype(np.int64) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift)
    new = np.ones(len(owner), bool)
    new[1:] = start[1:] + lift[1:] > reach[:-1]
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], start[first], reach[last] - lift[first]


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(bytes, starts, stops, base, names) of a batch; a longer text comes in pieces that share 199 bytes."""
    raw, offsets = text_bytes(batch, "text")
    data = raw.tobytes()
    names = [hashlib.md5(data[a:b]).digest()[:NAME] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    if len(raw) <= limit or len(names) > 1:
        yield raw, offsets[:-1], offsets[1:], np.zeros(len(names), np.int64), names
        return
    for at in range(0, len(raw) - DEPTH + 1, limit):
        part = raw[at : at + limit + DEPTH - 1]
        yield part, np.array([0]), np.array([len(part)]), np.array([at]), names


class Dealer:
    """Segments of many small steps, packed together for each bucket."""

    def __init__(self, buckets: int, frequent: np.ndarray | None, heavy: np.ndarray | None = None):
        self.buckets, self.frequent, self.packer = buckets, frequent, zstandard.ZstdCompressor(level=3)
        self.heavy = heavy if heavy is not None and len(heavy) else None
        self.clear()

    def clear(self) -> None:
        self.size, self.data, self.names, self.parts = 0, [], [], []

    def add(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: np.ndarray, names: list[bytes]) -> None:
        place, count, anchor, prefix = segments(raw, starts, stops, self.frequent)
        if self.heavy is not None and len(place):
            place, count, anchor = one_by_one(place, count, anchor, self.heavy, prefix)
        if len(place):
            full = np.nonzero(stops > starts)[0]  # empty texts start where others do
            owner = full[np.searchsorted(starts[full], place, side="right") - 1]
            name = prefix.runs(place, place + count + DEPTH - 1)
            self.parts.append((place + self.size, count, anchor, name, owner + len(self.names), place - starts[owner] + base[owner]))
            self.data.append(raw.tobytes())
            self.names += names
            self.size += len(raw)

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, bytes) of the segments that would travel, which are then forgotten."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        place, count, anchor, name = (np.concatenate(x) for x in list(zip(*self.parts, strict=True))[:4])
        _, forward = local_repeats(b"".join(self.data), name, place, count)
        self.clear()
        anchors, at = np.unique(anchor[forward], return_inverse=True)
        return anchors, np.bincount(at, count[forward] + DEPTH - 1, len(anchors)).astype(np.int64)

    def rows(self) -> list[tuple[int, int, bytes]]:
        """(bucket, kind, payload) of all that was added, which is then forgotten."""
        if not self.parts:
            return []
        data, names = b"".join(self.data), self.names
        place, count, anchor, name, owner, begin = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.clear()
        repeated, forward = local_repeats(data, name, place, count)
        out = []
        o, a, b = joined_spans(owner[repeated], begin[repeated], begin[repeated] + count[repeated] + DEPTH - 1)
        if len(o):
            body = b"".join(names[x] for x in o) + a.astype("<i8").tobytes() + b.astype("<i8").tobytes()
            out.append((int.from_bytes(names[o[0]][:4], "little") % self.buckets, 1, self.packer.compress(body)))
        chosen = np.nonzero(forward)[0]
        bucket = (mix(anchor[chosen].copy()) >> np.uint64(20)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        chosen, bucket = chosen[order], bucket[order]
        cuts = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, [len(bucket)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = chosen[lo:hi]
            p, c = place[own], count[own]
            head = [len(own).to_bytes(8, "little"), *[names[x] for x in owner[own]], begin[own].astype("<i8").tobytes(),
                    c.astype("<u2").tobytes(), (anchor[own] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()]
            body = b"".join(head + [data[x:y] for x, y in zip(p.tolist(), (p + c + DEPTH - 1).tolist(), strict=True)])
            out.append((int(bucket[lo]), 0, self.packer.compress(body)))
        return out


def flags_of(frequent: bytes | None) -> np.ndarray | None:
    if not frequent:
        return None
    flags = np.zeros(FLAGS, bool)
    flags[flag_index(np.frombuffer(frequent, np.uint64))] = True
    return flags


def deal(docs: DataFrame, buckets: int, frequent: bytes | None, heavy: bytes = b"") -> DataFrame:
    """(bucket, kind, payload): packed segments (kind 0) and spans found within a task (kind 1)."""
    held = docs.sparkSession.sparkContext.broadcast((frequent, heavy))

    def packed(dealer: Dealer) -> pa.RecordBatch:
        rows = dealer.rows()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
            ["bucket", "kind", "payload"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets, flags_of(held.value[0]), np.frombuffer(held.value[1], np.uint64))
        for batch in blocks(batches, "text", STEP_BYTES):
            for piece in pieces(batch):
                dealer.add(*piece)
                if dealer.size >= BLOCK_BYTES:
                    yield packed(dealer)
        yield packed(dealer)

    return docs.mapInArrow(work, "bucket int, kind int, payload binary")


def chosen_pieces(batch: pa.RecordBatch, every: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """As ``pieces``, but one in ``every`` texts, or slices of a text that is a batch alone."""
    for raw, starts, stops, base, names in pieces(batch, SAMPLE_BYTES):
        take = [zlib.crc32(n + b.tobytes()) % every == 0 for n, b in zip(names, base, strict=True)]
        if any(take):
            texts = [raw[a:b] for a, b, t in zip(starts.tolist(), stops.tolist(), take, strict=True) if t]
            ends = np.cumsum([len(t) for t in texts])
            yield np.concatenate(texts), ends - [len(t) for t in texts], ends, base[take], [n for n, t in zip(names, take, strict=True) if t]


def heavy_anchors(docs: DataFrame, frequent: bytes | None, bound: int, every: int) -> bytes:
    """Anchors whose segments have more than about ``bound`` bytes, sorted: as many as the text has times the bound, at most."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, read = Dealer(1, flags_of(held.value)), 0
        sums = lambda: pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64), pa.int64()) for x in counter.sizes()], ["anchor", "bytes"])
        for batch in blocks(batches, "text", STEP_BYTES):
            for piece in chosen_pieces(batch, every):
                counter.add(*piece)
            read += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if read >= BLOCK_BYTES:
                read = 0
                yield sums()
        yield sums()

    counted = docs.mapInArrow(work, "anchor long, bytes long").groupBy("anchor").agg(F.sum("bytes").alias("bytes"))
    found = counted.filter(F.col("bytes") * every > bound).select("anchor").toArrow().column("anchor").to_numpy()
    return np.sort(found.astype(np.uint64)).tobytes()


def unpack(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """(names, begin, count, anchor, text) of packed segments put one after the other."""
    parts = []
    for body in payloads:
        n, at = int.from_bytes(body[:8], "little"), 8
        out = []
        for kind, width in ((f"V{NAME}", NAME), ("<i8", 8), ("<u2", 2), ("<u4", 4)):
            out.append(np.frombuffer(body, kind, n, at))
            at += width * n
        parts.append((*out, np.frombuffer(body, np.uint8, -1, at)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def bucket_spans(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, start, stop) of the repeated strings among the segments of a bucket."""
    names, begin, count, anchor, text = unpack(payloads)
    count = count.astype(np.int64)
    sizes = count + DEPTH - 1
    at = np.cumsum(sizes) - sizes
    # Only anchors of several segments can hold equal suffixes.
    _, group, times = np.unique(anchor, return_inverse=True, return_counts=True)
    own = np.nonzero(times[group] > 1)[0]
    if not len(own):
        return names[:0], begin[:0], begin[:0]
    moved = np.concatenate([text[a : a + s] for a, s in zip(at[own].tolist(), sizes[own].tolist(), strict=True)])
    names, begin, count, group, sizes = names[own], begin[own], count[own], group[own], sizes[own]
    at = np.cumsum(sizes) - sizes
    segment = np.repeat(np.arange(len(own)), count)
    inner = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    places = at[segment] + inner
    suffixes = Suffixes(moved)
    bucket = mix(suffixes.word(places, 0) ^ (group[segment].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    found = np.nonzero(suffixes.repeated(places, bucket))[0]
    start = begin[segment[found]] + inner[found]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (segment[found][1:] != segment[found][:-1]) | (start[1:] != start[:-1] + 1)
    first = np.nonzero(fresh)[0]
    last = np.append(first[1:], len(found)) - 1 if len(found) else first
    return names[segment[found[first]]], start[first], start[last] + DEPTH


def frequent_runs(texts: list[bytes]) -> np.ndarray:
    """Hashes of the runs of GRAM bytes that a share of ``OFTEN`` of the texts hold."""
    grams = [np.unique(Prefix(np.frombuffer(t, np.uint8)).windows(GRAM)) for t in texts if len(t) >= GRAM]
    if not grams:
        return np.zeros(0, np.uint64)
    value, times = np.unique(np.concatenate(grams), return_counts=True)
    return value[times >= max(20, OFTEN * len(texts))]


def sampled_runs(docs: DataFrame, rows: int) -> bytes | None:
    """Frequent runs of about ``SAMPLE`` texts, found in one task: some MB at most."""
    every, half = max(1, rows // SAMPLE), SAMPLE_BYTES // 2
    ends = F.concat(F.left("text", F.lit(half)), F.right("text", F.lit(half)))  # of longer texts
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).limit(2 * SAMPLE)
    some = some.select(F.when(F.octet_length("text") <= SAMPLE_BYTES, F.col("text")).otherwise(ends).alias("text"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"runs": [frequent_runs([t.encode("utf-8", "surrogatepass") for t in group["text"]]).tobytes()]})

    found = some.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(work, "runs binary").first()
    return bytes(found.runs) if found and found.runs else None


def spans(docs: DataFrame, *, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(name, start, stop) of repeated strings in the texts of ``docs`` (doc_id, text), by byte offsets."""
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-size.bytes // bucket_bytes))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        opener, out = zstandard.ZstdDecompressor(), []
        packed = [opener.decompress(p) for p in group.loc[group["kind"] == 0, "payload"]]
        if packed:
            out.append(bucket_spans(packed))
        for body in map(opener.decompress, group.loc[group["kind"] == 1, "payload"]):
            n = len(body) // (NAME + 16)
            out.append((np.frombuffer(body, f"V{NAME}", n), np.frombuffer(body, "<i8", n, NAME * n), np.frombuffer(body, "<i8", n, (NAME + 8) * n)))
        names, start, stop = (np.concatenate(x) for x in zip(*out, strict=True))
        distinct = sorted(set(held := [x.tobytes() for x in names]))
        number = {x: i for i, x in enumerate(distinct)}
        owner, start, stop = joined_spans(np.array([number[x] for x in held], np.int64), start, stop)
        return pd.DataFrame({"name": [distinct[w] for w in owner.tolist()], "start": start, "stop": stop})

    frequent = sampled_runs(docs, size.rows)
    dealt = deal(docs, buckets, frequent, heavy_anchors(docs, frequent, bucket_bytes, 1 if size.bytes <= SMALL_BYTES else EVERY))
    return dealt.groupBy("bucket").applyInPandas(solve, "name binary, start long, stop long").distinct()


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the remaining bytes of every row."""
    source = pick(docs, doc_id=F.col(doc_id).cast("long"), text=F.coalesce(F.col(text).cast("string"), F.lit("")))
    found = spans(source, bucket_bytes=bucket_bytes)
    listed = cut_lineage(found.groupBy("name").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    name = F.substring(F.unhex(F.md5(F.col("text").cast("binary"))), 1, NAME)
    both = source.withColumn("name", name).join(listed, "name", "left").select("doc_id", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 8 << 20):
            raw, offsets = text_bytes(batch, "text")
            data, rows = raw.tobytes(), []
            for a, b, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
                at, kept, runs = a, [], 0
                for s, e in sorted((x["start"], x["stop"]) for x in own or ()):
                    if a + s > at or (a + s == at and not runs):
                        kept.append(data[at : a + s])
                        runs += 1
                    at = max(at, a + e)
                kept.append(data[at:b])
                whole = b"".join(kept)
                rows.append((b - a, b - a - len(whole), runs, whole))
            n, removed, runs, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
