"""Vector tables: embedding, validation, point ids and exact or bucketed cosine top-k."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.identity import uuid5
from citeloom.functions.ranking import within
from citeloom.session import cut_lineage

# A query side up to this many bytes of doubles travels to every task; beyond it blocks are shuffled.
BROADCAST_BYTES = 64 << 20
# Rows of a block at most, and bytes of its vectors as doubles.
BLOCK_ROWS, BLOCK_BYTES = 65_536, 32 << 20
# Scores that a task holds at a time, and the vectors they belong to at most.
SCORE_BYTES, SCORE_ROWS = 16 << 20, 4096
# Filter values that are written into the scan of the vectors.
PRUNED_VALUES = 256
POINT_LABEL = "citeloom:chunk:"

EmbedFunction = Callable[[list[str]], np.ndarray]


# ---------------------------------------------------------------- embedding


def embed_rows(df: DataFrame, text: str, embed: Callable[[], EmbedFunction], *, batch: int = 8) -> DataFrame:
    """Add ``embedding array<float>`` with a user model.

    ``embed`` is a factory called once per Python worker, so a model is loaded once, and it is fed
    ``batch`` texts at a time.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embed()
        for frame in frames:
            texts = frame[text].tolist()
            parts = [model(texts[at : at + batch]) for at in range(0, len(texts), batch)]
            rows = [np.asarray(v, dtype=np.float32) for part in parts for v in part]
            yield frame.assign(embedding=rows)

    return df.mapInPandas(run, schema)


def hashed_embedding(term_counts: DataFrame, key: str, *, dim: int = 64) -> DataFrame:
    """Offline default model: L2-normalised bag of token hashes, from ``(key, term, tf)`` rows.

    Each vector is assembled from at most ``dim`` partial sums.
    """
    slot = (F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")
    summed = term_counts.groupBy(key, slot.alias("slot")).agg(F.sum("tf").cast("double").alias("w"))
    packed = summed.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
    )
    vector = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm"),
    )
    return packed.select(key, vector.alias("embedding"))


def counted_embedding(counted: DataFrame, *keys: str, dim: int = 64) -> DataFrame:
    """The vectors of :func:`hashed_embedding` from rows that hold all ``counts`` of their key, without a shuffle."""
    schema = T.StructType([*counted.select(*keys).schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def slots(terms: pa.Array) -> np.ndarray:
        return np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in terms.to_pylist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tf = batch.column("term"), batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            flat = terms.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(batch)), terms.value_lengths().to_numpy())
            slot = slots(flat.dictionary)[flat.indices.to_numpy()]
            sums = np.bincount(row * dim + slot, tf, len(batch) * dim).reshape(-1, dim)  # whole numbers, exact
            unit = sums / np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, dim), pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], lists], names=[*keys, "embedding"])

    rows = counted.filter(F.size("counts") > 0).select(*keys, F.col("counts.term").alias("term"), F.col("counts.tf").alias("tf"))
    return rows.mapInArrow(run, schema)


# ---------------------------------------------------------------- checks and identifiers


def vector_problems(vectors: DataFrame, key: str, *, dim: int | None = None) -> DataFrame:
    """Empty, wrong-length and non-finite vectors. Without ``dim`` the most common length is expected."""
    size = F.size("embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    if dim is None:
        lengths = vectors.groupBy(size.alias("s")).agg(F.count("*").alias("c"))
        expected = lengths.orderBy(F.desc("c"), "s").limit(1).select("s").scalar()
    else:
        expected = F.lit(dim)
    rule = (
        F.when(F.col("embedding").isNull() | (size == 0), "empty_vector")
        .when(size != expected, "dimension_mismatch")
        .when(bad, "non_finite_value")
    )
    return vectors.select(F.col(key).cast("string").alias("entity_id"), rule.alias("rule")).filter("rule is not null")


def check_index_config(meta: DataFrame, *, dim: int, metric: str = "cosine") -> None:
    """Refuse to write into an index with another dimension or metric."""
    row = meta.select("dim", "metric").head()
    if row is not None and (row.dim != dim or row.metric != metric):
        raise ValueError(f"index holds {row.dim}-d {row.metric} vectors, not {dim}-d {metric}")


def point_id(chunk_id: Column) -> Column:
    return uuid5(chunk_id, POINT_LABEL)


def payload(chunks: DataFrame) -> DataFrame:
    """The fields stored beside a vector; an empty heading path is absent."""
    return chunks.select(
        point_id(F.col("chunk_id")).alias("point_id"),
        "chunk_id", "document_id", "title", "source_uri", "source_type", "text", "ordinal",
        F.when(F.col("heading_path") != "", F.col("heading_path")).alias("heading_path"),
    )


def latest_points(old: DataFrame, new: DataFrame, key: str = "point_id", version: str = "batch") -> DataFrame:
    """Upsert: the last written row of every point wins.

    The winner is picked with a max over a struct, which combines before the shuffle, so a point
    written a million times costs one row per task.
    """
    both = old.unionByName(new)
    others = [c for c in both.columns if c != key]
    order = [version] + [c for c in others if c != version]
    return both.groupBy(key).agg(F.max(F.struct(*order)).alias("w")).select(key, *[F.col(f"w.{c}").alias(c) for c in others])


# ---------------------------------------------------------------- exact cosine top-k


def _normalised(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _vector(df: DataFrame) -> Column:
    """The vectors as they are stored; other numbers than floats become doubles."""
    kind = df.schema["embedding"].dataType.elementType
    return F.col("embedding") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")


def _block_size(dim: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))


def _order(ids: pa.Array) -> np.ndarray:
    """Places of the ids in their order, NULL first; equal ids share one."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _falling(scores: np.ndarray) -> np.ndarray:
    """A key that puts the highest scores first, and NaN (from vectors that are not finite) before them, as Spark does."""
    return np.where(np.isnan(scores), -np.inf, -scores)


def _score_block(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return q @ v.T


def _few_copies(v: np.ndarray, order: np.ndarray, tags: list[np.ndarray], k: int) -> np.ndarray:
    """The rows without those that follow ``k`` rows of the same vector and tags: no query takes them."""
    mix = np.random.default_rng(1).integers(1, 1 << 62, v.shape[1] + len(tags)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    key = (np.ascontiguousarray(v).view(np.uint64) * mix[: v.shape[1]]).sum(axis=1)
    for tag, m in zip(tags, mix[v.shape[1] :]):
        key += tag.astype(np.uint64) * m
    by = np.lexsort((order, key))
    late = ~within(key[by], k)
    if not late.any():
        return np.arange(len(v))
    first = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
    group = np.cumsum(np.r_[True, key[by][1:] != key[by][:-1]]) - 1
    full = np.flatnonzero(np.isin(group, group[late]))  # only these can lose a row, and only if no two vectors share their key
    head = by[first[group[full]]]
    same = (v[by[full]] == v[head]).all(axis=1)
    for tag in tags:
        same &= tag[by[full]] == tag[head]
    late[full] &= ~np.isin(group[full], group[full][~same])
    return np.sort(by[~late])


def _nearest(
    q: np.ndarray, v: np.ndarray, order: np.ndarray, k: int, level: np.ndarray, allowed: Callable[[slice, slice], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, row, score`` of the ``k`` best rows of ``v`` for each row of ``q`` (both of unit length), ties by ``order``.

    Products in single precision, whose error is bounded, leave out what is clearly below the ``k``-th best or the
    score ``level`` that a query has reached before; the few other pairs are scored in double precision.
    """
    slack = (q.shape[1] + 4) * 2.0**-22  # twice the error on either side, with the rounding of scores
    single, other, found = q.astype(np.float32), v.astype(np.float32), []
    void, in_order = ~q.any(axis=1), None
    wide = max(1, min(len(v), SCORE_ROWS, SCORE_BYTES // 8))
    high = max(1, SCORE_BYTES // (8 * wide))

    def exact(own: slice, near: list[np.ndarray]) -> list[np.ndarray]:
        """The ``k`` best by the rounded scores."""
        query, row, _ = near
        parts = [np.einsum("ij,ij->i", q[own][query[i : i + BLOCK_ROWS]], v[row[i : i + BLOCK_ROWS]]) for i in range(0, len(row), BLOCK_ROWS)]
        score = np.round(np.concatenate([np.zeros(0), *parts]), 9) + 0.0
        by = np.lexsort((order[row], _falling(score), query))
        by = by[within(query[by], k)]
        return [query[by], row[by], score[by]]

    for i in range(0, len(q), high):
        own = slice(i, min(i + high, len(q)))
        size, floor = own.stop - i, level[own].copy()
        kept, waiting = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], []
        for at in np.flatnonzero(void[own]):  # all scores are 0: the first rows in order
            in_order = np.argsort(order, kind="stable") if in_order is None else in_order
            rows = in_order if allowed is None else in_order[allowed(slice(i + at, i + at + 1), slice(None))[0][in_order]]
            waiting.append([np.full(len(rows[:k]), at), rows[:k], np.zeros(len(rows[:k]))])
            floor[at] = np.inf

        def settle() -> None:
            nonlocal kept, waiting
            kept, waiting = [np.concatenate(x) for x in zip(kept, *waiting)], []
            by = np.lexsort((_falling(kept[2]), kept[0]))
            kept = [x[by] for x in kept]
            held = np.bincount(kept[0], minlength=size)
            full = held >= k
            edge = np.full(size, -np.inf)
            edge[full] = kept[2][(np.cumsum(held) - held)[full] + k - 1]
            near = ~(kept[2] < edge[kept[0]] - slack)
            kept = [x[near] for x in kept]
            if len(kept[0]) > 4 * k * size:  # many alike: the scores decide
                kept = exact(own, kept)
            floor[:] = np.maximum(floor, edge)

        for j in range(0, len(v), wide):
            rows = slice(j, j + wide)
            near = _score_block(single[own], other[rows])
            inside = allowed(own, rows) if allowed else None
            if inside is not None:
                near[~inside] = -np.inf
            edge, open_ = floor.copy(), floor == -np.inf
            if near.shape[1] > k and open_.any():
                edge[open_] = np.partition(near[open_], -k, axis=1)[:, -k]
            hit = ~(near < (edge - slack).astype(np.float32)[:, None])
            if inside is not None:
                hit &= inside
            query, row = np.divmod(np.flatnonzero(hit), near.shape[1])
            waiting.append([query, row + j, near[query, row].astype(np.float64)])
            if sum(len(x[0]) for x in waiting) >= k * size:
                settle()
        settle()
        query, row, score = exact(own, kept)
        found.append([query + i, row, score])
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def cosine_top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    vector_id: str = "chunk_id",
    filter_column: str | Sequence[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact ``(query_id, vector_id, score, rank)``: cosine at nine decimals, ties by id.

    Every task multiplies its own vectors with the query matrix and keeps ``k`` rows per query, so
    what is shuffled does not grow with the vector table. Queries may carry ``filter_value``: with
    ``filter_column`` only vectors holding that value are considered for that query (NULL: all). With several
    columns, queries hold them under their own names and all must agree. A column that every query
    restricts also prunes the vector table before it is read (its partitions, if it is laid out by it).

    The query matrix is sent to the tasks only after its size was checked; a larger query table is
    met block against block through an ordinary shuffle instead, within each value of the columns that every
    query restricts.
    """
    if k < 1:
        raise ValueError("k must be positive")
    extra = [filter_column] if isinstance(filter_column, str) else list(filter_column or [])
    wanted = ["filter_value"] if isinstance(filter_column, str) else extra
    tags = [f"filter_{i}" for i in range(len(extra))]
    q = queries.select(F.col(query_id).alias("query_id"), _vector(queries).alias("embedding"), *[F.col(c).alias(t) for c, t in zip(wanted, tags)])
    id_types = (q.schema["query_id"].dataType.simpleString(), vectors.schema[vector_id].dataType.simpleString())
    schema = f"query_id {id_types[0]}, vector_id {id_types[1]}, score double"
    shape = q.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), *[F.count(t).alias(t) for t in tags]).head()
    for column, tag in zip(extra, tags):
        if shape.n and shape[tag] == shape.n:
            wanted_values = q.select(F.col(tag).alias(column)).distinct()
            few = [row[column] for row in wanted_values.limit(PRUNED_VALUES + 1).collect()]
            # A few values are a filter on the scan (and leave out whole partitions); more are a join.
            vectors = vectors.filter(F.col(column).isin(few)) if len(few) <= PRUNED_VALUES else vectors.join(wanted_values, column, "left_semi")
    v = vectors.select(F.col(vector_id).alias("vector_id"), _vector(vectors).alias("embedding"), *[F.col(c).alias(t) for c, t in zip(extra, tags)])
    if not shape.n:
        found = q.sparkSession.createDataFrame([], schema)
    elif shape.n * shape.d * 8 <= broadcast_bytes:
        found = v.mapInArrow(_scan_with(q.toArrow(), k, tags), schema)
    else:
        met = _cells(q, v, [t for t in tags if shape[t] == shape.n], _block_size(shape.d))
        found = met.applyInArrow(_pair_with(k, tags), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("query_id").alias(query_id), F.col("vector_id").alias(vector_id), "score", "rank")
    )


def _scan_with(table: pa.Table, k: int, filters: Sequence[str] = ()):
    qids, qmat = table.column("query_id").combine_chunks(), _normalised(_matrix(table.column("embedding")))
    known, asked = [], []  # numbers of the wanted values of each filter, and what each query wants; -1: any
    for f in filters or ():
        want = table.column(f).to_pylist()
        known.append({x: n for n, x in enumerate(dict.fromkeys(x for x in want if x is not None))})
        asked.append(np.array([-1 if x is None else known[-1][x] for x in want]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, score, ids, level = np.zeros(0, np.int64), np.zeros(0), None, np.full(len(qids), -np.inf)
        for block in _blocks(batches, min(_block_size(qmat.shape[1]), max(2 * SCORE_ROWS, len(qids)))):  # few queries need no large blocks
            names, vmat = block.column("vector_id").combine_chunks(), _normalised(_matrix(block.column("embedding")))
            tags = [np.array([-2 if x is None else number.get(x, -2) for x in block.column(f).to_pylist()]) for f, number in zip(filters or (), known)]
            few = _few_copies(vmat, _order(names), tags, k)
            names, vmat, tags = names.take(pa.array(few)), vmat[few], [t[few] for t in tags]
            limits = [(w, t) for w, t in zip(asked, tags) if not ((w == -1).all() or ((w == w[0]).all() and (t == w[0]).all()))]

            def allowed(own: slice, rows: slice) -> np.ndarray:
                inside = True
                for w, t in limits:
                    inside = inside & ((w[own, None] == -1) | (w[own, None] == t[rows]))
                return inside

            own, row, value = _nearest(qmat, vmat, _order(names), k, level, allowed if limits else None)
            names = names.take(pa.array(row))
            ids = names if ids is None else pa.concat_arrays([ids, names])
            query, score = np.concatenate([query, own]), np.concatenate([score, value])
            by = np.lexsort((_order(ids), _falling(score), query))
            by = by[within(query[by], k)]
            query, score, ids = query[by], score[by], ids.take(pa.array(by))
            held = np.bincount(query, minlength=len(qids))
            full = held == k
            level[full] = score[np.cumsum(held)[full] - 1]
        if ids is not None:
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(query)), ids, pa.array(score)], names=["query_id", "vector_id", "score"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches in tables of about ``rows`` rows."""
    held, count = [], 0
    for batch in batches:
        for at in range(0, len(batch), rows):
            held.append(batch.slice(at, rows))
            count += len(held[-1])
            if count >= rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _cells(left: DataFrame, right: DataFrame, on: Sequence[str], rows: int):
    """Queries and vectors that agree in ``on``, each dealt into blocks of about ``rows``; every pair of blocks is one
    bounded task group. A row travels once for every block of the other side."""
    count = lambda df, name: df.groupBy(*on).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(rows))).cast("int").alias(name))
    if on:
        sizes = cut_lineage(count(left, "qs").join(count(right, "vs"), on))
        left, right = left.join(sizes, on), right.join(sizes, on)
    else:
        sizes = {"qs": F.lit(count(left, "n").head().n), "vs": F.lit(count(right, "n").head().n)}
        left, right = left.withColumns(sizes), right.withColumns(sizes)
    place = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.withColumn("qb", place("query_id", "qs")).withColumn("vb", spread("vs")).drop("qs", "vs")
    right = right.withColumn("vb", place("vector_id", "vs")).withColumn("qb", spread("qs")).drop("qs", "vs")
    return left.groupBy(*on, "qb", "vb").cogroup(right.groupBy(*on, "qb", "vb"))


def _pair_with(k: int, filters: Sequence[str] = ()):
    def pair(qs: pa.Table, vs: pa.Table) -> pa.Table:
        out = list(_scan_with(qs, k, filters)(iter(vs.to_batches()))) if len(qs) else []
        kinds = [("query_id", qs.schema.field("query_id").type), ("vector_id", vs.schema.field("vector_id").type), ("score", pa.float64())]
        return pa.Table.from_batches(out, pa.schema(kinds))

    return pair


# ---------------------------------------------------------------- bucketed variant

# Bits of a signature at most, and the samples that choose the buckets. The samples only steer the work.
MOST_BITS, ASKED, MET = 16, 256, 4096
# Share of neighbours that a choice must find in the sample beyond the wanted recall.
MARGIN = 0.03
# Cost of a query's row in one bucket, in scored pairs; buckets must cost at most this share of the exact search.
ROW_COST, WORTH = 100, 0.5


def lsh_planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """``(tables, bits, dim)`` fixed +-1 projections; the signs come from md5, so every task agrees."""
    import hashlib

    sign = lambda *at: 1.0 if hashlib.md5(":".join(map(str, at)).encode()).digest()[0] & 1 else -1.0
    return np.array([[[sign(t, b, d) for d in range(dim)] for b in range(bits)] for t in range(tables)])


def lsh_codes(matrix: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """``(rows, tables)`` sign patterns as numbers, the first projection in the highest bit."""
    tables, bits, dim = planes.shape
    signs = (matrix.reshape(-1, dim) @ planes.reshape(-1, dim).T >= 0).reshape(-1, tables, bits)
    return (signs * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)


def _masks(bits: int, radius: int) -> np.ndarray:
    return np.array([m for m in range(1 << bits) if m.bit_count() <= radius])


def _choose(q: DataFrame, v: DataFrame, k: int, rows: int, planes: np.ndarray, widths: list[int], recall: float) -> tuple[int, int, int] | None:
    """``(tables, bits, radius)`` of the cheapest probes that find the wanted share of the exact neighbours.

    The exact neighbours of a sample of queries are searched; copies (which always share a bucket) do not
    count. ``None``: nothing costs clearly less than the exact search.
    """
    tables, longest, _ = planes.shape
    asked = q.orderBy(F.xxhash64("query_id", F.lit(1)), "query_id").limit(ASKED)
    near = cosine_top_k(asked, v, k, vector_id="vector_id").filter(F.col("score") < 1 - 1e-8).select("query_id", "vector_id")
    pairs = near.join(asked, "query_id").join(v.withColumnRenamed("embedding", "other"), "vector_id").select("embedding", "other").toArrow()
    met = v.orderBy(F.xxhash64("vector_id", F.lit(2)), "vector_id").limit(MET).select("embedding").toArrow()
    code = lambda column: lsh_codes(_matrix(column), planes)
    apart = code(pairs.column("embedding")) ^ code(pairs.column("other"))
    every = code(asked.select("embedding").toArrow().column("embedding"))[:, None] ^ code(met.column("embedding"))[None]
    found = []
    for bits in widths:
        near_by = np.bitwise_count(apart >> (longest - bits))
        shares = [np.bincount(np.bitwise_count(every[:, :, t] >> (longest - bits)).ravel(), minlength=bits + 1).cumsum() / every[:, :, 0].size for t in range(tables)]
        for used in sorted({1, 2, 4, 8, 16, tables}):
            if used > tables:
                continue
            least = near_by[:, :used].min(axis=1)
            for radius in range(bits + 1):
                if not len(least) or (least <= radius).mean() >= min(1.0, recall + MARGIN):
                    cost = rows * sum(s[radius] for s in shares[:used]) + ROW_COST * used * len(_masks(bits, radius))
                    found.append((cost, used, bits, radius))
                    break
    best = min(found, default=None)
    return best[1:] if best and best[0] <= WORTH * rows else None


def _bucket_rows(df: DataFrame, key: str, planes: np.ndarray, bits: int, masks: np.ndarray) -> DataFrame:
    """``(key, embedding, bucket)``: every vector once in each of its buckets."""
    tables, longest, dim = planes.shape
    kind = df.schema[key].dataType.simpleString()
    step = max(1, (32 << 20) // (8 * dim * tables * len(masks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                codes = lsh_codes(_matrix(batch.column("embedding")), planes) >> (longest - bits)
                keys = (codes[:, :, None] ^ masks) | (np.arange(tables)[None, :, None] << bits)
                rows = batch.take(pa.array(np.repeat(np.arange(len(batch)), keys[0].size)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys.ravel(), pa.int64())], names=[key, "embedding", "bucket"])

    return df.select(key, "embedding").mapInArrow(run, f"{key} {kind}, embedding array<double>, bucket long")


def _in_buckets(q: DataFrame, v: DataFrame, k: int, planes: np.ndarray, bits: int, radius: int) -> DataFrame:
    """Best ``k`` of every query within each bucket it probes; a bucket is met in cells of bounded size."""
    left, right = _bucket_rows(q, "query_id", planes, bits, _masks(bits, radius)), _bucket_rows(v, "vector_id", planes, bits, _masks(bits, 0))
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, vector_id {v.schema['vector_id'].dataType.simpleString()}, score double"
    found = _cells(left, right, ["bucket"], _block_size(planes.shape[2])).applyInArrow(_pair_with(k), schema)
    return found.groupBy("query_id", "vector_id").agg(F.max("score").alias("score"))


def lsh_top_k(
    queries: DataFrame, vectors: DataFrame, k: int, *, dim: int, bits: int | None = None, tables: int = 8,
    query_id: str = "query_id", vector_id: str = "chunk_id", recall: float = 0.9,
) -> DataFrame:
    """Search through buckets of sign patterns with a recall of at least ``recall``, scores and ranks exact.

    Number of tables (up to ``tables``), bits (unless given) and how many bits a probed bucket may differ in
    come from the exact neighbours of a sample of queries. Queries with fewer than ``k`` candidates are
    searched exactly, and so are all where buckets would not cost clearly less, as with vectors without clusters.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = vectors.select(F.col(vector_id).alias("vector_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = v.count()
    widths = [bits] if bits else list(range(2, MOST_BITS + 1, 2))
    planes = lsh_planes(dim, widths[-1], tables)
    chosen = _choose(q, v, k, rows, planes, widths, recall) if rows else None
    if not chosen:
        return cosine_top_k(queries, vectors, k, query_id=query_id, vector_id=vector_id)
    found = cut_lineage(_in_buckets(q, v, k, planes[: chosen[0]], chosen[1], chosen[2]))
    enough = found.groupBy("query_id").count().filter(F.col("count") >= min(k, rows))
    rest = cosine_top_k(q.join(enough, "query_id", "left_anti"), v, k, vector_id="vector_id").drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_id")
    both = found.join(enough, "query_id", "left_semi").unionByName(rest)
    return (
        both.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("query_id").alias(query_id), F.col("vector_id").alias(vector_id), "score", "rank")
    )
