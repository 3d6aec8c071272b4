"""Exact top-k by inner product with an M-tree for each shard, searched best first.

Inner products become distances of a metric: with ``M`` the longest norm of a shard, ``x`` is extended by
``sqrt(M^2 - |x|^2)`` and a query by 0, so a larger product is a smaller Euclidean distance. A tree is a
table of pages. An entry of an inner page holds a routing vector, the covering radius of what lies below,
the distance to the routing vector of its own page, and the child; an entry of a leaf holds a vector and
its distance to the page's routing vector.

A query takes pages in order of their least possible distance. Before any distance to an entry is computed,
``|d(query, page) - d(page, entry)| - radius`` bounds it from below, and entries past the k-th distance are
left out. Bounds carry a margin for rounding, scores themselves are exact whole numbers, so ties are exact.

Defined cases: see ``vector_cells``; a table with no usable row, or no query, gives no result; fewer
candidates than ``top`` are all returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from citeloom.llm import vector_cells as cells
from citeloom.llm.common import cut_lineage

#: Entries of a page.
PAGE = 256
PAGES = ("dim int, shard int, page int, leaf boolean, vectors binary, radius binary, to_parent binary, child binary, ids array<array<long>>")


def extended(x: np.ndarray) -> np.ndarray:
    norms = (x * x).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def build_pages(x: np.ndarray, ids: list, page: int = PAGE) -> Iterator[tuple]:
    """Pages (number, leaf, vectors, radius, to_parent, child, ids) of a tree; page 0 is the root."""
    rng, full, numbers = np.random.default_rng(len(x)), extended(x), iter(range(1, 2 * len(x) + 2))

    def grow(number: int, rows: np.ndarray, parent: np.ndarray) -> Iterator[tuple]:
        if len(rows) <= page:
            to = distances(full[rows], parent)
            yield number, True, full[rows], np.zeros(len(rows)), to, np.zeros(len(rows), np.int32), [ids[r] for r in rows]
            return
        seeds = rows[rng.choice(len(rows), min(page, -(-len(rows) // page) + 1), replace=False)]
        apart = ((full[rows] ** 2).sum(1)[:, None] - 2 * full[rows] @ full[seeds].T + (full[seeds] ** 2).sum(1)[None, :])
        nearest = apart.argmin(axis=1)
        nearest[np.searchsorted(rows, seeds)] = np.arange(len(seeds))  # a seed stays with itself, so parts shrink
        parts = [rows[nearest == i] for i in range(len(seeds))]
        children = [next(numbers) for _ in parts]
        radius = np.array([distances(full[p], full[s]).max() for p, s in zip(parts, seeds, strict=True)])
        yield number, False, full[seeds], radius, distances(full[seeds], parent), np.array(children, np.int32), []
        for child, part, seed in zip(children, parts, seeds, strict=True):
            yield from grow(child, part, full[seed])

    yield from grow(0, np.arange(len(x)), np.zeros(full.shape[1]))


def build(group: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(group["v"].to_numpy()).astype(np.float64)
    rows = [
        (int(group["dim"].iloc[0]), int(group["shard"].iloc[0]), n, leaf, v.tobytes(), r.tobytes(), t.tobytes(), c.tobytes(), i)
        for n, leaf, v, r, t, c, i in build_pages(x, [list(map(int, i)) for i in group["ids"]])
    ]
    return pd.DataFrame(rows, columns=["dim", "shard", "page", "leaf", "vectors", "radius", "to_parent", "child", "ids"])


class Tree:
    """A shard's pages. All extended vectors of a shard have the norm ``M``, so a product gives a distance."""

    def __init__(self, pages: pd.DataFrame):
        dim = int(pages["dim"].iloc[0]) + 1
        self.pages, self.computed, self.longest = {}, 0, 0.0
        for p in pages.itertuples(index=False):
            v = np.frombuffer(p.vectors).reshape(-1, dim)
            self.longest = max(self.longest, float((v[0] * v[0]).sum()))
            self.pages[p.page] = (p.leaf, np.ascontiguousarray(v[:, :-1]), np.frombuffer(p.radius), np.frombuffer(p.to_parent), np.frombuffer(p.child, np.int32), p.ids)

    def nearest(self, query: np.ndarray, k: int) -> list[tuple[float, int, list[int]]]:
        """(score, first id, ids) of the ``k`` largest inner products, ties to smaller first ids."""
        base = float(query @ query) + self.longest
        margin = 1e-6 * (1 + np.sqrt(base))
        best: list[tuple[float, int, list[int]]] = []  # a heap whose head is the worst of the best
        reach = np.inf
        queue = [(0.0, 0, float(np.sqrt(query @ query)))]
        while queue:
            bound, number, from_page = heapq.heappop(queue)
            if bound > reach:
                break
            leaf, vectors, radius, to_parent, child, ids = self.pages[number]
            near = np.nonzero(np.abs(from_page - to_parent) - radius <= reach)[0]
            self.computed += len(near)
            scores = (vectors if len(near) == len(vectors) else vectors[near]) @ query
            if not leaf:
                away = np.sqrt(np.maximum(base - 2 * scores, 0.0))
                low = np.maximum(away - radius[near] - margin, bound)
                for j in np.nonzero(low <= reach)[0]:
                    heapq.heappush(queue, (float(low[j]), int(child[near[j]]), float(away[j])))
                continue
            floor = best[0][0] if len(best) == k else np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
            for j in np.nonzero(scores >= floor)[0]:
                item = (float(scores[j]), -int(ids[near[j]][0]), ids[near[j]])
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item[:2] > best[0][:2]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                reach = np.sqrt(max(base - 2 * best[0][0], 0.0)) + margin
        return sorted(best, key=lambda b: (-b[0], -b[1]))


def searcher(top: int) -> Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame]:
    def search(pages: pd.DataFrame, ids: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
        tree, rows = Tree(pages), []
        for own, v in zip(ids.tolist(), vectors, strict=True):
            found = tree.nearest(v, top + 1)
            rows += cells.best_rows(own, np.arange(len(found)), np.array([f[0] for f in found]), [f[2] for f in found], top)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"score": np.int64})

    return search


def top_products(vectors: DataFrame, queries: DataFrame, top: int, *, shard: int = cells.SHARD, block: int = cells.BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``vectors`` and ``queries`` of (id, v) with whole-number components."""
    reps, shards = cells.sharded(vectors, top + 1, shard)
    pages = cut_lineage(reps.groupBy("dim", "shard").applyInPandas(build, PAGES))
    return cells.search_cells(pages, queries, shards, searcher(top), top=top, score="long", block=block)
