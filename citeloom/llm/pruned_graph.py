"""Approximate nearest neighbours by a robust-pruned directed graph for each shard.

The graph of a shard starts with random edges. Points are inserted again in batches, twice: a greedy beam
search from the central point proposes neighbours, and relaxed pruning keeps the nearest candidate, drops
those that lie ``alpha`` times closer to it than to the point, and goes on until ``DEGREE`` diverse edges are
kept; each edge is offered in the other direction too, and pruned there by the same rule. A query is searched
with a beam in every shard, and the best of all shards are ranked by exact cosine in double precision.

Every usable vector is in one graph and the searches of one block advance together in numpy. Recall against
brute force is measured in ``tests/llm/test_pruned_graph.py``.

Defined cases: see ``vector_cells``; zero vectors take no part either.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import vector_cells as cells
from citeloom.llm.common import cut_lineage

DEGREE, BEAM, ALPHAS, BATCH = 32, 64, (1.0, 1.2), 256
SEARCH_BEAM = 96
GRAPH = "dim int, shard int, center int, vectors binary, links binary, ids array<array<long>>"


def beam_search(x: np.ndarray, links: np.ndarray, center: int, q: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the nearest points found for each query, nearest first; -1 where none."""
    n, m = len(x), len(q)
    norms = np.einsum("ij,ij->i", x, x)
    ids = np.full((m, beam), -1, np.int32)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = center, norms[center] - 2 * q @ x[center], False
    seen = np.zeros((m, n + 1), bool)  # the last column stands for "no point"
    seen[:, center] = seen[:, n] = True
    live = np.arange(m)
    while len(live):
        order = np.argsort(np.where(done[live], np.inf, dist[live]), axis=1, kind="stable")[:, :step]
        picked = np.take_along_axis(ids[live], order, 1)
        idle = np.take_along_axis(done[live], order, 1)
        go = ~idle[:, 0]
        live, picked, idle, order = live[go], picked[go], idle[go], order[go]
        if not len(live):
            break
        done[live[:, None], order] = True
        near = np.where(idle[:, :, None], n, links[np.where(idle, 0, picked)]).reshape(len(live), -1)
        near.sort(axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        at = np.minimum(near, n - 1)
        away = norms[at] - 2 * np.einsum("ijk,ik->ij", x[at], q[live])
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_dist = np.concatenate([dist[live], np.where(fresh, away, np.inf)], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live], done[live] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_dist, all_done))
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """At most ``degree`` diverse edges of each point among its candidates (``len(x)`` stands for none)."""
    n = len(x)
    candidates = np.sort(np.where((candidates < 0) | (candidates == points[:, None]), n, candidates), axis=1)
    alive = candidates < n
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    at = np.minimum(candidates, n - 1)
    v = x[at]
    squares = np.einsum("ijk,ijk->ij", v, v)
    away = np.einsum("ik,ik->i", x[points], x[points])[:, None] - 2 * np.einsum("ijk,ik->ij", v, x[points]) + squares
    away = np.where(alive, away, np.inf)
    between = squares[:, :, None] - 2 * v @ v.transpose(0, 2, 1) + squares[:, None, :]
    out = np.full((len(points), degree), n, np.int32)
    rows, held = np.arange(len(points)), away.copy()
    for slot in range(degree):
        best = held.argmin(axis=1)
        ok = np.isfinite(held[rows, best])
        if not ok.any():
            break
        out[ok, slot] = candidates[rows, best][ok]
        drop = alpha * alpha * between[rows, best] <= away
        drop[rows, best] = True
        held[drop & ok[:, None]] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alphas: tuple[float, ...] = ALPHAS, batch: int = BATCH) -> tuple[np.ndarray, int]:
    """(links, center); ``links[i]`` holds the edges of ``i``, filled up with ``len(x)``."""
    n = len(x)
    rng = np.random.default_rng(n)
    center = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    links = rng.integers(0, n, (n, degree)).astype(np.int32)
    links[links == np.arange(n)[:, None]] = n
    for alpha in alphas:
        order = rng.permutation(n)
        for start in range(0, n, batch):
            points = order[start : start + batch]
            found, _ = beam_search(x, links, center, x[points], beam)
            links[points] = robust_prune(x, points, np.concatenate([found, links[points]], 1), alpha, degree)
            offered = links[points]
            source, target = np.repeat(points, degree), offered.ravel()
            source, target = source[target < n], target[target < n]
            away = ((x[source] - x[target]) ** 2).sum(axis=1)
            sort = np.lexsort((away, target))
            source, target = source[sort], target[sort]
            unique, first, count = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(first, count)
            new = np.full((len(unique), degree), n, np.int32)
            kept = place < degree  # the nearest offers; a point cannot keep more edges anyway
            new[np.repeat(np.arange(len(unique)), count)[kept], place[kept]] = source[kept]
            for s in range(0, len(unique), 4 * batch):
                some = unique[s : s + 4 * batch]
                links[some] = robust_prune(x, some, np.concatenate([links[some], new[s : s + 4 * batch]], 1), alpha, degree)
    return links, center


def unit(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / top  # no overflow or underflow of squares
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    dot, scale = (v * q).sum(axis=1), np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum())
    return dot / scale


def build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.assign(first=[int(i[0]) for i in group["ids"]]).sort_values("first")
    v = np.stack(group["v"].to_numpy()).astype(np.float64)
    links, center = build_graph(unit(v))
    row = (int(group["dim"].iloc[0]), int(group["shard"].iloc[0]), center, v.tobytes(), links.tobytes(), [list(map(int, i)) for i in group["ids"]])
    return pd.DataFrame([row], columns=["dim", "shard", "center", "vectors", "links", "ids"])


def searcher(top: int, beam: int) -> Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame]:
    def search(graph: pd.DataFrame, ids: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
        g, rows = graph.iloc[0], []
        v = np.frombuffer(g["vectors"]).reshape(len(g["ids"]), -1)
        x, links = unit(v), np.frombuffer(g["links"], np.int32).reshape(len(v), -1)
        for start in range(0, len(ids), BATCH):
            part = vectors[start : start + BATCH]
            found, _ = beam_search(x, links, int(g["center"]), unit(part), beam)
            for own, q, near in zip(ids[start : start + BATCH].tolist(), part, found, strict=True):
                near = near[near >= 0][: 2 * top + 2]
                rows += cells.best_rows(own, near, cosines(v[near], q).tolist(), g["ids"], top)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, queries: DataFrame, top: int, *, shard: int = cells.SHARD, block: int = cells.BLOCK, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found by cosine, for (id, v) rows."""
    nonzero = F.exists("v", lambda x: x != 0)
    reps, shards = cells.sharded(vectors.filter(nonzero), top + 1, shard)
    graphs = cut_lineage(reps.groupBy("dim", "shard").applyInPandas(build, GRAPH))
    return cells.search_cells(graphs, queries.filter(nonzero), shards, searcher(top, beam), top=top, score="double", block=block)
