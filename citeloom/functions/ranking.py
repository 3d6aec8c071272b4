"""Best rows of a block of scores, for scans that keep a few rows per query."""

from __future__ import annotations

import numpy as np


def within(group: np.ndarray, k: int) -> np.ndarray:
    """Which of the rows, ordered by ``group``, are among the first ``k`` of theirs."""
    at = np.arange(len(group))
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0)) < k


def best_rows(scores: np.ndarray, position: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``query, row`` of the ``k`` highest scores above zero in each column, ties by ``position``."""
    n = len(scores)
    edge = np.partition(scores, n - k, axis=0)[n - k] if n > k else np.zeros(scores.shape[1], scores.dtype)
    q, row = np.nonzero(((scores > 0) & (scores >= edge)).T)
    order = np.lexsort((position[row], -scores[row, q], q))
    q, row = q[order], row[order]
    near = within(q, k)
    return q[near], row[near]
