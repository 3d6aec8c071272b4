"""Blockwise sorting of suffixes to a fixed depth, with the ranks of a difference-cover sample.

Suffixes are compared in their first ``DEPTH`` bytes. A difference cover of period ``PERIOD`` holds, for any
two positions, a shift below the period that takes both into the cover. The suffixes at cover positions are
ranked beforehand to ``SAMPLED`` bytes: by their first ``PERIOD`` bytes, and twice by pairs of ranks. Any two
suffixes are then compared in constant time: ``PERIOD`` bytes directly, the cover ranks at their common shift,
and the last ``PERIOD`` bytes directly; so long ties cost no more than short ones.

Buckets of suffixes are sorted a few at a time (``BLOCK`` suffixes), by three-way partition around a pivot of
each bucket, all buckets of a block in step. Memory holds the text, the sample's ranks and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DEPTH, PERIOD = 200, 40
SAMPLED = DEPTH - PERIOD
BLOCK = 1 << 20
WORDS = PERIOD // 8


def difference_cover(period: int) -> np.ndarray:
    """A small set of residues whose differences give every residue, grown greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gains = [(len({d % period for c in cover for d in (x - c, c - x)} & missing), -x) for x in range(period) if x not in cover]
        x = -max(gains)[1]
        missing -= {d % period for c in cover for d in (x - c, c - x)}
        cover.append(x)
    return np.array(sorted(cover))


COVER = difference_cover(PERIOD)
SLOT = np.full(PERIOD, -1)
SLOT[COVER] = np.arange(len(COVER))
#: The shift that takes residues ``a`` and ``b`` into the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if SLOT[(a + d) % PERIOD] >= 0 and SLOT[(b + d) % PERIOD] >= 0) for b in range(PERIOD)] for a in range(PERIOD)])


def dense(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Ranks of rows by ``keys`` (the most significant first), equal rows alike."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        sorted_key = k[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


class Suffixes:
    """A text and the ranks of its cover sample."""

    def __init__(self, text: np.ndarray):
        self.size = len(text)
        periods = -(-self.size // PERIOD) + 1
        padded = np.zeros(periods * PERIOD + DEPTH + PERIOD + 8, np.uint8)
        padded[: self.size] = text
        # The eight bytes from every position on, as a number in byte order.
        view = np.lib.stride_tricks.sliding_window_view(padded, 8)
        self.words = np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)
        places = (np.arange(periods)[:, None] * PERIOD + COVER).ravel()
        rank = dense(tuple(self.word(places, i) for i in range(WORDS)))
        step = len(COVER)
        for reach in (1, 2):  # 40 bytes, then 80, then 160
            ahead = np.full(len(rank), -1, np.int64)
            ahead[: len(rank) - reach * step] = rank[reach * step :]
            rank = dense((rank, ahead))
        self.rank = rank

    def word(self, places: np.ndarray, i: int) -> np.ndarray:
        return self.words[places + 8 * i]

    def sample_rank(self, places: np.ndarray) -> np.ndarray:
        return self.rank[places // PERIOD * len(COVER) + SLOT[places % PERIOD]]

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of suffixes to the depth."""
        out = np.zeros(len(a), np.int8)
        open_ = np.arange(len(a))

        def settle(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal open_
            out[open_] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
            open_ = open_[x == y]

        for i in range(WORDS):
            settle(self.word(a[open_], i), self.word(b[open_], i))
        shift = SHIFT[a[open_] % PERIOD, b[open_] % PERIOD]
        settle(self.sample_rank(a[open_] + shift), self.sample_rank(b[open_] + shift))
        for i in range(WORDS):
            settle(self.word(a[open_] + SAMPLED, i), self.word(b[open_] + SAMPLED, i))
        return out

    def repeated(self, places: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Which suffixes equal another one of their bucket to the depth (a mask over ``places``)."""
        found = np.zeros(len(places), bool)
        for rows in self._blocks(bucket):
            group = bucket[rows]
            while len(rows):
                first = np.concatenate([[0], np.nonzero(group[1:] != group[:-1])[0] + 1])
                sizes = np.diff(np.append(first, len(rows)))
                rows, sizes = rows[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
                if not len(rows):
                    break
                first = np.cumsum(sizes) - sizes
                own = np.repeat(np.arange(len(sizes)), sizes)
                pivot = (first + sizes // 2)[own]
                side = self.compare(places[rows], places[rows[pivot]])
                same = np.bincount(own[side == 0], minlength=len(sizes)) > 1
                found[rows[(side == 0) & same[own]]] = True
                left = side != 0
                rows, group = rows[left], 2 * own[left] + (side[left] > 0)
                order = np.argsort(group, kind="stable")
                rows, group = rows[order], group[order]
        return found

    @staticmethod
    def _blocks(bucket: np.ndarray) -> Iterator[np.ndarray]:
        """Rows by bucket, in blocks of whole buckets; a bucket of one is left out."""
        order = np.argsort(bucket, kind="stable")
        key = bucket[order]
        first = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1]) if len(key) else np.zeros(0, np.int64)
        ends, start = np.append(first[1:], len(key)), 0
        while start < len(first):
            stop = max(start + 1, int(np.searchsorted(ends, first[start] + BLOCK, side="right")))
            sizes = (ends - first)[start:stop]
            yield order[first[start] : ends[stop - 1]][np.repeat(sizes > 1, sizes)]
            start = stop
