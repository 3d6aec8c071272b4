"""A linear-chain conditional random field over words, in numpy: features, training and marginals.

A word's features are its affixes, its character n-grams and the lexicons it stands in; a label's score at a
word is the sum of their weights, and a learned score of each change of labels links neighbours. Marginals
are those of the forward-backward algorithm. Chains are cut into segments of ``SEGMENT`` words that advance
together; what enters a segment from either side follows from products of transfer matrices, so a chain of
any length gives the marginals of the whole chain without a step per word.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa

from citeloom.llm.common import Prefix, mix

FEATURES = 1 << 18
PREFIXES, SUFFIXES, GRAMS = (1, 2, 3), (1, 2, 3, 4), (2, 3)
SEGMENT = 64


def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def lowered(text: str | None) -> str:
    """Lower case with every code point in its place."""
    low = (text or "").lower()
    return low if len(low) == len(text or "") else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(texts: list[str | None], letter: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, text, start, stop): runs of letters in order, which text each is of, and where it stands there."""
    held = [lowered(t) for t in texts]
    codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) for t in held], dtype=np.int64)])
    inside = letter[codes]
    edge = np.zeros(len(codes) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    ends = 4 * np.concatenate([np.zeros(1, np.int64), np.cumsum(stop - start)])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(codes[inside])])
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, offsets)))
    return flat.dictionary_encode(), text, start - offsets[text], stop - offsets[text]


def spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of an array of words."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    codes = np.frombuffer(data, np.uint32) if data is not None else np.zeros(0, np.uint32)
    return codes[offsets[0] // 4 : offsets[-1] // 4], (offsets - offsets[0]) // 4


class Features:
    """The features of an array of words: those with one per word, and n-grams with their owners."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        prefix, lo, hi = Prefix(codes), offsets[:-1], offsets[1:]
        self.words = len(lo)
        self.names = prefix.runs(lo, hi)
        single = [self._place(prefix.runs(lo, np.minimum(lo + n, hi)), n) for n in PREFIXES]
        single += [self._place(prefix.runs(np.maximum(hi - n, lo), hi), 16 + n) for n in SUFFIXES]
        self.single = single
        owner = np.repeat(np.arange(len(lo)), hi - lo)
        grams, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in GRAMS:
            at = np.arange(max(0, len(codes) - n + 1))
            at = at[owner[at] == owner[at + n - 1]]
            grams.append(self._place(prefix.runs(at, at + n), 32 + n))
            owners.append(owner[at])
        self.grams, self.owner = np.concatenate(grams), np.concatenate(owners)

    @staticmethod
    def _place(h: np.ndarray, kind: int) -> np.ndarray:
        return (mix(h + np.uint64(kind)) % np.uint64(FEATURES)).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(words, labels): sums of the weights of every word's features."""
        out = np.zeros((self.words, weights.shape[1]))
        for ids in self.single:
            out += weights[ids]
        for label in range(weights.shape[1]):
            out[:, label] += np.bincount(self.owner, weights[self.grams, label], minlength=self.words)
        return out

    def spread(self, error: np.ndarray) -> np.ndarray:
        """(features, labels): the errors of words carried to their features."""
        out = np.zeros((FEATURES, error.shape[1]))
        for label in range(error.shape[1]):
            for ids in self.single:
                out[:, label] += np.bincount(ids, error[:, label], minlength=FEATURES)
            out[:, label] += np.bincount(self.grams, error[self.owner, label], minlength=FEATURES)
        return out


def marginals(score: np.ndarray, moves: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(words, labels): label probabilities of each word of the chains that end at ``bounds[1:]``."""
    n, labels = score.shape
    if not n:
        return np.zeros((0, labels))
    sizes = np.diff(bounds)
    sizes = sizes[sizes > 0]
    parts = -(-sizes // SEGMENT)  # segments of each chain
    first_part = np.cumsum(parts) - parts
    total = int(parts.sum())
    chain = np.repeat(np.arange(len(sizes)), parts)
    within = np.arange(total) - first_part[chain]
    length = np.minimum(sizes[chain] - within * SEGMENT, SEGMENT)
    begin = (np.cumsum(sizes) - sizes)[chain] + within * SEGMENT
    e = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -60))
    a, s = np.exp(np.maximum(moves - moves.max(), -30)), np.exp(np.maximum(starts - starts.max(), -30))
    at = np.minimum(begin[None, :] + np.arange(SEGMENT)[:, None], n - 1)
    live = np.arange(SEGMENT)[:, None] < length[None, :]
    is_first, is_last = within == 0, within == parts[chain] - 1

    def norm(v: np.ndarray) -> np.ndarray:
        return v / v.sum(axis=-1, keepdims=True)

    def forward(lanes: np.ndarray, enter: np.ndarray, keep: bool):
        v, rows = enter, []
        for i in range(SEGMENT):
            ahead = v @ a
            if i == 0:
                ahead = np.where(is_first[lanes][:, None], s, ahead)
            v = norm(ahead * e[at[i, lanes]])
            if keep:
                rows.append(v)
        return rows if keep else v

    def backward(lanes: np.ndarray, leave: np.ndarray, alphas: list | None):
        """What stands before the segment; with ``alphas``, the marginals written to their words."""
        v = leave
        for i in range(SEGMENT - 1, -1, -1):
            on = live[i, lanes]
            if alphas is not None:
                out[at[i, lanes[on]]] = norm(alphas[i][on] * v[on])
            v = np.where(on[:, None], norm((v * e[at[i, lanes]]) @ a.T), v)
        return v

    out = np.empty((n, labels))
    enter, leave = np.ones((total, labels)), np.ones((total, labels))
    many = np.nonzero(parts > 1)[0]
    if len(many):
        middle = np.nonzero(~is_first & ~is_last)[0]
        transfer = np.broadcast_to(np.eye(labels), (len(middle), labels, labels))
        for i in range(SEGMENT):
            transfer = (transfer.reshape(-1, labels) @ a).reshape(len(middle), labels, labels) * e[at[i, middle]][:, None, :]
            transfer = transfer / transfer.sum(axis=(1, 2), keepdims=True)
        own = np.full(total, -1)
        own[middle] = np.arange(len(middle))
        heads, tails = first_part[many], first_part[many] + parts[many] - 1
        enter[heads + 1] = forward(heads, enter[heads], False)
        leave[tails - 1] = backward(tails, leave[tails], None)
        by_size = np.argsort(-parts[many], kind="stable")
        heads, tails, count = heads[by_size], tails[by_size], parts[many][by_size]
        for j in range(1, int(count[0]) - 1):  # one step per segment, all chains that have as many
            open_ = int(np.searchsorted(-count, -(j + 1), side="left"))
            here, there = heads[:open_] + j, tails[:open_] - j
            enter[here + 1] = norm(np.einsum("nl,nlm->nm", enter[here], transfer[own[here]]))
            leave[there - 1] = norm(np.einsum("nlm,nm->nl", transfer[own[there]], leave[there]))
    every = np.arange(total)
    backward(every, leave, forward(every, enter, True))
    return out


class Chain:
    """Weights, label changes and lexicons; labels are indices."""

    def __init__(self, labels: int):
        self.weights = np.zeros((FEATURES, labels), np.float32)
        self.lexicon = np.zeros(0, np.uint64)  # sorted names of words
        self.member = np.zeros((0, labels), bool)
        self.listed = np.zeros((labels + 1, labels), np.float32)  # weights of standing in each lexicon, or in none
        self.moves, self.starts = np.zeros((labels, labels)), np.zeros(labels)

    def lists(self, names: np.ndarray) -> np.ndarray:
        """(words, labels + 1): which lexicons hold each word; the last column stands for none."""
        out = np.zeros((len(names), self.member.shape[1] + 1))
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, names), len(self.lexicon) - 1)
            out[:, :-1] = self.member[at] & (self.lexicon[at] == names)[:, None]
        out[:, -1] = ~out[:, :-1].any(axis=1)
        return out

    def word_scores(self, words: pa.Array) -> np.ndarray:
        found = Features(*spell(words))
        return found.scores(self.weights) + self.lists(found.names) @ self.listed

    def fit(self, words: pa.DictionaryArray, label: np.ndarray, chain: int, *, steps: int, rate: float = 0.1, l2: float = 2e-3) -> list[float]:
        """Adam on the likelihood of chains of ``chain`` words; returns the loss of each step."""
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found = Features(*spell(words.dictionary))
        listed, k = self.lists(found.names), self.moves.shape[0]
        gold_words = np.bincount(code * k + label, minlength=found.words * k).reshape(-1, k)
        heads = np.arange(0, len(code), chain)
        pairs = np.ones(len(code) - 1, bool)
        pairs[heads[1:] - 1] = False
        gold_moves = np.bincount((label[:-1] * k + label[1:])[pairs], minlength=k * k).reshape(k, k)
        gold_starts = np.bincount(label[heads], minlength=k)
        params = [self.weights.astype(float), self.listed.astype(float), self.moves, self.starts]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        losses = []
        for t in range(1, steps + 1):
            score = (found.scores(params[0]) + listed @ params[1])[code]
            log_z, each, moved, started = expectations(score.reshape(-1, chain, k), params[2], params[3])
            path = score[np.arange(len(code)), label].sum() + (gold_moves * params[2]).sum() + (gold_starts * params[3]).sum()
            losses.append(float(log_z - path) / len(code))
            model_words = np.column_stack([np.bincount(code, each[:, j], minlength=found.words) for j in range(k)])
            error = (model_words - gold_words) / len(code)
            grads = [found.spread(error), listed.T @ error, (moved - gold_moves) / len(code), (started - gold_starts) / len(code)]
            for i, (p, g) in enumerate(zip(params, grads)):
                g = g + (l2 / len(heads)) * p
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                params[i] = p - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-6)
        self.weights, self.listed, self.moves, self.starts = params[0].astype(np.float32), params[1].astype(np.float32), params[2], params[3]
        return losses

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Chain:
        held = np.load(io.BytesIO(data), allow_pickle=False)
        own = cls(held["starts"].shape[0])
        for name in vars(own):
            setattr(own, name, held[name])
        return own


def expectations(score: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log partition sum of equal chains, label probabilities, and expected changes and starts."""
    chains, n, k = score.shape
    top = score.max(axis=2, keepdims=True)
    e, a = np.exp(score - top), np.exp(moves)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((chains, n))
    v = np.exp(starts) * e[:, 0]
    for i in range(n):
        if i:
            v = (v @ a) * e[:, i]
        scale[:, i] = v.sum(axis=1)
        v = v / scale[:, i, None]
        alpha[:, i] = v
    moved = np.zeros((k, k))
    for i in range(n - 2, -1, -1):
        ahead = e[:, i + 1] * beta[:, i + 1] / scale[:, i + 1, None]
        moved += a * (alpha[:, i].T @ ahead)
        beta[:, i] = ahead @ a.T
    each = alpha * beta
    return float(np.log(scale).sum() + top.sum()), each.reshape(-1, k), moved, each[:, 0].sum(axis=0)
