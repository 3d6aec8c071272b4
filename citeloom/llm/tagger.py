"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters are classes (letters without case, one class for all digits, one for each sign). Both directions
run as one batched product. Training maximises the CRF likelihood of tag sequences by Adam; gradients are
those of back-propagation through time and of the forward-backward algorithm. Decoding is Viterbi's.
"""

from __future__ import annotations

import io

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
OUTSIDE = 0
#: Class of each code point below 128; 0 is padding, 1 any other code point.
CLASSES = np.ones(128, np.int64)
_kinds: dict[str, int] = {}
for _c in map(chr, range(9, 127)):
    _name = "0" if _c.isdigit() else _c.lower()
    CLASSES[ord(_c)] = _kinds.setdefault(_name, len(_kinds) + 2)
VOCABULARY = len(_kinds) + 2
#: Tag changes that make no span: inside a kind only after its begin or inside.
FORBIDDEN = np.zeros((TAGS, TAGS), bool)
for _k in range(len(KINDS)):
    FORBIDDEN[:, 2 + 2 * _k] = True
    FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False
NEVER = -1e4


def classes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 128, CLASSES[np.minimum(codes, 127)], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    SHAPES = ("table", "inner", "out", "bias", "moves", "starts")

    def __init__(self, hidden: int = 20, seed: int = 0, kind: type = np.float32):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        gates = np.zeros(4 * hidden)
        gates[hidden : 2 * hidden] = 1.0  # forget little at first
        self.p = {
            "table": rng.normal(0, 0.3, (2, VOCABULARY, 4 * hidden)) + gates,  # a class's input to all gates
            "inner": rng.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)),
            "out": rng.normal(0, 0.3, (2, hidden, TAGS)), "bias": np.zeros(TAGS),
            "moves": np.zeros((TAGS, TAGS)), "starts": np.zeros(TAGS),
        }
        self.p = {k: v.astype(kind) for k, v in self.p.items()}

    # ------------------------------------------------------------------ forward

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        """(T, 2, B) classes: the second direction reads backwards."""
        return np.stack([x.T, x.T[::-1]], axis=1)

    def states(self, x: np.ndarray, keep: bool = False):
        n, (b, t) = self.hidden, x.shape
        seq, kind = self._inputs(x), self.p["inner"].dtype
        h, c = np.zeros((2, b, n), kind), np.zeros((2, b, n), kind)
        side = np.arange(2)[:, None]
        hs, held = np.empty((t, 2, b, n), kind), []
        for i in range(t):
            z = self.p["table"][side, seq[i]] + h @ self.p["inner"]
            s = _sigmoid(z[..., : 3 * n])
            g = np.tanh(z[..., 3 * n :])
            before, c = c, s[..., n : 2 * n] * c + s[..., :n] * g
            tc = np.tanh(c)
            if keep:
                held.append((s, g, before, tc, h))
            h = s[..., 2 * n :] * tc
            hs[i] = h
        return hs, held

    def scores(self, hs: np.ndarray) -> np.ndarray:
        """(B, T, tags)."""
        both = hs[:, 0] @ self.p["out"][0] + hs[::-1, 1] @ self.p["out"][1]
        return both.transpose(1, 0, 2) + self.p["bias"]

    def _moves(self) -> tuple[np.ndarray, np.ndarray]:
        starts = self.p["starts"].copy()
        starts[2::2] = NEVER
        return np.where(FORBIDDEN, self.p["moves"].dtype.type(NEVER), self.p["moves"]), starts

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tags, lead): the best tags, and how far each position's tag scores above outside."""
        e = self.scores(self.states(x)[0])
        moves, starts = self._moves()
        b, t, _ = e.shape
        best, back = starts + e[:, 0], np.zeros((t, b, TAGS), np.int8)
        for i in range(1, t):
            step = best[:, :, None] + moves
            back[i] = step.argmax(axis=1)
            best = step.max(axis=1) + e[:, i]
        tags = np.empty((b, t), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(b)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[i][rows, tags[:, i]]
        lead = np.take_along_axis(e, tags[:, :, None].astype(np.int64), 2)[:, :, 0] - e[:, :, OUTSIDE]
        return tags, lead

    # ------------------------------------------------------------------ training

    def loss(self, x: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a batch and its gradients."""
        hs, held = self.states(x, keep=True)
        e = self.scores(hs)
        (b, t, _), n = e.shape, self.hidden
        moves, starts = self._moves()
        alpha = np.empty_like(e)
        alpha[:, 0] = starts + e[:, 0]
        for i in range(1, t):
            alpha[:, i] = _log_sum(alpha[:, i - 1][:, :, None] + moves, 1) + e[:, i]
        total = _log_sum(alpha[:, -1], 1)
        beta = np.zeros_like(e)
        pairs = np.zeros((TAGS, TAGS), e.dtype)
        for i in range(t - 2, -1, -1):
            ahead = (e[:, i + 1] + beta[:, i + 1])[:, None, :]
            beta[:, i] = _log_sum(moves + ahead, 2)
            pairs += np.exp(alpha[:, i][:, :, None] + moves + ahead - total[:, None, None]).sum(axis=0)
        de = np.exp(alpha + beta - total[:, None, None])
        rows, cols = np.arange(b)[:, None], np.arange(t)[None, :]
        path = e[rows, cols, gold].sum(1) + starts[gold[:, 0]] + moves[gold[:, :-1], gold[:, 1:]].sum(1)
        de[rows, cols, gold] -= 1
        np.add.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1)
        de, pairs = de / b, pairs / b
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["moves"], g["starts"], g["bias"] = np.where(FORBIDDEN, 0, pairs), de[:, 0].sum(0), de.sum((0, 1))
        g["starts"][2::2] = 0
        d = de.transpose(1, 0, 2)  # (T, B, tags)
        g["out"][0] = np.einsum("tbn,tbk->nk", hs[:, 0], d)
        g["out"][1] = np.einsum("tbn,tbk->nk", hs[::-1, 1], d)
        above = np.stack([d @ self.p["out"][0].T, (d @ self.p["out"][1].T)[::-1]], axis=1)
        seq, dh, dc = self._inputs(x), np.zeros_like(hs[0]), np.zeros_like(hs[0])
        for i in range(t - 1, -1, -1):
            s, gate, before, tc, h = held[i]
            dh = dh + above[i]
            dc = dc + dh * s[..., 2 * n :] * (1 - tc * tc)
            raw = np.concatenate([dc * gate, dc * before, dh * tc], axis=-1) * s * (1 - s)
            dz = np.concatenate([raw, dc * s[..., :n] * (1 - gate * gate)], axis=-1)
            for side in (0, 1):
                np.add.at(g["table"][side], seq[i, side], dz[side])
            g["inner"] += h.transpose(0, 2, 1) @ dz
            dh = dz @ self.p["inner"].transpose(0, 2, 1)
            dc = dc * s[..., n : 2 * n]
        return float((total - path).mean()), g

    def fit(self, x: np.ndarray, gold: np.ndarray, *, rounds: int = 6, batch: int = 16, rate: float = 0.02, seed: int = 0) -> list[float]:
        rng, losses, t = np.random.default_rng(seed), [], 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for r in range(rounds):
            seen = 0.0
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                some = order[s : s + batch]
                value, g = self.loss(x[some], gold[some])
                seen, t = seen + value * len(some), t + 1
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / (size + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    step = rate * (0.7**r) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                    self.p[k] = (self.p[k] - step).astype(v.dtype)
            losses.append(seen / max(1, len(x)))
        return losses

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tagger:
        held = np.load(io.BytesIO(data), allow_pickle=False)
        own = cls(hidden=held["inner"].shape[1])
        own.p = {k: held[k] for k in cls.SHAPES}
        return own
