"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased and cut into runs of 3 to 5 code points (spaces and line ends included), each hashed
to one of ``2**20`` features. A feature counts once per text. Its value is the log ratio of its smoothed
shares in toxic and clean labelled texts (features seen in fewer than ``LEAST`` texts, or with a ratio near
zero, count nothing), and a logistic regression over these values is fitted by Adam.
The fit takes a bounded sample of labelled rows (``FIT_ROWS``, texts up to ``FIT_BYTES``), the lowest hashes of
ids of both classes alike, so the classes keep their natural ratio at every size of the table. Every row of the
sample is also scored by a fit on the other folds, and the intercept is moved so that at ``THRESHOLD`` these
scores miss few toxic texts while at most ``CLEAN_LOSS`` of the clean ones are taken for toxic.
Every row of the table is scored, whole, in one Arrow stage without a shuffle.

Defined cases: a null or empty text has no n-grams and gets the prior's score; a text shorter than three
code points likewise; repeated rows get equal scores; several labels of one id count as toxic if one is;
null ids or labels are no examples; with examples of one class only, or none, every score is their share
of toxic ones (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import blocks, pick, with_field

ORDERS = (3, 4, 5)
FEATURES = 1 << 20
#: Bounds of the sample that the classifier is fitted on.
FIT_ROWS, FIT_BYTES = 4000, 16384
#: Features need so many labelled texts, and so large a log ratio.
LEAST, RATIO = 4, 1.0
#: Folds of the calibration, the most clean texts that may be taken for toxic, and what one weighs against a missed toxic one.
FOLDS, CLEAN_LOSS, CLEAN_WEIGHT = 3, 0.03, 2.0
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(text: str, seen: np.ndarray) -> np.ndarray:
    """Distinct features of a text. ``seen`` is scratch memory of one number per feature."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    chars = (chars + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    run, found = chars, []
    for n in range(2, ORDERS[-1] + 1):
        if len(run) < 2:
            break
        run = run[:-1] * np.uint64(0xD6E8FEB86659FD93) + chars[n - 1 :]
        if n >= ORDERS[0]:
            found.append((run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44))
    if not found:
        return np.zeros(0, np.int64)
    every = np.concatenate(found).astype(np.int64)
    at = np.arange(len(every), dtype=np.int32)
    seen[every] = at  # the last of equal features stays
    return every[seen[every] == at]


class Model:
    """``prior + sum of weights`` over the distinct features, through a logistic curve."""

    def __init__(self, prior: float, weights: np.ndarray):
        self.prior, self.weights = prior, weights

    def logit(self, found: np.ndarray) -> float:
        return self.prior + float(self.weights[found].sum(dtype=np.float64))

    def score(self, text: str | None, seen: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(grams(text or "", seen)), -60, 60))))


def fit(texts: list[str | None], toxic: np.ndarray, **options) -> Model:
    """Fit on labelled texts, in numpy, with the intercept calibrated on folds left out."""
    toxic, seen = np.asarray(toxic, bool), np.zeros(FEATURES, np.int32)
    held = [grams(t or "", seen).astype(np.int32) for t in texts]
    model = _fit(held, toxic, **options)
    if toxic.sum() < FOLDS or (~toxic).sum() < FOLDS:
        return model
    fold = np.empty(len(held), np.int64)
    for side in (toxic, ~toxic):
        fold[side] = np.arange(side.sum()) % FOLDS
    z = np.empty(len(held))
    for f in range(FOLDS):
        inside = np.nonzero(fold != f)[0]
        other = _fit([held[i] for i in inside], toxic[inside], **options)
        for i in np.nonzero(fold == f)[0]:
            z[i] = other.logit(held[i])
    model.prior += np.log(THRESHOLD / (1 - THRESHOLD)) - border(z, toxic)
    return model


def border(z: np.ndarray, toxic: np.ndarray) -> float:
    """The logit from which a text is called toxic: few toxic ones missed, at most ``CLEAN_LOSS`` of the clean ones hit."""
    order = np.argsort(-z, kind="stable")
    ordered, bad = z[order], toxic[order]
    caught = np.concatenate([[0], np.cumsum(bad)]) / toxic.sum()
    lost = np.concatenate([[0], np.cumsum(~bad)]) / (~toxic).sum()
    cut = np.concatenate([[True], ordered[1:] < ordered[:-1], [True]]) & (lost <= CLEAN_LOSS)  # equal scores stay together
    cost = np.where(cut, 1 - caught + CLEAN_WEIGHT * lost, np.inf)
    n = int(cost.argmin())  # so many texts are called toxic
    above = ordered[n - 1] if n else ordered[0] + 2.0
    below = ordered[n] if n < len(ordered) else ordered[-1] - 2.0
    room = (above - below) / 4  # of the borders between the two, the one nearest to where the fit has it
    return float(np.clip(np.log(THRESHOLD / (1 - THRESHOLD)), below + room, above - room))


def _fit(held: list[np.ndarray], toxic: np.ndarray, *, steps: int = 60, rate: float = 0.05, l2: float = 1e-4) -> Model:
    weights = np.zeros(FEATURES, np.float32)
    if not len(toxic) or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return Model(-60.0 if share == 0 else 60.0, weights)
    sizes = np.array([len(h) for h in held])
    ids, row = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.int32), sizes)
    each = np.bincount(ids, minlength=FEATURES)
    bad = np.bincount(ids[toxic[row]], minlength=FEATURES)
    ratio = np.log((bad + 1) / (toxic.sum() + 2)) - np.log((each - bad + 1) / ((~toxic).sum() + 2))
    keep = (each >= max(1, min(LEAST, len(held) // 4))) & (np.abs(ratio) >= RATIO)
    place = (np.cumsum(keep) - 1).astype(np.int32)
    stay = keep[ids]
    row, ids = row[stay], place[ids[stay]]
    used, ratio = np.nonzero(keep)[0], ratio[keep]
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, (w * ratio)[ids], minlength=len(held)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - toxic) / len(held)
        g = np.bincount(ids, error[row], minlength=len(used)) * ratio + l2 * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    weights[used] = w * ratio
    return Model(float(b), weights)


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``rows`` labelled documents, the lowest hashes of ids whatever their class."""
    marked = pick(labels, doc_id="doc_id", toxic="toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(allowed)
    marked = marked.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    fits = pick(docs, doc_id="doc_id", text="text").filter(F.octet_length("text") <= FIT_BYTES)
    ids = fits.select("doc_id").join(marked, "doc_id", "left_semi").distinct()
    few = marked.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return fits.join(F.broadcast(few), "doc_id")  # ``rows`` ids at most


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """Fit in one task, which reads the bounded sample alone, and bring the weights (4 MB) to the driver."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"])
        model = fit(group["text"].tolist(), group["toxic"].to_numpy(bool))
        return pd.DataFrame({"prior": [model.prior], "weights": [model.weights.tobytes()]})

    found = sample(docs, labels, allowed).orderBy("doc_id", "text").limit(FIT_ROWS).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(work, "prior double, weights binary").first()
    return Model(found.prior, np.frombuffer(found.weights, np.float32)) if found else fit([], np.array([]))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score of every whole ``text`` as a further column, which replaces one of that name."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input
    kept = docs.drop(column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = held.value, np.zeros(FEATURES, np.int32)
        for batch in blocks(batches, "text", 8 << 20):
            scores = [own.score(t, seen) for t in batch.column("text").to_pylist()]
            names = [*batch.schema.names, column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return kept.mapInArrow(work, with_field(kept.schema, column, "double"))
