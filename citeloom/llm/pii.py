"""Personal data: fixed patterns, and further spans of a character tagger (``tagger``).

The patterns' spans always stay. The tagger is trained on windows of a bounded sample of documents
(``FIT_ROWS`` texts of at most ``FIT_BYTES`` bytes): the patterns' spans are its labels, and in half of the
windows one is rewritten into a form that the patterns miss (a phone number without ``+``, a card number
with dots, an address with ``(at)`` or ``[at]``) under the same label. Texts are cut into windows of
``WINDOW`` code points, half overlapping, so that every span of up to half a window lies whole in one.

A span of any kind holds a digit, ``@`` or a bracketed ``at``; windows without one hold no span, so they are
counted as decoded without running the network. Spans of all windows of a text are reconciled together: of
spans that overlap, the set with the largest sum of scores stays, and none may touch a pattern's span. A
span must also be what its kind demands (parts to 255, Luhn's sum, 9 to 15 digits, an ``@`` or ``at`` before a dot).

Offsets count code points. Everything runs in one Arrow stage after the fit, which is one task.

Defined cases: a null or empty text has no spans; texts of any length are cut into windows, of which a fixed
number is held at once; repeated rows get equal spans; a null id stays null; with no example the tagger adds
nothing; an empty table gives none; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import blocks, pick
from citeloom.llm.tagger import KINDS, Tagger, classes

WINDOW, STRIDE = 128, 64
#: Bounds of the fit: texts, bytes of one, training windows, spans of a text that give one each, and how far into a
#: text the other digits are looked for. They bound the sample alone; every text is decoded whole.
FIT_ROWS, FIT_BYTES, FIT_WINDOWS, FIT_SPANS, FIT_REACH = 1500, 8192, 1600, 4, 4096
#: Mean lead over "outside" that a tagger's span needs, and windows decoded together.
LEAD, TOGETHER = 0.0, 1024

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
AT = re.compile(r"\(at\)|\[at\]", re.I)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def good_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def good_card(s: str) -> bool:
    d = only_digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def good_phone(s: str) -> bool:
    return 9 <= len(only_digits(s)) <= 15


def emails(text: str) -> Iterator[Span]:
    """Each ``@`` with the longest run before it that no earlier match took."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind, then start."""
    out = list(emails(text))
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if good_ip(m.group())]
        out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and good_card(m.group())]
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if good_phone(m.group())]
    return out


def credible(kind: str, s: str) -> bool:
    if kind == "email":
        at = AT.search(s) or re.search("@", s)
        return bool(at and at.start() and "." in s[at.end() :]) and "\n" not in s
    if kind == "ip":
        return s.count(".") == 3 and all(p.isascii() and p.isdigit() for p in s.split(".")) and good_ip(s)
    if not re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", s):
        return False
    return good_card(s) if kind == "card" else good_phone(s) and len(only_digits(s)) < len(s)


# ---------------------------------------------------------------- training windows


def disguise(kind: str, s: str, rng: np.random.Generator) -> str:
    """The same datum in a form that the patterns miss."""
    d = only_digits(s)
    if kind == "email":
        return s.replace("@", str(rng.choice(["(at)", " (at) ", "[at]", " [at] "])))
    if kind == "card":
        return ".".join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == "phone":
        d = d[-10:]
        return str(rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"]))
    return s


def tagged_window(text: str, spans: list[Span], start: int, target: Span | None, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One window of a text with its tags; ``target`` is rewritten."""
    pieces, tags, at = [], [], start
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        word = text[a:b]
        if target == (kind, a, b):
            word = disguise(kind, word, rng)
        pieces += [text[at:a], word]
        k = 1 + 2 * KINDS.index(kind)
        tags += [0] * (a - at) + [k] + [k + 1] * (len(word) - 1)
        at = b
        if len(tags) >= WINDOW:
            break
    rest = text[at : at + WINDOW]
    whole, tags = "".join(pieces) + rest, tags + [0] * len(rest)
    codes = np.frombuffer(whole[:WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
    x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
    x[: len(codes)], y[: len(codes)] = classes(codes), tags[:WINDOW]
    return x, y


def examples(texts: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows around spans and around other digits, in a fixed order."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for text in texts:
        spans = base_spans(text)
        for span in spans[:FIT_SPANS]:
            start = max(0, span[1] - int(rng.integers(0, WINDOW - 48)))
            start = min([start, *(a for _, a, b in spans if a < start < b)])
            xy = tagged_window(text, spans, start, span if rng.random() < 0.5 else None, rng)
            xs.append(xy[0]), ys.append(xy[1])
        others = [m.start() for m in DIGIT.finditer(text[:FIT_REACH]) if not any(a <= m.start() < b for _, a, b in spans)]
        if others:
            start = max(0, int(rng.choice(others)) - int(rng.integers(0, WINDOW - 8)))
            start = min([start, *(a for _, a, b in spans if a < start < b)])
            xy = tagged_window(text, spans, start, None, rng)
            xs.append(xy[0]), ys.append(xy[1])
        if len(xs) >= FIT_WINDOWS:
            break
    return np.array(xs).reshape(-1, WINDOW), np.array(ys).reshape(-1, WINDOW)


def fit(texts: list[str], **how) -> Tagger | None:
    x, y = examples(texts)
    if not len(x) or not y.any():
        return None
    tagger = Tagger()
    tagger.fit(x, y, **how)
    return tagger


def train(docs: DataFrame) -> Tagger | None:
    """Fit in one task on the sampled documents, the lowest hashes of ids among those with a digit or ``@``."""
    fits = pick(docs, doc_id="doc_id", text="text").filter((F.octet_length("text") <= FIT_BYTES) & F.col("text").rlike(r"[@+]|[0-9]{2}") & F.col("doc_id").isNotNull())
    ids = fits.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"])
        tagger = fit(group["text"].tolist())
        return pd.DataFrame({"data": [tagger.dump() if tagger else b""]})

    found = fits.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").limit(2 * FIT_ROWS).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(work, "data binary").first()
    return Tagger.load(bytes(found.data)) if found and found.data else None


# ---------------------------------------------------------------- decoding


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, classes of each window) of the windows that can hold a span."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = ((codes >= 48) & (codes < 58)) | (codes == 64)
    for m in AT.finditer(text) if "at" in text.lower() else ():
        marks[m.start()] = True
    places = np.nonzero(marks)[0]
    if not len(places):
        return np.zeros(0, np.int64), np.zeros((0, WINDOW), np.int64)
    last = max(0, -(-(len(codes) - WINDOW) // STRIDE))
    own = np.unique(np.concatenate([np.minimum(places // STRIDE, last), np.clip(places // STRIDE - 1, 0, last)]))
    starts = own * STRIDE
    padded = np.concatenate([classes(codes), np.zeros(WINDOW, np.int64)])
    return starts, padded[starts[:, None] + np.arange(WINDOW)]


def proposals(tags: np.ndarray, lead: np.ndarray, start: int, size: int) -> Iterator[tuple[str, int, int, float]]:
    """Spans of one decoded window; those cut by an inner border of a window are left to its neighbour."""
    i, n = 0, min(len(tags), size - start)
    while i < n:
        if tags[i] == 0:
            i += 1
            continue
        j = i + 1
        while j < n and tags[j] == tags[i] + 1 and tags[i] % 2:
            j += 1
        if (i > 0 or start == 0) and (j < len(tags) or start + j == size) and tags[i] % 2:
            yield KINDS[(tags[i] - 1) // 2], start + i, start + j, float(lead[i:j].mean())
        i = j


def reconcile(found: list[tuple[str, int, int, float]], fixed: list[Span]) -> list[Span]:
    """The non-overlapping spans with the largest sum of scores that touch no fixed span."""
    taken = sorted((a, b) for _, a, b in fixed)
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else np.array([])
    best: dict[tuple[str, int, int], float] = {}
    for kind, a, b, score in found:
        i = int(np.searchsorted(starts, b))
        if score >= LEAD and not (i and ends[i - 1] > a):
            best[kind, a, b] = max(score, best.get((kind, a, b), score))
    items = sorted(best.items(), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    stops, total, choice = [s[2] for s, _ in items], [0.0], []
    for i, ((_, a, _b), score) in enumerate(items):
        before = int(np.searchsorted(stops[:i], a, side="right"))
        with_it = total[before] + score + 1  # more spans before fewer
        choice.append((with_it > total[-1], before))
        total.append(max(total[-1], with_it))
    out, i = [], len(items)
    while i:
        use, before = choice[i - 1]
        if use:
            out.append(items[i - 1][0])
        i = before if use else i - 1
    return out


def find(texts: list[str | None], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, further spans) of each text."""
    fixed = [base_spans(t) if t else [] for t in texts]
    found: list[list] = [[] for _ in texts]
    queue: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        tags, lead = tagger.decode(np.stack([w for *_, w in queue]))
        for (t, start, _), row, up in zip(queue, tags, lead, strict=True):
            if row.any():
                found[t] += [p for p in proposals(row, up, start, len(texts[t])) if credible(p[0], texts[t][p[1] : p[2]])]
        queue.clear()

    for t, text in enumerate(texts):
        if tagger is None or not text:
            continue
        for start, own in zip(*windows(text), strict=True):
            queue.append((t, int(start), own))
            if len(queue) == TOGETHER:
                flush()
    if queue:
        flush()
    return [(base, reconcile(more, base)) for base, more in zip(fixed, found, strict=True)]


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1])))


def detect(docs: DataFrame, tagger: Tagger | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans): counts and spans of every row.

    Counts are those of the patterns; ``spans`` holds theirs and the tagger's.
    """
    held = docs.sparkSession.sparkContext.broadcast(tagger.dump() if tagger else b"")  # some kB
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger.load(held.value) if held.value else None
        for batch in blocks(batches, "text", 8 << 20):
            found = find(batch.column("text").to_pylist(), own)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            base, every = (pa.array([joined(f(*x)) for x in found], pa.string()) for f in (lambda b, m: b, lambda b, m: b + m))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, base, every], names)

    source = pick(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    return source.mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


