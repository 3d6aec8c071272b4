"""Language ID: a linear-chain CRF labels the words of code-switched text, and a document takes its best label.

Words are runs of letters. The CRF (``chain``) is trained in numpy in one task, on a bounded sample of
documents with a known language, dealt evenly over the languages (``FIT_ROWS`` documents of at most
``FIT_BYTES`` bytes, lowest hashes of ids; the ``LANGUAGES`` most frequent languages). Training chains are
always ``FIT_WORDS`` words: runs of random length out of one language's documents after the other, so that
changes of language are learned and every language weighs the same at every size of the table. Lexicons
hold the words that the sample of a language repeats.
Every document is scored whole, in one Arrow stage without a shuffle: its words' label probabilities by
forward-backward are averaged; the largest share names the language and is the score.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every text when nothing
could be learned; ties go to the first name; a null id is not held out; rows repeated in the sample count
once; an empty table gives none; other columns stay (``lang_pred`` and ``score`` replace those of that name).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.chain import Chain, Features, letters, marginals, spell, words_of
from citeloom.llm.common import blocks, pick

#: Bounds of the sample that the CRF is fitted on, and words of its training chains.
FIT_ROWS, FIT_BYTES, FIT_WORDS, LANGUAGES = 800, 16384, 1 << 17, 32
CHAIN, LONGEST_RUN, STEPS = 128, 96, 40
SPARE = 4
#: A lexicon holds words that a language's sample has at least so often.
REPEATED = 3
#: Bytes of text labelled at once.
STEP_BYTES = 4 << 20
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, names: list[str], chain: Chain):
        self.names, self.chain = names, chain


def fit(texts: list[str], langs: list[str], *, words: int = FIT_WORDS, steps: int = STEPS, seed: int = 11) -> Model:
    """Fit on labelled texts, in numpy."""
    names = sorted(set(langs))
    found, text, *_ = words_of(texts, letters())
    code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.array([names.index(x) for x in langs], np.int64)[text] if len(text) else np.zeros(0, np.int64)
    names_used = np.unique(of)
    names, of = [names[i] for i in names_used], np.searchsorted(names_used, of)
    model = Model(names, Chain(len(names)))
    if not names:
        return model
    rng, k = np.random.default_rng(seed), len(names)
    streams, place = [code[of == i] for i in range(k)], rng.integers(0, 1 << 30, k)
    parts, labels, have = [], [], 0
    while have < words:
        i, run = int(rng.integers(k)), int(np.exp(rng.uniform(np.log(2), np.log(LONGEST_RUN))))
        parts.append(streams[i][(place[i] + np.arange(run)) % len(streams[i])])
        labels.append(np.full(run, i))
        place[i] += run
        have += run
    code, label = np.concatenate(parts)[:words], np.concatenate(labels)[:words]
    chain = model.chain
    names_of = Features(*spell(found.dictionary)).names
    often = np.column_stack([np.bincount(s, minlength=len(names_of)) >= REPEATED for s in streams])
    listed = np.nonzero(often.any(axis=1))[0]
    order = np.argsort(names_of[listed])
    chain.lexicon, chain.member = names_of[listed][order], often[listed][order]
    chain.fit(pa.DictionaryArray.from_arrays(pa.array(code), found.dictionary), label, CHAIN, steps=steps)
    return model


def sample(docs: DataFrame, allowed: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> DataFrame:
    """(lang, doc_id, text) of at most ``rows`` documents, as many of each language."""
    fits = pick(docs, doc_id=doc_id, text=text, lang=docs[lang].cast("string")).filter(allowed)
    fits = fits.filter(F.col("lang").isNotNull() & (F.octet_length("text") <= FIT_BYTES)).withColumn("mark", F.xxhash64("text"))
    known = {r.lang: r["count"] for r in fits.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()}
    if not known:
        return fits.select("lang", "doc_id", "text").limit(0)
    most = max(1, rows // len(known))
    # Only hashes below a bound take part, about ``SPARE`` times as many as are wanted, so no task ranks all of a language.
    bound = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, SPARE * most / n))) for name, n in known.items()])
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "mark")
    ids = fits.select("lang", "doc_id", "mark", F.xxhash64("doc_id").alias("h")).filter((F.col("h") / F.lit(2.0**64) + 0.5) <= bound)
    few = ids.distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place", "h")
    few = few.withColumnsRenamed({"lang": "_lang", "doc_id": "_id", "mark": "_mark"})
    same = fits["lang"].eqNullSafe(F.col("_lang")) & fits["doc_id"].eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    return fits.join(F.broadcast(few), same, "left_semi").dropDuplicates(["lang", "doc_id", "mark"]).select("lang", "doc_id", "text")


def train(docs: DataFrame, allowed: Column, **options) -> Model:
    """Fit in one task, which reads the bounded sample alone, and bring the weights to the driver."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lang", "doc_id", "text"])
        model = fit(group["text"].tolist(), group["lang"].tolist())
        return pd.DataFrame({"names": [model.names], "chain": [model.chain.dump()]})

    one = sample(docs, allowed, **options).withColumn("all", F.lit(0))
    found = one.groupBy("all").applyInPandas(work, "names array<string>, chain binary").first()
    return Model(list(found.names), Chain.load(bytes(found.chain))) if found else fit([], [])


def shares(texts: list[str | None], model: Model, letter: np.ndarray):
    """(share, words, each, text, start, stop): mean label probabilities of texts, and those of their words."""
    found, text, start, stop = words_of(texts, letter)
    k = len(model.names)
    count = np.bincount(text, minlength=len(texts))
    if not k or not len(text):
        return np.zeros((len(texts), k)), count, np.zeros((0, k)), text, start, stop
    code = found.indices.to_numpy(zero_copy_only=False)
    score = model.chain.word_scores(found.dictionary)[code]
    each = marginals(score, model.chain.moves, model.chain.starts, np.concatenate([np.zeros(1, np.int64), np.cumsum(count)]))
    share = np.column_stack([np.bincount(text, each[:, j], minlength=len(texts)) for j in range(k)])
    return share / np.maximum(count, 1)[:, None], count, each, text, start, stop


def detect(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred`` and ``score`` of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # ``FEATURES`` x ``LANGUAGES`` weights at most
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, letter = held.value, letters()
        label = np.array([*own.names, UNKNOWN], object)
        for batch in blocks(batches, "__text", STEP_BYTES):
            share, count, *_ = shares(batch.column("__text").to_pylist(), own, letter)
            known = (count > 0) & bool(own.names)
            best = np.where(known, share.argmax(axis=1) if own.names else 0, len(own.names))
            score = np.where(known, np.clip(share.max(axis=1) if own.names else 0.0, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(label[best], pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(work, (fields + ", " if fields else "") + "lang_pred string, score double")


def label_runs(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, stop, lang, words): runs of words of one most probable language, in code points."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    named = pick(docs, doc_id=doc_id, text=text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, letter = held.value, letters()
        label = np.array(own.names, object)
        for batch in blocks(batches, "text", STEP_BYTES):
            _, _, each, of, start, stop = shares(batch.column("text").to_pylist(), own, letter)
            if not len(each):
                continue
            best = each.argmax(axis=1)
            new = np.ones(len(best), bool)
            new[1:] = (best[1:] != best[:-1]) | (of[1:] != of[:-1])
            at = np.nonzero(new)[0]
            end = np.append(at[1:], len(best)) - 1
            ids = batch.column("doc_id").take(pa.array(of[at]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(start[at]), pa.array(stop[end]), pa.array(label[best[at]], pa.string()), pa.array(end - at + 1)], names=["doc_id", "start", "stop", "lang", "words"]
            )

    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(work, f"doc_id {kind}, start long, stop long, lang string, words long")
