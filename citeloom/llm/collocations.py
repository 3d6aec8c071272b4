"""Phrase collocations by dynamic itemset counting.

Texts are cut into pieces and words; a phrase is a run of words inside a piece. The documents are dealt once
into ``SHARDS`` shards, and steps scan one shard after the other, round and round. All words are counted in
the first round. A longer phrase is active from the step after both its parts (without the last and without
the first word) have reached ``LEAST`` so far, and stays so for one full cycle; lengths are mixed in every
scan. The run ends when no part became frequent in a whole cycle, so each phrase that can reach ``LEAST``
has met every shard. A phrase keeps its count and which shards are in it, so that a shard counted again by
chance is not added twice and totals are exact.

Inside a block phrases are told apart by their words; between blocks by two 64-bit hashes of language and
words, so that a count is two words and a number. A count also carries its home: one of the places (what one
task dealt to one shard) that hold the phrase. A last scan spells each frequent phrase out at its home only.
Scans learn what is active from two bit fields of ``BITS`` bits each (parts that are frequent, and those that
became so within the last cycle), built by tasks and broadcast: their size is fixed. Bits of other phrases
may be set by chance; then a phrase is counted that need not be, which changes no total. Counts are added up
by block, by task and then by phrase, so a very common phrase sends one row a task.
The table of counts is written at every step; phrases that are not frequent leave it when they were not seen
for a cycle, and the tables of earlier steps are deleted.

Defined cases: null and empty texts have no words; a null language is ``und`` (together with rows of that
name); repeated rows count as often as they stand there; an empty table gives none; other columns never
take part.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import Prefix, blocks, checkpoint_root, forget, mix, pick, text_bytes

LONGEST, LEAST, SHARDS, TOP, PERCENT = 5, 100, 2, 2000, 100
BITS = 1 << 24
#: Bits of a field that tells which phrases are spelled out where, for each bit of the others.
HOME_BITS = 4
#: Bytes of text counted at once.
STEP_BYTES = 2 << 20
#: Counts that a task adds up before they leave it.
HELD_COUNTS = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
OUTSIDE = BREAK.copy()
OUTSIDE[[9, 32]] = True
STEPS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: What a home is multiplied by (products of 31 bits by 31 bits), for each of the two bits of a phrase at its home.
HOME_STEPS = (0x5BD1E995, 0x27D4EB2F)
#: Second coefficients of bytes, so that the two hashes of a word differ in kind.
SECOND = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(words, text, piece): all words in order, and which text and piece each stands in."""
    raw = LOWER[raw]
    inside = ~OUTSIDE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.nonzero(first)[0]
    size = np.nonzero(last)[0] + 1 - start
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    piece = np.cumsum(BREAK[raw])[start] + text
    return flat.dictionary_encode(), text, piece


def word_names(words: pa.Array) -> np.ndarray:
    """(2, words): two hashes of each word."""
    raw, offsets = text_bytes(pa.record_batch([words], ["w"]), "w")
    return np.stack([Prefix(x).runs(offsets[:-1], offsets[1:]) for x in (raw, SECOND[raw])])


def language_names(names: list[str]) -> np.ndarray:
    """(2, languages)."""
    both = [hashlib.blake2b(n.encode(), digest_size=16).digest() for n in names]
    return np.frombuffer(b"".join(both), np.uint64).reshape(-1, 2).T


def extend(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Names of phrases from those of all but their last word (of their language, for one word) and that word's."""
    return mix(before * STEPS[:, None] + word)


def sized(name: np.ndarray, k: int) -> np.ndarray:
    """The pair that names a phrase of ``k`` words: the second hash carries ``k`` in its last three bits."""
    return np.stack([name[0], (name[1] & ~np.uint64(7)) | np.uint64(k)]).view(np.int64)


class Active:
    """Two bit fields: frequent phrases, and those that became frequent within the last cycle."""

    def __init__(self, fields: np.ndarray):
        self.fields = fields

    def holds(self, which: int, name: np.ndarray) -> np.ndarray:
        h = name[0] & np.uint64(64 * self.fields.shape[1] - 1)
        return (self.fields[which][(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def spelled_at(field: np.ndarray, pair: np.ndarray, home: int) -> np.ndarray:
    """Which of the phrases have both bits of this home in the field (others may have them by chance)."""
    out = np.ones(pair.shape[1], bool)
    for h, step in zip((pair[0], pair[1] >> 3), HOME_STEPS):
        h = (h ^ (home * step)) & (64 * len(field) - 1)
        out &= (field[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return out


def by_home(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of texts of one home, with it."""
    for batch in blocks(batches, "text", STEP_BYTES):
        home = batch.column("home").to_numpy()
        for start, stop in itertools.pairwise([0, *np.nonzero(np.diff(home))[0] + 1, len(home)]):
            yield int(home[start]), batch.slice(start, stop - start)


def levels(batch: pa.RecordBatch, active: Active | None, longest: int):
    """``k, langs, of, words, parts, name, code, recent`` for each phrase length met in a block of texts.

    ``of`` and ``parts`` give the language and the words of the distinct phrases, ``name`` their hashes, ``code``
    the phrase at each occurrence, and ``recent`` which occurrences have a part that is newly frequent.
    """
    raw, offsets = text_bytes(batch, "text")
    words, text, piece = words_of(raw, offsets)
    if not len(words):
        return
    langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
    word, distinct = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    d = len(distinct)
    plain, start = word_names(distinct), language_names(langs.dictionary.to_pylist())
    code, own = pd.factorize(lang * d + word)
    of, parts = own // d, (own % d)[:, None]
    name = extend(start[:, of], plain[:, parts[:, 0]])
    yield 0, langs.dictionary, np.arange(start.shape[1]), distinct, np.zeros((start.shape[1], 0), np.int64), start, lang, None
    yield 1, langs.dictionary, of, distinct, parts, name, code, None
    if active is None:
        return
    frequent, recent = active.holds(0, name)[code], active.holds(1, name)[code]
    for k in range(2, longest + 1):
        both = frequent[:-1] & frequent[1:]
        if k == 2:
            both &= piece[:-1] == piece[1:]
        at = np.nonzero(both)[0]
        if not len(at):
            return
        fresh, own = pd.factorize(code[at] * d + word[at + k - 1])
        before, last = own // d, own % d
        of, parts, name = of[before], np.column_stack([parts[before], last]), extend(name[:, before], plain[:, last])
        yield k, langs.dictionary, of, distinct, parts, name, fresh, recent[at] | recent[at + 1]
        code = np.full(len(word), -1, np.int64)
        code[at] = fresh
        frequent, recent = np.zeros(len(word), bool), np.zeros(len(word), bool)
        frequent[at], recent[at] = active.holds(0, name)[fresh], active.holds(1, name)[fresh]


def added(parts: list[np.ndarray]) -> pa.RecordBatch:
    """(a, b, c, home) with the counts of equal names added up (those of equal ``a`` that differ in ``b`` stay apart)."""
    rows = np.hstack(parts)
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    at = np.nonzero(new)[0]
    sums = np.add.reduceat(rows[2], at) if len(at) else rows[2]
    return pa.RecordBatch.from_arrays([*map(pa.array, (rows[0, at], rows[1, at], sums, rows[3, at]))], names=["a", "b", "c", "home"])


def scan(shard: DataFrame, active: Active | None, every_word: bool, longest: int) -> DataFrame:
    """(a, b, c, home) of one shard, several rows a phrase: words (and all words of a language) if asked for, and active phrases."""
    held = shard.sparkSession.sparkContext.broadcast(active)  # two fields of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for home, batch in by_home(batches):
            for k, _, of, _, _, name, code, recent in levels(batch, held.value, longest):
                if k < 2 and not every_word:
                    continue
                counts = np.bincount(code if recent is None else code[recent], minlength=len(of))
                some = np.nonzero(counts)[0]
                parts.append(np.vstack([sized(name[:, some], k), counts[some], np.full(len(some), home)]))
                size += len(some)
            if size > HELD_COUNTS:
                yield added(parts)
                parts, size = [], 0
        if parts:
            yield added(parts)

    return shard.select("lang", "text", "home").mapInArrow(work, "a long, b long, c long, home long")


def spellings(texts: DataFrame, known: Active, homes: np.ndarray, longest: int) -> DataFrame:
    """(a, b, lang, phrase): the texts of all phrases that ``homes`` has, each from its home (several rows, if tasks share that).

    ``known`` holds the frequent phrases, which lead from a phrase to longer ones.
    """
    held = texts.sparkSession.sparkContext.broadcast((known, homes))  # fields of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, np.uint64)  # first hashes of what this task has spelled out, as far as they are held
        known, homes = held.value
        for home, batch in by_home(batches):
            fresh = [np.zeros(0, np.uint64)]
            for k, langs, of, words, parts, name, _, _ in levels(batch, known, longest):
                some = np.nonzero(spelled_at(homes, sized(name, k), home))[0]
                if len(sent):
                    at = np.minimum(np.searchsorted(sent, name[0, some] ^ name[1, some]), len(sent) - 1)
                    some = some[sent[at] != name[0, some] ^ name[1, some]]
                if not len(some):
                    continue
                fresh.append(name[0, some] ^ name[1, some])
                texts = [words.take(pa.array(parts[some, j])) for j in range(k)]
                joined = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.large_binary())) if texts else pa.array([b""] * len(some))
                named = [langs.take(pa.array(of[some])).cast(pa.string()), joined.cast(pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*map(pa.array, sized(name[:, some], k)), *named], names=["a", "b", "lang", "phrase"])
            if len(sent) <= HELD_COUNTS:
                sent = np.union1d(sent, np.concatenate(fresh))

    return texts.select("lang", "text", "home").mapInArrow(work, "a long, b long, lang string, phrase string")


def bit_fields(table: DataFrame, since: int, longest: int, bits: int) -> np.ndarray:
    """The two fields of the frequent phrases of up to ``longest`` words; those are new whose ``since`` (from 1) is not less than the given one."""
    k = F.col("b").bitwiseAND(F.lit(7))
    h = F.col("a").bitwiseAND(F.lit(bits - 1))
    parts = table.filter((F.col("since") > 0) & k.between(1, longest)).select(F.shiftright(h, 6).alias("slot"), _bit(h).alias("bit"), (F.col("since") >= since).alias("new"))
    each = parts.groupBy("slot").agg(F.bit_or("bit").alias("all"), F.bit_or(F.when(F.col("new"), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("new")).toArrow()
    out = np.zeros((2, bits // 64), np.uint64)
    slot = each.column("slot").to_numpy()  # bits / 64 rows at most
    for i, c in enumerate(("all", "new")):
        out[i, slot] = each.column(c).to_numpy().view(np.uint64)
    return out


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def home_field(final: DataFrame, bits: int) -> np.ndarray:
    """The field of :func:`spelled_at`: two bits of each phrase ``a, b`` at its ``home``."""
    hashes = [h.bitwiseXOR(F.col("home") * F.lit(step)).bitwiseAND(F.lit(bits - 1)) for h, step in zip((F.col("a"), F.shiftright("b", 3)), HOME_STEPS)]
    each = final.select(F.explode(F.array(*hashes)).alias("h")).select(F.shiftright("h", 6).alias("slot"), _bit(F.col("h")).alias("bit"))
    each = each.groupBy("slot").agg(F.bit_or("bit").alias("all")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[each.column("slot").to_numpy()] = each.column("all").to_numpy().view(np.uint64)  # bits / 64 rows at most
    return out


def phrase_counts(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """(lang, phrase, k, f): exact counts of all phrases of 1 to ``longest`` words with at least ``least``; ``k`` 0 counts all words.

    ``bits`` is a power of two, 64 at least; ``longest`` is 7 at most, ``shards`` 8.
    """
    spark = docs.sparkSession
    root = f"{checkpoint_root(spark)}/phrases-{uuid.uuid4().hex}"
    dealt = pick(docs, text=text, lang=F.coalesce(docs[lang].cast("string"), F.lit("und"))).filter("text IS NOT NULL")
    dealt = dealt.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int"))
    dealt = dealt.withColumn("home", F.spark_partition_id().cast("long") * shards + F.col("shard"))
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(f"{root}/texts")
    texts = spark.read.schema("text string, lang string, home long, shard int").parquet(f"{root}/texts")
    # A phrase's state is its count, its home and one number: since when it is frequent (0: not yet), the last step that met it, the shards counted.
    since, seen, met = (F.shiftright("info", 32), F.shiftright("info", 8).bitwiseAND(F.lit(0xFFFFFF)), F.col("info").bitwiseAND(F.lit(0xFF)))
    is_total = F.col("b").bitwiseAND(F.lit(7)) == 0
    state = spark.createDataFrame([], "a long, b long, f long, info long, home long")
    for step in itertools.count():
        fields = bit_fields(state.withColumn("since", since), step - shards + 1, longest - 1, bits) if step else None
        if step >= shards and not fields[1].any():
            break
        scanned = scan(texts.filter(F.col("shard") == step % shards), None if fields is None else Active(fields), step < shards, longest)
        none = F.lit(None).cast("long")
        rows = scanned.select("a", "b", "c", none.alias("f"), none.alias("info"), "home").unionByName(state.select("a", "b", none.alias("c"), "f", "info", "home"))
        merged = rows.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("f").alias("f"), F.coalesce(F.max("info"), F.lit(0)).alias("info"), F.min("home").alias("home"))
        bit = 1 << step % shards
        fresh = F.when(met.bitwiseAND(F.lit(bit)) == 0, F.coalesce("c", F.lit(0))).otherwise(0)  # a shard counts once
        merged = merged.select(
            "a", "b", (F.coalesce("f", F.lit(0)) + fresh).alias("f"), since.alias("since"), F.when(F.col("c").isNotNull(), step).otherwise(seen).alias("seen"),
            F.when(F.col("c").isNotNull(), met.bitwiseOR(F.lit(bit))).otherwise(met).alias("met"), "home",
        )
        merged = merged.withColumn("since", F.when((F.col("f") >= least) & (F.col("since") == 0), step + 1).otherwise(F.col("since")))
        merged = merged.filter((F.col("since") > 0) | is_total | (F.col("seen") > step - shards))
        info = F.expr("shiftleft(since, 32)").bitwiseOR(F.expr("shiftleft(seen, 8)")).bitwiseOR(F.col("met"))
        state = _written(merged.select("a", "b", "f", info.cast("long").alias("info"), "home"), f"{root}/step-{step}")
        forget(spark, f"{root}/step-{step - 1}")
    state = state.withColumn("since", since)
    final = state.filter((F.col("since") > 0) | is_total).select("a", "b", F.col("b").bitwiseAND(F.lit(7)).cast("int").alias("k"), "f", "home")
    named = spellings(texts, Active(bit_fields(state, 0, longest, bits)), home_field(final, HOME_BITS * bits), longest)
    named = named.groupBy("a", "b").agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase"))
    out = _written(final.join(named, ["a", "b"]).select("lang", "phrase", "k", "f"), f"{root}/phrases")
    for name in ("texts", f"step-{step - 1}"):
        forget(spark, f"{root}/{name}")
    return out


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _run(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(counts: DataFrame, *, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """Each language's ``top`` phrases by their weakest cut: (lang, rank, phrase, a, l, r, n, score, cut)."""
    known = counts.filter("k > 0").select("lang", "phrase", "f")
    phrases = counts.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    sizes = F.explode(F.sequence(F.lit(2), F.col("k") - 1))
    inner = phrases.filter("k > 2").select("lang", "a", "k", "w", sizes.alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("i"))
    inside = inner.select("lang", _run(F.col("w"), F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")
    cuts = kept.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _run(F.col("w"), 1, F.col("cut")).alias("first"), _run(F.col("w"), F.col("cut") + 1, F.col("k")).alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    total = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(total, "lang")
    whole = "decimal(20,0)"
    score = F.expr(f"(1000 * CAST(a AS {whole}) * CAST(n AS {whole})) div (CAST(l AS {whole}) * CAST(r AS {whole}))")
    best = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.col("b.score").desc(), F.col("a").desc(), "phrase"))
    # The best of each of 64 parts of a language first, so that the last task of a language has 64 x top rows at most.
    near = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", place("part")).filter(F.col("rank") <= top).drop("part")
    ranked = near.withColumn("rank", place()).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score", "b.cut")


SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS r(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 5) AS s(m), range(1, 5) AS o(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS first, array_to_string(w[cut + 1 : k], ' ') AS rest FROM kept, range(1, 5) AS u(cut) WHERE cut < k),
scored AS (SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM cuts
    JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.first JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.rest JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored) WHERE o = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM top WHERE rank <= 2000"""
