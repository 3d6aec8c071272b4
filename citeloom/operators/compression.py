"""Extractive compression of context packages and the invariants it must keep."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators.packages import HEADER, PackagePolicy, evidence_block, package_id, render

# Abbreviations that do not end a sentence, and bullet marks.
ABBREVIATIONS = (
    "e.g.", "i.e.", "etc.", "dr.", "mr.", "mrs.", "ms.", "prof.", "vs.", "fig.", "al.", "no.", "vol.", "p.", "pp.",
)
_BULLET = r"^(\s*[-*\x{2022}]\s+|\s*\d+[.)]\s+)"
_LINE_END = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
_LINE = rf"[^{_LINE_END}]*+(?:\r\n|[{_LINE_END}])|[^{_LINE_END}]++"
# A word that ends a sentence: not an abbreviation, a single letter or a number before its full stop.
_KEPT = "|".join(re.escape(a) for a in ABBREVIATIONS)
_BREAK = (
    rf"(?<![^{tx.SPACE}])(?!(?i:{_KEPT}|[a-z]\.)[{tx.SPACE}])([^{tx.SPACE}]*[.?!][\"']?)(?<!\d\.)([{tx.SPACE}]+)(?=[A-Z0-9\"'])"
)
_SEP, _END = "\x05", "\x06"  # between a sentence and what separates it, and after that
_ESCAPE = "\x07"  # with a letter, stands for a mark (or itself) in the text


@dataclass(frozen=True)
class CompressionPolicy:
    target_chars: int | None = None
    target_tokens: int | None = None
    max_sentences: int = 3
    deduplicate: bool = False
    allow_drop: bool = False

    def __post_init__(self) -> None:
        if self.target_chars is None and self.target_tokens is None:
            raise ValueError("at least one target is required")
        if not 1 <= self.max_sentences <= 8:
            raise ValueError("max_sentences must be within 1 to 8")


# ---------------------------------------------------------------- sentence boundaries


def _entry(text: Column, sep: Column) -> Column:
    return F.struct(text.alias("text"), sep.alias("sep"))


def _free(text: Column) -> Column:
    """The text without the marks; ``_own`` brings back those it holds itself."""
    for mark, code in ((_ESCAPE, "a"), (_SEP, "b"), (_END, "c")):
        text = F.replace(text, F.lit(mark), F.lit(_ESCAPE + code))
    return text


def _own(text: Column) -> Column:
    for mark, code in ((_END, "c"), (_SEP, "b"), (_ESCAPE, "a")):
        text = F.replace(text, F.lit(_ESCAPE + code), F.lit(mark))
    return text


def _of_sentences(body: Column) -> Column:
    """Sentences of running text: every break is marked by one expression, then the text is split there."""
    pieces = F.split(F.regexp_replace(_free(body), _BREAK, f"$1{_SEP}$2{_END}"), _END, -1)
    return F.transform(pieces, lambda p: _entry(_own(F.substring_index(p, _SEP, 1)), F.regexp_extract(p, f"(?s){_SEP}(.*)$", 1)))


def _of_bullets(lines: Column) -> Column:
    """Items of a list: a line with a bullet starts one, other lines go on with it."""
    marked = F.transform(lines, lambda line, i: F.concat(F.when((i > 0) & line.rlike(_BULLET), _END).otherwise(""), _free(line)))
    text, end = lambda t: F.regexp_replace(t, r"\r?\n\z", ""), lambda t: F.regexp_extract(t, r"(\r?\n)\z", 1)
    between = lambda t, i, items: F.when((end(t) == "") & (i < F.size(items) - 1), "\n").otherwise(end(t))
    return tx.let(F.transform(F.split(F.array_join(marked, ""), _END, -1), _own), lambda items: F.transform(items, lambda t, i: _entry(text(t), between(t, i, items))))


# The same patterns for Python, whose white space is tx.SPACE; a word is looked at only where a sentence may end.
_GAP = re.compile("\n\n+")
_ITEM = re.compile("[ \\t-\\r]*(?:[-*\u2022]|[0-9]+[.)])[ \\t-\\r]")
_STOP = re.compile(r"([.?!][\"']?)(?<![0-9]\.)(\s++)(?=[A-Z0-9\"'])")


def _is_kept(body: str, end: int) -> bool:
    """Whether the word before ``end`` is an abbreviation or a single letter with its full stop."""
    word = body[max(0, end - 6) : end].split()[-1]
    return word.isascii() and (word.lower() in ABBREVIATIONS or (len(word) == 2 and word[0].isalpha()))


def cut_sentences(text: str) -> list[tuple[str, str]]:
    """``(text, sep)`` of every sentence or list item of a text; see :func:`boundaries`."""
    found: list[tuple[str, str]] = []
    gaps = _GAP.findall(text)
    for block, gap in zip(_GAP.split(text), [*gaps, ""]):
        body = block.strip()
        if not body:
            continue
        lines = body.splitlines(True)
        starts = [i for i, line in enumerate(lines) if _ITEM.match(line)] if len(lines) > 1 else []
        if starts:  # a line with a bullet starts an item, other lines go on with it
            edges = [0, *(i for i in starts if i), len(lines)]
            for i, j in zip(edges, edges[1:]):
                item = "".join(lines[i:j])
                end = "\r\n" if item.endswith("\r\n") else "\n" if item.endswith("\n") else ""
                found.append((item[: len(item) - len(end)], end or ("\n" if j < len(lines) else "")))
        else:
            start = 0
            for m in _STOP.finditer(body):
                end = m.end(1)
                if m[1] != "." or not _is_kept(body, end):
                    found.append((body[start:end], m[2]))
                    start = m.end()
            found.append((body[start:], ""))
        if gap:
            found[-1] = (found[-1][0], gap)
    return found


def boundaries(text: Column) -> Column:
    """``(text, sep)`` of every sentence or list item, with what separates it from the next one; a text is cut in one go.

    A function over Arrow data, so not for use inside a lambda: there :func:`boundaries_in_row` gives the same.
    """

    @F.arrow_udf("array<struct<text:string,sep:string>>")
    def cut(texts: pa.Array) -> pa.Array:
        pieces, ends = [], [0]
        for one in texts.to_pylist():
            pieces += cut_sentences(one or "")
            ends.append(len(pieces))
        whole, seps = zip(*pieces) if pieces else ((), ())
        pairs = pa.StructArray.from_arrays([pa.array(whole, pa.string()), pa.array(seps, pa.string())], names=["text", "sep"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    return cut(text)


def boundaries_in_row(text: Column) -> Column:
    """:func:`boundaries` as an expression."""
    source = F.coalesce(text, F.lit(""))
    blocks, gaps = F.split(source, "\n\n+", -1), F.regexp_extract_all(source, F.lit("\n\n+"), F.lit(0))

    def units(body: Column) -> Column:
        listed = lambda lines: (F.size(lines) > 1) & F.exists(lines, lambda line: line.rlike(_BULLET))
        return tx.let(F.regexp_extract_all(body, F.lit(_LINE), F.lit(0)), lambda lines: F.when(listed(lines), _of_bullets(lines)).otherwise(_of_sentences(body)))

    def closed(found: Column, gap: Column) -> Column:
        return F.transform(found, lambda e, k: _entry(e["text"], F.when((k == F.size(found) - 1) & (gap != ""), gap).otherwise(e["sep"])))

    def of_block(pair: Column) -> Column:
        none = F.array().cast("array<struct<text:string,sep:string>>")
        filled = lambda body: tx.let(units(body), lambda found: closed(found, F.coalesce(pair["gap"], F.lit(""))))
        return tx.let(tx.strip(pair["block"]), lambda body: F.when(body == "", none).otherwise(filled(body)))

    pairs = F.zip_with(blocks, gaps, lambda block, gap: F.struct(block.alias("block"), gap.alias("gap")))
    return F.flatten(F.transform(pairs, of_block))


def in_order(original: Column, kept: Column) -> Column:
    """Whether ``kept`` is made of whole sentences of ``original``, in order, with their separators."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("built"), F.lit("").alias("sep"))

    def take(state: Column, entry: Column, source: Column) -> Column:
        rest = F.slice(source, state["at"] + 1, F.size(source))
        step = F.array_position(F.transform(rest, lambda e: e["text"]), entry["text"]).cast("int")
        at = state["at"] + step
        sep = F.get(source, at - 1)["sep"]
        found = F.struct(at.alias("at"), F.concat(state["built"], state["sep"], entry["text"]).alias("built"), F.when(sep == "", " ").otherwise(sep).alias("sep"))
        return F.when(state["at"].isNotNull() & (step > 0), found).otherwise(F.struct(F.lit(None).cast("int").alias("at"), F.lit("").alias("built"), F.lit("").alias("sep")))

    def judged(source: Column, wanted: Column) -> Column:
        end = F.aggregate(wanted, start, lambda state, entry: take(state, entry, source))
        whole = tx.let(end, lambda e: e["at"].isNotNull() & (e["built"] == kept))
        return F.when(F.size(wanted) == 0, F.size(source) == 0).otherwise(whole)

    return tx.let(boundaries_in_row(original), lambda source: tx.let(boundaries_in_row(kept), lambda wanted: judged(source, wanted)))


# ---------------------------------------------------------------- compression


def overlap_score(sentence: Column, query_words: Column) -> Column:
    """How many words of the sentence are query words, repeats included."""
    return F.size(F.filter(tx.unicode_words(F.lower(sentence)), lambda w: F.array_contains(query_words, w)))


def best_sentences(sentences: Column, excerpt: Column, query_words: Column, count: int) -> Column:
    """The ``count`` sentences with most query words, in their order; a text with no more stays whole."""
    def chosen(found: Column) -> Column:
        rated = F.transform(
            found, lambda s, i: F.struct((-overlap_score(s["text"], query_words)).alias("a"), i.alias("i"), s["text"].alias("text"), s["sep"].alias("sep")))
        best = F.array_sort(F.transform(F.slice(F.array_sort(rated), 1, count), lambda s: F.struct(s["i"].alias("i"), s["text"].alias("text"), s["sep"].alias("sep"))))
        joined = F.transform(best, lambda s, k: F.concat(s["text"], F.when(k == count - 1, "").when(s["sep"] == "", " ").otherwise(s["sep"])))
        return F.when(F.size(found) <= count, excerpt).otherwise(F.array_join(joined, ""))

    return tx.let(sentences, chosen)


def compress(packages: DataFrame, policy: CompressionPolicy, package_policy: PackagePolicy = PackagePolicy()) -> DataFrame:
    """Add ``compressed`` evidence, its text and the report columns to every package.

    Everything happens inside the package's own row (a package holds at most six items), so no row
    is shuffled. Outcome, sizes and one trace entry per item are kept beside the original columns.
    """
    fits = lambda chars, tokens: (
        (F.lit(True) if policy.target_chars is None else chars <= policy.target_chars)
        & (F.lit(True) if policy.target_tokens is None else tokens <= policy.target_tokens)
    )
    df = packages.withColumn("parsed", F.transform("evidence", lambda e: boundaries_in_row(e["excerpt"])))
    df = df.withColumn("query_words", F.array_distinct(tx.unicode_words(F.lower("normalized_query"))))
    df = df.withColumn("untouched", fits(F.col("context_chars"), F.col("estimated_tokens")) | (F.size("evidence") == 0))
    prints = F.transform(
        "evidence",
        lambda e: F.to_json(F.struct(e["source_id"].alias("a"), e["source_kind"].alias("b"), e["document_id"].alias("c"), e["chunk_id"].alias("d"), tx.strip(e["excerpt"]).alias("e"))),
    )
    df = df.withColumn("prints", prints)

    def shorten(sentences: Column, excerpt: Column) -> Column:
        return best_sentences(sentences, excerpt, F.col("query_words"), policy.max_sentences)

    def work(e: Column, i: Column) -> Column:
        sentences = F.get("parsed", i)
        first = F.array_position("prints", F.get("prints", i)).cast("int")
        duplicate = F.lit(policy.deduplicate and policy.allow_drop) & (first < i + 1)
        return F.struct(
            i.alias("place"), duplicate.alias("duplicate"), F.when(duplicate, F.element_at("evidence", first)["evidence_id"]).alias("duplicate_of"),
            F.size(sentences).alias("sentences"), (F.size(sentences) > policy.max_sentences).alias("extracted"),
            shorten(sentences, e["excerpt"]).alias("excerpt"),
        )

    df = df.withColumn("work", F.transform("evidence", work))
    swap = lambda e, text: F.struct(*[(text if n == "excerpt" else e[n]).alias(n) for n in _evidence_names(packages)])
    kept = F.transform(F.filter("work", lambda w: ~w["duplicate"]), lambda w: swap(F.get("evidence", w["place"]), w["excerpt"]))
    df = df.withColumn("kept", F.when(F.col("untouched"), F.col("evidence")).otherwise(kept))
    # Size of the context that ends after each kept item: citation ids stay, so block sizes are fixed.
    sizes = F.transform("kept", lambda e: F.length(evidence_block(e["citation_id"], e)) + 2)
    df = df.withColumn("sizes", sizes)
    ends = F.aggregate(
        "sizes", F.array(F.lit(len(HEADER))), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s))
    )
    df = df.withColumn("ends", F.slice(ends, F.lit(2), F.size("sizes")))
    fitting = F.size(F.filter("ends", lambda s: fits(s, F.ceil(s / 4))))
    count = F.size("kept")
    keep = F.when(F.col("untouched") | F.lit(not policy.allow_drop), count).otherwise(F.greatest(fitting, F.least(F.lit(1), count)))
    df = df.withColumn("keep", keep).withColumn("compressed", F.slice("kept", F.lit(1), F.col("keep")))
    df = df.withColumn("compressed_text", render(F.col("compressed")))
    df = df.withColumn("compressed_chars", F.length("compressed_text")).withColumn("compressed_tokens", tx.estimate_tokens(F.length("compressed_text")))
    met = F.col("untouched") | fits(F.col("compressed_chars"), F.col("compressed_tokens"))
    df = df.withColumn("target_met", met)
    df = df.withColumns({
        "outcome": F.when(F.col("untouched"), "no_reduction").when(F.col("target_met"), "reduced").otherwise("target_unachievable"),
        "chars_removed": F.greatest(F.col("context_chars") - F.col("compressed_chars"), F.lit(0)),
        "tokens_removed": F.greatest(F.col("estimated_tokens") - F.col("compressed_tokens"), F.lit(0)),
        "reduction_basis_points": F.when(
            F.col("estimated_tokens") > 0,
            F.greatest(F.lit(0), F.least(F.lit(10_000), F.floor((F.col("estimated_tokens") - F.col("compressed_tokens")) * 10_000 / F.col("estimated_tokens")))),
        ).otherwise(0),
    })
    # Sentences of what was retained are counted on the shortened text itself.
    df = df.withColumn("reparsed", F.transform("work", lambda w: boundaries_in_row(w["excerpt"])))
    ids = F.transform("compressed", lambda e: e["citation_id"])

    def entry(w: Column) -> Column:
        e = F.get("evidence", w["place"])
        held = F.array_contains(ids, e["citation_id"])
        action = (
            F.when(F.col("untouched"), "kept_whole").when(w["duplicate"], "dropped_duplicate").when(~held, "dropped_for_target")
            .when(w["extracted"], "extracted").otherwise("kept_whole")
        )
        whole = F.col("untouched")
        return F.struct(
            e["evidence_id"].alias("evidence_id"), e["citation_id"].alias("citation_id"), action.alias("action"),
            F.length(e["excerpt"]).alias("original_chars"),
            F.when(whole, F.length(e["excerpt"])).when(~held, 0).otherwise(F.length(w["excerpt"])).alias("retained_chars"),
            w["sentences"].alias("original_sentences"),
            F.when(whole, w["sentences"]).when(~held, 0).otherwise(F.size(F.get("reparsed", w["place"]))).alias("retained_sentences"),
            F.when(~whole, w["duplicate_of"]).alias("duplicate_of"),
        )

    df = df.withColumn("trace", F.transform("work", entry))
    drop = ("parsed", "query_words", "prints", "work", "kept", "sizes", "ends", "keep", "untouched", "reparsed")
    df = df.drop(*drop)
    return df.withColumn("compressed_package_id", _descendant(package_policy, policy))


def _evidence_names(packages: DataFrame) -> list[str]:
    return packages.schema["evidence"].dataType.elementType.names


def _descendant(package_policy: PackagePolicy, policy: CompressionPolicy) -> Column:
    trace = F.array_join(
        F.transform("trace", lambda t: F.concat_ws(":", t["citation_id"], t["action"], t["retained_chars"].cast("string"), F.coalesce(t["duplicate_of"], F.lit("")))), ","
    )
    settings = f"policy={policy.target_chars}:{policy.target_tokens}:{policy.max_sentences}:{policy.allow_drop}:{policy.deduplicate}"
    return package_id(
        package_policy,
        F.concat_ws(":", F.lit("compression="), F.col("package_id"), F.col("outcome"), F.col("compressed_chars").cast("string"), F.col("reduction_basis_points").cast("string"), trace),
        F.lit(settings),
    )


# ---------------------------------------------------------------- invariants


def quality_problems(compressed: DataFrame, policy: CompressionPolicy) -> DataFrame:
    """``(entity_id, rule)`` for every broken invariant of a compressed package."""
    provenance = ("source_id", "source_kind", "document_id", "chunk_id", "title", "section", "source_label", "canonical_url", "retrieval_route", "rank", "score")
    origin = lambda e: F.get(F.filter("evidence", lambda o: o["evidence_id"] == e["evidence_id"]), F.lit(0))
    same = lambda e, o: F.struct(*[e[c] for c in provenance]).eqNullSafe(F.struct(*[o[c] for c in provenance]))
    ids = F.transform("compressed", lambda e: e["evidence_id"])
    cites = F.transform("compressed", lambda e: e["citation_id"])
    gone = F.array_except(F.transform("evidence", lambda e: e["evidence_id"]), ids)
    told = F.transform(F.filter("trace", lambda t: t["action"].startswith("dropped")), lambda t: t["evidence_id"])
    shown = F.regexp_extract_all("compressed_text", F.lit(r"\[(C[0-9]+)\]"), F.lit(1))
    rules = {
        "emptied": (F.size("evidence") > 0) & (F.size("compressed") == 0),
        "duplicate_evidence_id": F.size(ids) != F.size(F.array_distinct(ids)),
        "duplicate_citation_id": F.size(cites) != F.size(F.array_distinct(cites)),
        "unknown_evidence": F.exists("compressed", lambda e: origin(e).isNull()),
        "renumbered": F.exists("compressed", lambda e: origin(e)["citation_id"] != e["citation_id"]),
        "provenance_changed": F.exists("compressed", lambda e: origin(e).isNotNull() & ~same(e, origin(e))),
        "blank_excerpt": F.exists("compressed", lambda e: tx.is_blank(e["excerpt"])),
        "unauthorised_drop": (F.size(gone) > 0) & F.lit(not policy.allow_drop),
        "untraced_drop": F.size(F.array_except(gone, told)) > 0,
        "text_mismatch": F.col("compressed_text") != render(F.col("compressed")),
        "char_count": F.col("compressed_chars") != F.length("compressed_text"),
        "token_count": F.abs(F.col("compressed_tokens") - tx.estimate_tokens(F.length("compressed_text"))) > 1,
        "missing_header": (F.size("compressed") > 0) & ~F.col("compressed_text").startswith(HEADER),
        "missing_marker": F.exists("compressed", lambda e: ~F.contains("compressed_text", F.concat(F.lit("[END "), e["citation_id"], F.lit("]")))),
        "unmapped_citation": F.size(F.array_except(shown, cites)) > 0,
        "target_not_met": F.col("target_met")
        & ((F.lit(False) if policy.target_chars is None else F.col("compressed_chars") > policy.target_chars)
           | (F.lit(False) if policy.target_tokens is None else F.col("compressed_tokens") > policy.target_tokens)),
    }
    from citeloom.functions.checks import violations

    plain = violations(compressed, F.col("package_id"), rules)
    pairs = compressed.select("package_id", F.explode_outer("compressed").alias("c"), "evidence").filter("c is not null").select(
        "package_id", F.col("c.excerpt").alias("kept"), origin(F.col("c"))["excerpt"].alias("original")
    )
    changed = pairs.filter("original is not null and kept <> original").withColumn("ordered", in_order(F.col("original"), F.col("kept")))
    return plain.unionByName(
        changed.filter("not ordered").select(F.col("package_id").alias("entity_id"), F.lit("not_ordered_sentences").alias("rule")).distinct()
    )
