"""HTML pages to Markdown-like text, from a stream of tags and text runs.

One pattern cuts a page into tokens that cover it. Which of them are visible, and which lie in preformatted
blocks, depends on how elements nest; that is a running count over the tags alone, kept by a small Arrow
function that is given one number per token (and the page's distinct character references, to look them up).
Tags of visible runs become the line ends or marks they stand for; each preformatted block becomes a fence
longer than any run of tildes in it. An element that is never closed hides, or keeps, what follows to the
end; a preformatted block inside another one replaces what the outer one held so far.
"""

from __future__ import annotations

import html as _html
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import text as tx

# Tags whose content is dropped, and tags that open a block.
HIDDEN = ("head", "script", "style", "noscript", "template")
BLOCKS = ("p", "div", "section", "article", "blockquote", "br")

_REST = r"""(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ANY_TAG = rf"(?is)</?[a-z][^\s/>]*+{_REST}|</[a-z][^>]*+>"
_UNSEEN = rf"<!--.*?-->|<[!?][^>]*+>|<(script|style){_REST}(?<!/>).*?(?:</\1\s*+>|\z)"
_TOKEN = rf"(?is){_UNSEEN}|</?[a-z][^\s/>]*+{_REST}|</[a-z][^>]*+>|[^<]++|<"
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: What a token does to the nesting: opens or closes hidden content, opens or closes a preformatted block, or both at once.
_HIDE, _SHOW, _PRE, _END, _EMPTY = 1, 2, 3, 4, 5


def _effect(token: Column) -> Column:
    hidden, whole = "|".join(HIDDEN), token.endswith("/>")
    tag = (
        F.when(token.rlike(rf"(?i)^<(?:{hidden})[\s/>]"), F.when(whole, 0).otherwise(_HIDE))
        .when(token.rlike(rf"(?i)^</(?:{hidden})[\s/>]"), _SHOW)
        .when(token.rlike(r"(?i)^<pre[\s/>]"), F.when(whole, _EMPTY).otherwise(_PRE))
        .when(token.rlike(r"(?i)^</pre[\s/>]"), _END)
        .otherwise(0)
    )
    return F.when(token.startswith("<"), tag).otherwise(0)


def runs(effects: np.ndarray) -> Iterator[list[int]]:
    """Runs of visible tokens in order: ``[0, from, to]`` outside of preformatted blocks, ``[1, from, to, ...]`` for one block."""
    hidden = depth = start = 0
    block: list[int] = []
    for i in [*np.nonzero(effects)[0].tolist(), len(effects)]:
        if not hidden and start < i:
            if depth:
                block += [start, i]
            else:
                yield [0, start, i]
        start, effect = i + 1, effects[i] if i < len(effects) else 0
        if effect == _HIDE:
            hidden += 1
        elif effect == _SHOW:
            hidden = max(0, hidden - 1)
        elif hidden or not effect:
            continue
        elif effect in (_PRE, _EMPTY):
            depth, block = depth + (effect == _PRE), []
        elif depth:
            yield [1, *block]
            depth, block = depth - 1, []


@F.pandas_udf(T.StructType().add("runs", T.ArrayType(T.ArrayType(T.IntegerType()))).add("found", T.ArrayType(T.StringType())))
def _facts(effects: pd.Series, references: pd.Series) -> pd.DataFrame:
    seen = [None if e is None else list(runs(e)) for e in effects]
    found = [None if r is None else [_html.unescape(x) for x in r] for r in references]
    return pd.DataFrame({"runs": pd.Series(seen, dtype=object), "found": pd.Series(found, dtype=object)})


def _breaks(page: Column) -> Column:
    """Text outside of preformatted blocks: marks and line ends for tags."""
    for level in range(1, 7):
        page = F.regexp_replace(page, rf"(?is)<h{level}{_REST}", "\n\n" + "#" * level + " ")
    page = F.regexp_replace(page, rf"(?is)<li{_REST}", "\n- ")
    opened, closed = "|".join(BLOCKS), "|".join((*BLOCKS, r"h[^\s/>]*+"))
    page = F.regexp_replace(page, rf"(?is)<(?:{opened}){_REST}|</(?:{closed})(?=[\s/>])[^>]*+>", "\n\n")
    return F.regexp_replace(page, _ANY_TAG, "")


def _fenced(block: Column) -> Column:
    language = F.regexp_extract(block, r"""(?is)<code\s(?:[^>]*?\s)?class\s*=\s*(?:["'][^"'>]*?\s|["']|)language-([A-Za-z0-9_+-]+)""", 1)
    body = F.regexp_replace(F.regexp_replace(block, _ANY_TAG, ""), r"^\n+|\n+\z", "")
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(body, F.lit("~+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("~"), F.greatest(longest + 1, F.lit(3)))
    return F.when(body == "", "").otherwise(F.concat(F.lit("\n\n"), fence, language, F.lit("\n"), body, F.lit("\n"), fence, F.lit("\n")))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def _tidied(text: Column) -> Column:
    """No trailing blanks on lines and no runs of blank lines."""
    lines = F.regexp_replace(unix_lines(text), r"[ \t]+\n", "\n")
    return tx.strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def with_visible_text(df: DataFrame, html: Column, target: str) -> DataFrame:
    """``df`` with the normalised visible text of ``html`` (NULL stays NULL) as column ``target``."""
    tokens = F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), lambda t: F.when(t.rlike(rf"(?is)^(?:{_UNSEEN})\z"), "").otherwise(t))
    references = F.array_distinct(F.regexp_extract_all(html, F.lit(_REFERENCE), F.lit(0)))
    cut = df.withColumns({"__tokens": tokens, "__refs": references})
    cut = cut.withColumn("__facts", _facts(F.transform("__tokens", lambda t: _effect(t).cast("tinyint")), "__refs"))

    def text_of(run: Column) -> Column:
        part = lambda j: F.slice("__tokens", F.get(run, 2 * j + 1) + 1, F.get(run, 2 * j + 2) - F.get(run, 2 * j + 1))
        parts = F.when(F.size(run) > 1, F.transform(F.sequence(F.lit(0), (F.size(run) / 2).cast("int") - F.lit(1)), part))
        joined = F.coalesce(F.array_join(F.flatten(parts), ""), F.lit(""))
        return F.when(F.get(run, F.lit(0)) == 0, tx.let(joined, _breaks)).otherwise(tx.let(joined, _fenced))

    page = cut.withColumn("__page", F.array_join(F.transform("__facts.runs", text_of), ""))
    # An argument of ``transform`` is computed once a row; what a lambda names is computed once an element.
    pieces = F.arrays_zip(F.split("__page", _REFERENCE, -1).alias("text"), F.regexp_extract_all("__page", F.lit(_REFERENCE), F.lit(0)).alias("name"))
    filled = lambda known: F.transform(pieces, lambda p: F.concat(p["text"], F.coalesce(F.try_element_at(known, p["name"]), p["name"], F.lit(""))))
    resolved = F.when(F.size("__refs") > 0, F.array_join(tx.let(F.map_from_arrays(F.col("__refs"), F.col("__facts.found")), filled), "")).otherwise(F.col("__page"))
    return page.withColumn(target, _tidied(resolved)).drop("__tokens", "__refs", "__facts", "__page")
