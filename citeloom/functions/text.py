"""Text expressions: whitespace, tokens, normalisation and word lists.

All patterns are written with explicit character classes, because the shorthand ``\\w`` and ``\\s``
are ASCII-only in Java while the behaviour to match is Unicode-aware.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every code point that counts as white space when text is stripped or split.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same code points one by one, for trimming.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# One or more characters that are no white space: runs of visible ASCII need one comparison a character, others the whole class.
SOLID = rf"(?:[!-~]++|[^{SPACE}])++"
# The word class and the code-aware token pattern.
WORD = r"\p{L}\p{N}_"
TOKEN_PATTERN = (
    rf"--[{WORD}-]+|/[{WORD}./-]+|[{WORD}]+(?:[._-][{WORD}]+)*|==|!=|<=|>="
)
# The same tokens, lower-cased, with ASCII runs first.
_TOKEN = rf"--[{WORD}-]+|/[{WORD}./-]+|(?:[0-9a-z_]++|[{WORD}])++(?:[._-](?:[0-9a-z_]++|[{WORD}])++)*+|==|!=|<=|>="
# Words the tokenizer drops.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "in", "is", "it", "of", "on", "or", "the", "to", "with",
)
TOKENIZER_VERSION = "1.0"
# Texts whose terms are held as Python objects at a time.
TEXTS_AT_ONCE = 512

# Code points left alone by NFKC in this range; anything outside goes through the Arrow job.
_NFKC_CANDIDATE = r"[^\x00-\x7F\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.trim(col, F.lit(SPACES))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(SPACES))


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")


def words(col: Column) -> Column:
    """Runs of non-space characters."""
    return F.regexp_extract_all(col, F.lit(SOLID), F.lit(0))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(SOLID))


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(col: Column) -> Column:
    """NFKC form. Rows that cannot change are sent to Python as NULL and never copied."""
    return F.coalesce(_nfkc(F.when(col.rlike(_NFKC_CANDIDATE), col)), col)


def tokens(col: Column, *, normalise: bool = True) -> Column:
    """Lower-cased code-aware tokens without trailing dots and stop words."""
    source = F.lower(nfkc(col) if normalise else col)
    raw = F.regexp_extract_all(source, F.lit(_TOKEN), F.lit(0))
    clean = F.transform(raw, lambda t: F.rtrim(t, F.lit(".")))
    return F.filter(clean, lambda t: (t != "") & ~t.isin(*STOPWORDS))


# The token pattern for texts without a character outside ``_AGREED``: there ``\w``, categories and lower case are the
# same in Python and Java. Scripts added since, final sigma and dotted I are left to :func:`tokens`.
_PLAIN_TOKEN = re.compile(r"\w+(?:[._-]\w+)*|--[\w-]+|/[\w./-]+|==|!=|<=|>=")
_AGREED = (
    "\\x00-\u012f\u0131-\u024f\u0370-\u03a2\u03a4-\u052f\u2000-\u2070\u2074-\u20bf\u3000-\u3096\u3099-\u30ff\u4e00-\u9fef\uac00-\ud7a3"
    "\U0001f300-\U0001f64f"
)
_OTHER = re.compile(f"[^{_AGREED}]")


def count_tokens(text: str, normalise: bool = True) -> dict[str, int] | None:
    """How often each of :func:`tokens` occurs; None where only that expression can tell."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text) if normalise else text
        if _OTHER.search(text):
            return None
    found = Counter(_PLAIN_TOKEN.findall(text.lower()))
    for path in [t for t in found if t[-1] == "."]:
        found[path.rstrip(".")] += found.pop(path)
    for word in STOPWORDS:
        found.pop(word, None)
    return found


def token_counts(col: Column, *, normalise: bool = True) -> Column:
    """``struct<dl, counts array<struct<term, tf>>>`` of the tokens, terms in order, for most texts; NULL for the others."""

    def some(texts: pa.Array) -> pa.Array:
        found = [None if t is None else count_tokens(t, normalise) for t in texts.to_pylist()]
        terms, tf, ends = [], [], [0]
        for one in found:
            kept = sorted(one or ())
            terms += kept
            tf += [one[t] for t in kept]
            ends.append(len(terms))
        pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tf, pa.int32())], names=["term", "tf"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        length = pa.array([sum((one or {}).values()) for one in found], pa.int32())
        return pa.StructArray.from_arrays([length, lists], names=["dl", "counts"], mask=pa.array([one is None for one in found]))

    @F.arrow_udf("struct<dl: int, counts: array<struct<term: string, tf: int>>>")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(texts.slice(at, TEXTS_AT_ONCE)) for at in range(0, max(1, len(texts)), TEXTS_AT_ONCE)])

    return counted(col)


def ascii_words(col: Column) -> Column:
    """Runs of ``[A-Za-z0-9_-]`` between word boundaries, the unit of coverage and fact overlap."""
    return F.regexp_extract_all(col, F.lit(r"(?U)\b[a-zA-Z0-9_-]+\b"), F.lit(0))


def bounded(alternatives: str) -> str:
    """Case-insensitive "contains one of these as whole words" pattern with Unicode boundaries."""
    return rf"(?i)(?:^|[^{WORD}])(?:{alternatives})(?:$|[^{WORD}])"


def unicode_words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(rf"[{WORD}]+"), F.lit(0))


def estimate_tokens(chars: Column) -> Column:
    """One token for every four characters, rounded up."""
    return F.ceil(chars / F.lit(4)).cast("long")
