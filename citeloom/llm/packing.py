"""Packing by power-of-two decomposition: no piece crosses a document, none is padded.

A document of ``n`` tokens (its ids and the closing id) is cut into full sequences of ``1024`` and then
into the powers of two of the rest, largest first. Every piece is a whole sequence of its length; pieces
of equal length form a bucket, and training batches are drawn from one bucket at a time.

The plan is one scan and one Arrow stage; nothing is shuffled. Sequence numbers come from the number of
the input split and the row in it, so a task that is run again gives the same numbers.

Defined cases: a null or empty text is the closing id alone (one piece of length 1); a null id stays null
and is packed like any other; repeated rows are packed once each; an empty table gives no pieces; other
columns are never read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import blocks, pick

LONGEST = 1024
CLOSING_ID = 0
#: Words whose ids a task remembers; the memory is emptied when it is full.
WORD_MEMORY = 400_000
PIECES = "doc_id long, start long, length long, doc_tokens long, bucket int, ids binary"


def decompose(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full sequences, then the binary digits of the rest."""
    full = n // longest
    out = [(i * longest, longest) for i in range(full)]
    at, rest = full * longest, n - full * longest
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


class WordTokenizer:
    """Ids of a text from the ids of its words.

    The byte-level rules never join text over a space that a visible character follows, so a text may be
    cut before each such space, and the ids of the parts put together. Parts seen before are remembered.
    The ids are those of the ``tokenizers`` file with the same vocabulary.
    """

    CUT = re.compile(r" (?=\S)")
    UNSAFE = re.compile(r" (?!\S)")

    def __init__(self, ranks_file: str, end_id: int = 50256):
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": end_id}
        )
        outer = self

        class Memory(dict):
            def __missing__(self, word: str) -> bytes:
                ids = outer.part(" " + word)
                if len(self) >= WORD_MEMORY:
                    self.clear()
                if len(word) < 64:
                    self[word] = ids
                return ids

        self.memory = Memory()

    def part(self, text: str) -> bytes:
        return np.array(self.coder.encode(text, allowed_special="all"), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        first, *words = self.CUT.split(text) if self.UNSAFE.search(text) else text.split(" ")
        return self.part(first) + b"".join(map(self.memory.__getitem__, words))


def default_tokenizer() -> Callable[[str], bytes]:
    import public_tokenizers

    return WordTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def pack(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST,
    tokenizer: Callable[[], Callable[[str], bytes]] = default_tokenizer,
) -> DataFrame:
    """Pieces of all documents: ``PIECES``, with ``sequence_id`` and ``offset``.

    ``ids`` are little-endian unsigned 32-bit numbers; ``bucket`` is the binary logarithm of the length.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = tokenizer(), np.array([CLOSING_ID], "<u4").tobytes()
        schema = pa.schema([(n, t) for n, t in (
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
            ("bucket", pa.int32()), ("ids", pa.binary()))])
        for batch in blocks(batches, "text", 4 << 20):
            rows: list[tuple] = []
            for key, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = (encode(body) if body else b"") + closing
                n = len(ids) // 4
                rows += [(key, s, k, n, k.bit_length() - 1, ids[4 * s : 4 * (s + k)]) for s, k in decompose(n, longest)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    source = pick(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    pieces = source.mapInArrow(work, PIECES)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per piece length, as a trainer reads them."""
    pieces.write.partitionBy("bucket").parquet(path)
