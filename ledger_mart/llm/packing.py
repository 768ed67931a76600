"""Packing documents into training sequences, shortest pack first over the length histogram.

Tokenised documents are cut at multiples of the sequence length; the remainders are
packed by length alone: from the longest down, each length joins the emptiest packs that
exist, or opens packs of its own if it doesn't fit there. Packs of like content are one
pattern with a count, so the packer's work depends on the sequence length and not on the
corpus. Documents then find their place by their rank among those of the same length.

Defined results: null and empty texts are the end id alone; very long texts are cut;
repeated rows are documents of their own (equal pieces may swap places); an empty table
gives no pieces; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_mart.llm.common import kept, ranked, written

LENGTH = 4096
END_ID = 2
#: White space of which tokenizers and str.split() may differ in opinion.
_ODD = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ODD_SPACE = re.compile("[" + "".join(map(chr, _ODD)) + "]")
#: Punctuation that ends a word of Latin letters: parted from it, fewer different words remain.
_TAIL = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])[.,!?;:]+(?=\s|$)")
_CACHED_WORDS = 500_000
_CACHED_CHARS = 48
_TEXTS = 256  # worked on at once


class WordIds:
    """Ids of texts as little-endian bytes, by way of their words' ids.

    The tokenizer drops white space and never joins what white space parts, so a text's
    ids are those of its words in turn. Of the words seen, the latest half a million to
    a million are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def words(self, text: str) -> list[str] | None:
        """None if the text has to be tokenised as a whole."""
        if _ODD_SPACE.search(text):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:  # letters beyond Latin-1 may change case otherwise there
            return text.split()
        return _TAIL.sub(r" \g<0>", text.lower()).split()

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _CACHED_WORDS:
            self.known, self.older = {}, self.known
        by_text = [self.words(x) for x in texts]
        new = [x for x in set().union(*(x for x in by_text if x)) if x not in self.known]
        again = {x: ids for x in new if (ids := self.older.get(x)) is not None}
        first = [x for x in new if x not in again]
        own = dict(zip(first, self.encode(first))) | again
        self.known.update((x, ids) for x, ids in own.items() if len(x) <= _CACHED_CHARS)
        look = (lambda x: self.known.get(x) or own[x]) if any(len(x) > _CACHED_CHARS for x in own) else self.known.__getitem__
        whole = iter(self.encode([x for x, words in zip(texts, by_text) if words is None]))
        return [next(whole) if words is None else b"".join(map(look, words)) for words in by_text]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): documents cut at multiples of ``length``."""
    end = np.array([end_id], "<u4").tobytes()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("packing", ("word ids", tokenizer), lambda: WordIds(tokenizer))
        for batch in batches:
            rows = []
            for at in range(0, len(batch), _TEXTS):
                some = batch.slice(at, _TEXTS)
                texts = [x.as_py() or "" for x in some.column("text")]
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), words.texts(texts)):
                    n = len(ids := ids + end) // 4
                    for start in range(0, n, length):
                        part = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(names), names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, ", ".join(f"{n} long" for n in names))


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (count, {length: pieces of it in a pack}) that hold each length as often as the histogram.

    Each step moves a whole pattern or ends a length, so there are at most two patterns
    more for each length.
    """
    by_fill: dict[int, list[tuple[int, dict[int, int]]]] = {}
    fills: list[int] = []

    def put(fill: int, count: int, parts: dict[int, int]) -> None:
        if fill not in by_fill:
            by_fill[fill] = []
            heapq.heappush(fills, fill)
        by_fill[fill].append((count, parts))

    done = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not fills or fills[0] + length > size:
                put(length, left, {length: 1})
                break
            fill = fills[0]
            count, parts = by_fill[fill].pop()
            taken = min(count, left)
            if count > taken:
                by_fill[fill].append((count - taken, parts))
            if not by_fill[fill]:
                del by_fill[fill]
                heapq.heappop(fills)
            grown = parts | {length: parts.get(length, 0) + 1}
            if fill + length == size:
                done.append((taken, grown))
            else:
                put(fill + length, taken, grown)
            left -= taken
    return done + [x for group in by_fill.values() for x in group]


def places(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, pieces of it in a pack, first sequence, offset)."""
    rows, used, sequence = [], {}, 0
    for count, parts in patterns:
        offset = 0
        for length, many in parts.items():
            first = used.get(length, 0)
            used[length] = first + count * many
            rows.append((length, first, used[length], many, sequence, offset))
            offset += length * many
        sequence += count
    return rows


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    The texts are tokenised once and only figures of pieces are kept. The driver sees the
    histogram (at most ``length`` rows) and sends back the places (a few for each length).
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, length, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = places(shortest_pack_first(histogram, length))
    schema = "_length long, _from long, _to long, _many long, _sequence long, _offset long"
    at = F.broadcast(spark.createDataFrame(rows, schema))
    lined = ranked(cut, ["length"], ["doc_id", "start"])
    found = lined.join(at, (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")))
    nth = F.col("rank") - F.col("_from")
    return found.select(
        *cut.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_many"))).alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_many") * F.col("length")).alias("offset"),
    )
