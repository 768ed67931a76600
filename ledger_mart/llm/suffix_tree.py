"""Scoring texts with a probabilistic suffix tree over words.

States are contexts of up to DEPTH words, among those that occur LEAST_COUNT times or more, whatever
the corpus. A context is a state if the words after it differ from what the longest state that is
its suffix predicts, by a likelihood-ratio test.
A state's distribution discounts its counts and gives the rest to that shorter state's; the
root discounts the words' counts and gives the rest to unknown words. A token is scored
by the longest state that the words before it end with, so the model's score is the
root's plus a correction from the states.

Counts cover all training documents. Runs, states and distributions are Spark tables, one level after
another: counts are grouped, a run meets its suffix for the test. The correction of a text is
a sum over the runs in it: each run has one weight, log P of its last token less what
its suffix and its context give already, and the mass that it leaves as a context itself.
The FAST most counted runs' weights are sent to the tasks, those of all others meet the documents' runs
in a join; the same join brings the counts of words beyond the HEAD most counted ones. Two sieves keep from the shuffles
what cannot be frequent: one of the frequent runs a token shorter, and one that counts each run up to
three, in cells that several runs may share. They may let more through and never lose a run.
What is counted and looked up is shuffled as packed numbers, a row for each part of the keys and lot of documents;
the number of parts grows with the corpus.

Defined results: null and empty texts are the end token alone; without training documents every score
is 0 and nothing is known; repeated rows get equal results; a row without id is scored
like any other; an empty table gives no rows; other columns of the input are not read.
Runs are joined by hashes of 64 bits, and words beyond the head by theirs of 62.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_mart.llm.common import extended, in_slices, joined, schema_of, small, written

DEPTH = 3
LEAST_SHARE = 0.0  # of the corpus: none, LEAST_COUNT decides at every size
LEAST_COUNT = 4
HEAD = 300_000
FAST = 2_000_000
DISCOUNT = 0.75
LOOSE = 4.0  # standard deviations by which a likelihood ratio must exceed its mean
START, END, RARE = 0, 1, 2
IDS = ["low", "high", "tails"]  # two bytes and one of each id, and the tail's
_FIRST_WORD = 3
_HELD = 500_000  # runs that a task gathers before it passes them on
_HELD_WORDS = 300_000
_DOCS = 256  # worked on at once
_SIEVE_BITS = (16, 27)  # the least and the most, along with the keys
_SIEVE_CELLS = 64  # for each key, or more
_LOOKUP_CELLS = 512  # what passes by chance is shuffled to be looked up
_CELL_BITS = (16, 27)  # the least and the most of the sieve that counts, along with the corpus
_CHUNK = 1 << 20
_COUNTED, _LOOKED_UP = 1 << 21, 1 << 23  # taught tokens for each part of the keys, up to twice as many
_LOT = 1 << 15  # documents that ask together, at most
_TAIL = 1 << 62  # ids of words beyond the head begin here
_ODD, _ODDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z in lower case; bytes part at ASCII white space only."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, count) over the texts, each task summing up first."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in in_slices(batches, 2 << 20):
            words, counts = pc.value_counts(pa.array(chain.from_iterable(map(tokens, batch.column("text").to_pylist())), pa.binary())).flatten()
            held.append(pa.table([words, counts], ["word", "count"]))
            size += len(words)
            if size > 2 * _HELD_WORDS:
                held = [summed(held)]
                size = len(held[0])
                if size > _HELD_WORDS:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from summed(held).to_batches()

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("count", "sum")]).select(["word", "count_sum"]).rename_columns(["word", "count"])

    return docs.select("text").mapInArrow(counted, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _step(before: np.ndarray | None, ids: np.ndarray, length: int) -> np.ndarray:
    """Keys of runs, from the keys of the runs without their last tokens."""
    x = ids.astype(np.uint64) * _ODD + np.uint64(length)
    x = x if before is None else x + before.view(np.uint64) * _ODDER
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def key_of(columns: list[np.ndarray]) -> np.ndarray:
    """Keys of runs whose tokens are given one column each."""
    key = None
    for n, ids in enumerate(columns, 1):
        key = _step(key, ids, n)
    return key


def runs(ids: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the key of the run that ends at each place of ``ids``, and whether it lies in one document."""
    key, ok = _step(None, ids, 1), np.ones(len(ids), bool)
    yield key, ok
    for n in range(2, most + 1):
        key = _step(np.concatenate([key[:1], key[:-1]]), ids, n)
        ok = np.concatenate([[False], ok[:-1]])[: len(ids)] & (ids != START)
        yield key, ok


def tail_ids(words: Iterable[bytes]) -> list[int]:
    """Ids of words beyond the head."""
    from xxhash import xxh64_intdigest

    return [_TAIL + (xxh64_intdigest(w) >> 2) for w in words]


def ids_in(batch: pa.RecordBatch) -> np.ndarray:
    """The ids of the documents, one after another; the tail's take the places that are marked as rare."""
    low, high, tails = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("low", "<u2"), ("high", "u1"), ("tails", "<i8")))
    ids = low.astype(np.int64) | high.astype(np.int64) << 16
    ids[ids == RARE] = tails
    return ids


def by_place(numbers: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on, which Spark's shuffle compresses better."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def from_places(column: pa.ChunkedArray, of: str) -> list[np.ndarray]:
    """The numbers of each row."""
    size = np.dtype(of).itemsize
    return [np.frombuffer(data.as_buffer(), np.uint8).reshape(size, -1).T.copy().view(of).ravel() for data in column]


def parts_of(total: int, each: int) -> int:
    """Leading bits of a key that name its part."""
    return (total // each).bit_length() + 2


def cuts(key: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(part, low, high) of keys in ascending order without sign."""
    part = (key.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    low = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
    return list(zip(part[low].tolist(), low.tolist(), [*low[1:].tolist(), len(part)]))


def in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the keys in ascending order without sign, equal ones as they come, and where each key begins there."""
    order = np.argsort(key.view(np.uint64), kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order


def in_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def bytes_in_rows(numbers: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The numbers as bytes, so many for each row."""
    ends = np.concatenate([[0], np.cumsum(lengths * numbers.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(numbers.tobytes())])


def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The ids of a few documents at a time."""
    for batch in batches:
        for at in range(0, len(batch), _DOCS):
            yield ids_in(batch.slice(at, _DOCS))


@contextmanager
def sent_to_tasks(spark: SparkSession, value: Any) -> Iterator[Broadcast]:
    """A broadcast for jobs that end within the block. Its files, on the driver and on each executor that used it, go then."""
    sent = spark.sparkContext.broadcast(value)
    try:
        yield sent
    finally:
        sent.destroy(blocking=True)


def sieve_of(keys: DataFrame, cells: int = _SIEVE_CELLS) -> np.ndarray:
    """Bits by the leading bits of the keys: 0 where there is none."""
    bits = min(max((keys.count() * cells).bit_length(), _SIEVE_BITS[0]), _SIEVE_BITS[1])
    slot = F.expr(f"shiftrightunsigned(key, {64 - bits + 6})").alias("slot")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))").alias("bit")
    found = keys.select(slot, bit).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    sieve = np.zeros(1 << (bits - 6), np.uint64)
    sieve[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return sieve


def passes(sieve: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the sieve, whose length is a power of two, has the bit of the key's leading bits."""
    at = key.view(np.uint64) >> np.uint64(64 - 6 - (len(sieve) - 1).bit_length())
    return (sieve[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def add_counts(cells: np.ndarray, cell: np.ndarray, count: np.ndarray) -> None:
    """Add counts to different cells of two bits each, four to a byte, up to three."""
    for place in range(4):
        own = (cell & 3) == place
        at, shift = cell[own] >> 2, np.uint8(2 * place)
        now = np.minimum(3, ((cells[at] >> shift) & 3) + np.minimum(count[own], 3)).astype(np.uint8)
        cells[at] = (cells[at] & np.uint8(255 - (3 << 2 * place))) | (now << shift)


def places(ids: np.ndarray, n: int, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and keys of the runs of ``n`` tokens whose two shorter runs pass the sieve."""
    *_, shorter, (key, ok) = runs(ids, n)
    known = shorter[1] & passes(sieve, shorter[0])
    ok = ok & known & np.concatenate([[False], known[:-1]])[: len(ids)]
    at = np.flatnonzero(ok)
    return at, key[at]


def counting_sieve(encoded: DataFrame, n: int, sent: Broadcast, total: int) -> np.ndarray:
    """Bits by the leading bits of the keys: 0 where all runs of ``n`` tokens together occur less than three times.

    ``sent`` holds the sieve of runs one token shorter. Each task counts in cells of two bits; they travel as compressed chunks and Spark adds them up,
    chunk by chunk, a row at a time.
    """
    bits = min(max(total.bit_length() + 1, _CELL_BITS[0]), _CELL_BITS[1])
    names = ["chunk", "cells"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, held, size = sent.value, [], 0
        cells = np.zeros(1 << (bits - 2), np.uint8)

        def add() -> None:
            cell = np.concatenate([np.zeros(0, np.int64), *held])
            add_counts(cells, *np.unique(cell, return_counts=True))

        for ids in ids_of(batches):
            held.append((places(ids, n, sieve)[1].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64))
            size += len(held[-1])
            if size > _HELD:
                add()
                held, size = [], 0
        add()
        for at in range(0, len(cells), _CHUNK):
            part = cells[at : at + _CHUNK]
            if part.any():
                yield pa.record_batch([pa.array([at // _CHUNK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, np.zeros(0, np.uint8)

        def out() -> pa.RecordBatch:
            full = np.stack([(held >> np.uint8(2 * place)) & 3 for place in range(4)], axis=1).ravel() == 3
            return pa.record_batch([pa.array([chunk], pa.int32()), pa.array([np.packbits(full, bitorder="little").tobytes()], pa.binary())], names)

        for batch in batches:
            for own, data in zip(batch.column("chunk").to_pylist(), batch.column("cells")):
                part = np.frombuffer(zlib.decompress(data.as_py()), np.uint8)
                if own != chunk:
                    if chunk is not None:
                        yield out()
                    chunk, held = own, part.copy()
                    continue
                for place in range(4):
                    shift = np.uint8(2 * place)
                    both = np.minimum(3, ((held >> shift) & 3) + ((part >> shift) & 3))
                    held = (held & np.uint8(255 - (3 << 2 * place))) | (both << shift)
        if chunk is not None:
            yield out()

    rows = encoded.where("taught").select(*IDS).mapInArrow(counted, "chunk int, cells binary")
    merged = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(summed, "chunk int, cells binary").toArrow()
    found = np.zeros(1 << (bits - 3), np.uint8)
    size = min(_CHUNK // 2, len(found))
    for chunk, data in zip(merged["chunk"].to_pylist(), merged["cells"]):
        found[chunk * size : (chunk + 1) * size] = np.frombuffer(data.as_buffer(), np.uint8)
    return found.view(np.uint64)


def run_counts(encoded: DataFrame, n: int, least: int, sieve: np.ndarray, total: int) -> DataFrame:
    """(key, prefix, suffix, count) of the frequent runs of ``n`` > 1 tokens; the sieve is of those one token shorter."""
    spark = encoded.sparkSession
    with sent_to_tasks(spark, sieve) as sent:
        with sent_to_tasks(spark, counting_sieve(encoded, n, sent, total) if least >= 3 else None) as sent_often:
            return _run_counts(encoded, n, least, sent, sent_often, parts_of(total, _COUNTED))


def _run_counts(encoded: DataFrame, n: int, least: int, sent: Broadcast, sent_often: Broadcast, bits: int) -> DataFrame:
    own = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, often_enough, held, size = sent.value, sent_often.value, [], 0

        def out() -> pa.RecordBatch:
            found = np.concatenate([np.zeros((0, n + 1), np.int64), *held])
            order, first = in_order(np.ascontiguousarray(found[:, n]))
            count = np.diff(np.append(first, len(order)))
            found = found[order[first]]
            return in_rows([
                (part, by_place(found[low:high, :n].T.ravel()), by_place(count[low:high])) for part, low, high in cuts(np.ascontiguousarray(found[:, n]), bits)
            ], own)

        for ids in ids_of(batches):
            at, key = places(ids, n, sieve)
            if often_enough is not None:
                often = passes(often_enough, key)
                at, key = at[often], key[often]
            held.append(np.stack([*(ids[at - n + 1 + i] for i in range(n)), key], axis=1))
            size += len(at)
            if size > _HELD:
                yield out()
                held, size = [], 0
        yield out()

    def summed(rows: pa.Table) -> pa.Table:
        ids = np.concatenate([x.reshape(n, -1) for x in from_places(rows["ids"], "<i8")], axis=1)
        key, count = key_of(list(ids)), np.concatenate(from_places(rows["counts"], "<i8"))
        order, first = in_order(key)
        count = np.add.reduceat(count[order], first)
        often = count >= least
        first, count = order[first[often]], count[often]
        ids = [own[first] for own in ids]
        return pa.table({"key": key[first], "prefix": key_of(ids[:-1]), "suffix": key_of(ids[1:]), "count": count})

    rows = encoded.where("taught").select(*IDS).mapInArrow(counted, "part int, ids binary, counts binary")
    return written(rows.groupBy("part").applyInArrow(summed, "key long, prefix long, suffix long, count long"), f"runs{n}")


def weights_of(encoded: DataFrame, singles: DataFrame, least: int, spared: float, total: int) -> DataFrame:
    """(key, count, value): what each occurrence of a run adds to a text's natural log probability by the root.
    ``singles`` has (key, count) of the runs of one token."""
    shorter = singles.where(F.col("count") >= least)
    log_root = F.log(F.greatest(F.col("count") - spared, F.lit(1e-9)) / max(total, 1))
    below = shorter.select("key", "count", log_root.alias("log_p"))
    found = []
    for n in range(2, DEPTH + 2):
        shorter = run_counts(encoded, n, least, sieve_of(shorter), total)
        own = joined(shorter, small(below.select(F.col("key").alias("suffix"), F.col("log_p").alias("expected"))), ["suffix"])
        sums = own.groupBy("prefix").agg(
            F.sum("count").alias("seen"), F.count(F.lit(1)).alias("kinds"), F.sum(F.exp("expected")).alias("named"),
            F.sum(F.col("count") * (F.log("count") - F.col("expected"))).alias("gain"),
        )
        sums = joined(sums, below.select(F.col("key").alias("prefix"), F.col("count").alias("n")), ["prefix"])
        rest, rest_expected = F.greatest(F.col("n") - F.col("seen"), F.lit(0)), F.greatest(1 - F.col("named"), F.lit(1e-9))
        ratio = 2 * (F.col("gain") - F.col("seen") * F.log("n") + F.when(rest > 0, rest * F.log(rest / F.col("n") / rest_expected)).otherwise(0.0))
        states = sums.where(ratio > F.col("kinds") + LOOSE * F.sqrt(2 * F.col("kinds")) + LOOSE)
        left = F.greatest((rest + DISCOUNT * F.col("kinds")) / F.col("n"), F.lit(1e-12))
        states = written(states.select("prefix", "n", left.alias("left")), "states")
        mixed = F.greatest(F.col("count") - DISCOUNT, F.lit(0.0)) / F.col("n") + F.col("left") * F.exp("expected")
        log_p = F.when(F.col("left").isNotNull(), F.log(F.greatest(mixed, F.lit(1e-300)))).otherwise(F.col("expected"))
        value = F.when(F.col("left").isNotNull(), log_p - F.col("expected") - F.log("left"))
        below = written(joined(own, small(states), ["prefix"], "left").select("key", "count", log_p.alias("log_p"), value.alias("value")), "level")
        found += [states.select(F.col("prefix").alias("key"), F.col("n").alias("count"), F.log("left").alias("value")), below.where("value is not null").select("key", "count", "value")]
    both = reduce(DataFrame.union, found).groupBy("key").agg(F.max("count").alias("count"), F.sum("value").alias("value"))
    return written(both, "weights")


def in_parts(given: DataFrame, bits: int, first: int) -> DataFrame:
    """(part, keys, more, base): the rows (key, more, base) of a part of the keys together, some at a time; parts count from ``first``."""
    own = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("keys", "more", "base"))])

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        key, more, base = (rows[c].to_numpy() for c in ("key", "more", "base"))
        order, _ = in_order(key)
        key, more, base = key[order], more[order], base[order]
        return in_rows([(first + part, *(by_place(x[low:high]) for x in (key, more, base))) for part, low, high in cuts(key, bits)], own)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > _HELD:
                yield out(held)
                held = []
        if held:
            yield out(held)

    return given.select("key", "more", "base").mapInArrow(packed, "part int, keys binary, more binary, base binary")


def corrections(encoded: DataFrame, weights: DataFrame, tail: DataFrame, total: int) -> DataFrame:
    """(_row, more, base, known): the sum of the weights of the runs in each text, and of what ``tail`` (key, more, base)
    has for its words beyond the head.

    A lot of documents asks each part of the keys once, each key once for all its documents, and is answered
    with sums for each document. Its own row, in parts below 0, has the documents and the sums of what was sent.
    """
    bits = parts_of(total, _LOOKED_UP)
    fast_least = head_threshold(weights, FAST)
    fast = weights.where(F.col("count") >= fast_least).select("key", "value").toArrow()
    key, value = fast["key"].to_numpy(), fast["value"].to_numpy()
    order = np.argsort(key)
    sent = encoded.sparkSession.sparkContext.broadcast((sieve_of(weights, _LOOKUP_CELLS), key[order], value[order]))
    del fast, key, value, order
    asks = pa.schema([("part", pa.int32()), ("lot", pa.int64()), *((c, pa.binary()) for c in ("keys", "times", "docs", "given"))])
    answers = pa.schema([("part", pa.int32()), ("lot", pa.int64()), *((c, pa.binary()) for c in ("docs", "more", "base", "known"))])

    def out(held: list[tuple[np.ndarray, np.ndarray, list, list]]) -> pa.RecordBatch:
        rows, given, *asked = zip(*held)
        rows, lot = np.concatenate(rows), int(rows[0][0])
        found = [(-1 - lot % (1 << bits), lot, by_place(rows), b"", b"", by_place(np.concatenate(given)))]
        for first, own in zip((0, 1 << bits), asked):
            doc, key = (np.concatenate(x) for x in zip(*(pair for some in own for pair in some)))
            order, at = in_order(key)
            doc, key, at = doc[order].astype("<u2"), key[order[at]], np.append(at, len(order))
            for part, low, high in cuts(key, bits):
                times = np.diff(at[low : high + 1]).astype("<u4")
                found.append((first + part, lot, by_place(key[low:high]), by_place(times), by_place(doc[at[low] : at[high]]), b""))
        return in_rows(found, asks)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, fast, value = sent.value
        held, docs, size = [], 0, 0
        for batch in batches:
            for at in range(0, len(batch), _DOCS):
                part = batch.slice(at, _DOCS)
                ids, rows = ids_in(part), part.column("_row").to_numpy()
                starts = np.flatnonzero(ids == START)
                doc = docs + np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(ids))))
                more = np.zeros(len(ids))
                beyond = np.flatnonzero(ids >= _TAIL)
                words, asked = [(doc[beyond], _step(None, ids[beyond], 0))], []
                for key, ok in runs(ids, DEPTH + 1):
                    some = np.flatnonzero(ok & passes(sieve, key))
                    some = some[np.argsort(key[some])]  # a search in order keeps to the processor's cache
                    own = key[some]
                    place = np.minimum(np.searchsorted(fast, own), max(len(fast) - 1, 0))
                    known = fast[place] == own if len(fast) else np.zeros(len(own), bool)
                    more[some[known]] += value[place[known]]
                    asked.append((doc[some[~known]], own[~known]))
                held.append((rows, np.add.reduceat(more, starts), asked, words))
                docs, size = docs + len(rows), size + sum(len(key) for _, key in asked + words)
                if size > _HELD or docs > _LOT:
                    yield out(held)
                    held, docs, size = [], 0, 0
        if held:
            yield out(held)

    def answer(asked: pa.Table, given: pa.Table) -> pa.Table:
        key, more, base = (np.concatenate([np.zeros(0, of), *from_places(given[c], of)]) for c, of in (("keys", "<i8"), ("more", "<f8"), ("base", "<f8")))
        order, _ = in_order(key)
        key, more, base = key[order].view(np.uint64), more[order], base[order]
        columns = (from_places(asked[c], of) for c, of in (("keys", "<u8"), ("times", "<u4"), ("docs", "<u2"), ("given", "<f8")))
        found = []
        for part, lot, own, times, doc, sums in zip(asked["part"].to_pylist(), asked["lot"].to_pylist(), *columns):
            if part < 0:
                found.append((part, lot, by_place(own), by_place(sums), b"", b""))
                continue
            place = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
            met = key[place] == own if len(key) else np.zeros(len(own), bool)
            some = np.repeat(met, times)
            place, doc = np.repeat(place[met], times[met]), doc[some]
            known = np.bincount(doc)
            docs = np.flatnonzero(known)
            if len(docs):
                sums = [by_place(x[docs]) for x in (np.bincount(doc, more[place]), np.bincount(doc, base[place]), known)] if part >= 1 << bits else [by_place(np.bincount(doc, more[place])[docs]), b"", b""]
                found.append((part, lot, by_place(docs.astype("<u2")), *sums))
        return pa.Table.from_batches([in_rows(found, answers)])

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")  # sums of equal texts are equal to the last bit
        docs, more, base, known = rows["docs"], *(from_places(rows[c], of) for c, of in (("more", "<f8"), ("base", "<f8"), ("known", "<i8")))
        own = from_places(docs.slice(0, 1), "<i8")[0]
        sums = [more[0], np.zeros(len(own)), np.zeros(len(own), np.int64)]
        for i, at in enumerate(from_places(docs.slice(1), "<u2"), 1):
            for total, x in zip(sums, (more[i], base[i], known[i])):
                if len(x):
                    total[at] += x
        return pa.table(dict(zip(("_row", "more", "base", "known"), (own, *sums))))

    met = encoded.select("_row", *IDS).mapInArrow(ask, "part int, lot long, keys binary, times binary, docs binary, given binary")
    slow = weights.where(F.col("count") < fast_least).select("key", F.col("value").alias("more"), F.lit(0.0).alias("base"))
    given = in_parts(slow, bits, 0).unionByName(in_parts(tail, bits, 1 << bits))
    both = met.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(answer, "part int, lot long, docs binary, more binary, base binary, known binary")
    return both.groupBy("lot").applyInArrow(summed, "_row long, more double, base double, known long")


def head_threshold(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows reach, from how many have each count."""
    by_count = {r["count"]: r["rows"] for r in counts.groupBy("count").agg(F.count(F.lit(1)).alias("rows")).collect()}
    reached, least = 0, max(by_count, default=0) + 1
    for n in sorted(by_count, reverse=True):
        reached += by_count[n]
        if reached > most:
            break
        least = n
    return least


def scored(docs: DataFrame, taught: Column, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id unless given), n_tokens, n_known, train_tokens, base_score and score.

    Rows are joined back by a number of their own, so any columns may repeat.
    """
    keep = keep or ["doc_id"]
    named = docs.select(*keep, F.col("text"), F.coalesce(taught, F.lit(False)).alias("taught"))
    counts = written(word_counts(named.where("taught")), "words")
    ends = named.where("taught").count()
    total, kinds, single = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("count") == 1)).first()
    total, kinds, single = total + ends, kinds + (ends > 0), single + (ends == 1)
    least = max(LEAST_COUNT, math.ceil(LEAST_SHARE * total))
    head_least = head_threshold(counts, HEAD)
    head = counts.where(F.col("count") >= head_least).toArrow().sort_by([("count", "descending"), ("word", "ascending")])
    by_id = np.concatenate([[ends, ends, 0], head["count"].to_numpy()]).astype(float)
    spared = min(0.95, max(0.05, single / kinds)) if kinds else 0.5
    base = lambda c: np.log10((c + 1) / (total + kinds + 1))
    root = lambda c: np.log10(np.where(c > 0, np.maximum(c - spared, 1e-9), spared * max(kinds, 1)) / max(total, 1))
    head_words = head["word"].combine_chunks()
    del head
    base_by_id, root_by_id = base(by_id), root(by_id)  # a rare word counts as unknown until the join
    base_by_id[START] = root_by_id[START] = 0.0
    known_by_id = by_id > 0
    known_by_id[[START, RARE]] = False

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 2 << 20):
            texts = [tokens(text) for text in batch.column("text").to_pylist()]
            words, n = list(chain.from_iterable(texts)), np.array([len(own) for own in texts])
            own = pc.index_in(pa.array(words, pa.binary()), value_set=words_sent.value).fill_null(RARE - _FIRST_WORD).to_numpy() + _FIRST_WORD
            starts = np.cumsum(n + 2) - n - 2
            ids, within = np.empty(len(words) + 2 * len(n), np.int32), np.ones(len(words) + 2 * len(n), bool)
            ids[starts], ids[starts + n + 1] = START, END
            within[starts] = within[starts + n + 1] = False
            ids[within] = own
            rare = np.flatnonzero(own == RARE)
            tails = np.array(tail_ids(words[i] for i in rare.tolist()), "<i8")
            n_tails = np.bincount(np.repeat(np.arange(len(n)), n)[rare], minlength=len(n))
            known, base, root = (np.add.reduceat(x[ids], starts) for x in (known_by_id.astype(np.int64), base_by_id, root_by_id))
            yield extended(
                batch, [*keep, "taught"], n_tokens=pa.array(n + 1), n_known=pa.array(known), base=pa.array(base), root=pa.array(root),
                low=bytes_in_rows(ids.astype("<u2"), n + 2), high=bytes_in_rows((ids >> 16).astype("u1"), n + 2), tails=bytes_in_rows(tails, n_tails),
            )

    schema = schema_of(named, [*keep, "taught"], "n_tokens long, n_known long, base double, root double, low binary, high binary, tails binary")
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of the words, as runs of one token and as words of the tail."""
        id_of = {w: i for i, w in enumerate(words_sent.value.to_pylist(), _FIRST_WORD)}
        for batch in batches:
            words = batch.column("word").to_pylist()
            ids = np.array([id_of.get(w) or tail for w, tail in zip(words, tail_ids(words))], np.int64)
            keys = [pa.array(_step(None, ids, length)) for length in (1, 0)]
            yield pa.record_batch([*keys, batch.column("count")], ["key", "word_key", "count"])

    with sent_to_tasks(docs.sparkSession, head_words) as words_sent:
        encoded = written(named.mapInArrow(encode, schema).withColumn("_row", F.monotonically_increasing_id()), "encoded")
        word_keys = written(counts.select("word", "count").mapInArrow(keyed, "key long, word_key long, count long"), "word_keys")
    del head_words
    ends_keys = _step(None, np.array([START, END]), 1).tolist() if ends else []
    singles = word_keys.select("key", "count").unionByName(docs.sparkSession.createDataFrame([(k, ends) for k in ends_keys], "key long, count long"))
    log_base = F.log10((F.col("count") + 1) / float(total + kinds + 1)) - float(base(np.array(0.0)))
    log_root = F.log(F.greatest(F.col("count") - spared, F.lit(1e-9)) / max(total, 1)) - float(root(np.array(0.0))) * math.log(10)
    tail = word_keys.where(F.col("count") < head_least).select(
        F.col("word_key").alias("key"), log_root.alias("more"), log_base.alias("base")
    )
    more = corrections(encoded, weights_of(encoded, singles, least, spared, total), tail, total).withColumnsRenamed({"base": "r_base", "known": "r_known"})
    both = joined(encoded.drop(*IDS), more, ["_row"])
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    nothing = F.lit(total == 0)
    return both.select(
        *keep,
        "n_tokens",
        plus("n_known", "r_known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "r_base").alias("base_score"),
        F.when(nothing, 0.0).otherwise(F.col("root") + F.col("more") / math.log(10)).alias("score"),
    )
