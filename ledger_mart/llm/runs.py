"""Stretches of words that repeat with a period, found by string synchronising sets.

At each scale t = 4, 8, 16, ... a position is chosen if the least hash among the t-word substrings that
start in the t + 1 places from it on is that of the first or the last of them. Whether a position is
chosen depends on the 2 t words from it on alone, so a run's period carries chosen positions to chosen
positions of equal context; pairs of equal context at a distance from 1.5 t to 3 t propose that distance as a
period. Substrings inside highly periodic regions (period of t / 3 at most) have no part in
the choice, which keeps the chosen positions some t / 3 apart; those small periods come from smaller
scales, and the least of all (up to 5) from comparing the text with itself shifted. A run of
three periods or more always holds a chosen position whose context recurs one period later, or
else it would lie in a highly periodic region and have a smaller period.

Each proposal is extended word by word to the longest stretch that keeps the period, so what is
reported is exact, whatever the hashes.

Defined results: null, empty and blank texts have no words and no run, and an empty collapsed text; a run of
runs is reported with its smallest period; rows that share an id are worked on one by one, a row
without id as well; an empty table gives no rows; columns that are not asked for are not read. A document is
worked on in one task, in memory of some hundred bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_mart.llm.common import extended, in_slices, schema_of

LEAST_WORDS, LEAST_PERIODS = 24, 3
_SHIFTS = 5  # periods found by shifting; the first scale's pairs begin at 6
_FIRST_SCALE = 4
_LOT_WORDS = 1 << 16
_NONE = np.uint64(2**64 - 1)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]

Run = tuple[int, int, int]  # start, length, period


def _mixed(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the stretches of True."""
    edge = np.diff(np.r_[False, same, False].view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _first_difference(x: np.ndarray, at: int, shift: int, way: int) -> int:
    """How many places from ``at`` on, forwards (1) or backwards (-1), equal those ``shift`` further on."""
    n, step = 0, 32
    while True:
        if way > 0:
            low, high = at + n, min(at + n + step, len(x) - shift)
        else:
            low, high = max(0, at - n - step), at - n
        if low >= high:
            return n
        differ = x[low:high] != x[low + shift : high + shift]
        found = np.flatnonzero(differ)
        if len(found):
            return n + int(found[0] if way > 0 else len(differ) - 1 - found[-1])
        n, step = n + high - low, step * 2


def _chosen(least: np.ndarray, scale: int, periodic: list[Run]) -> np.ndarray:
    """Positions of the synchronising set, from the hashes of the substrings of ``scale`` words."""
    inside = np.zeros(len(least) + 1, np.int32)
    for start, length, period in periodic:
        if 3 * period <= scale <= length:
            inside[start] += 1
            inside[start + length - scale + 1] -= 1
    value = np.where(np.cumsum(inside[:-1]) > 0, _NONE, least)
    low, width = value, 1
    while width < scale:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:-1], low[1:])
    return np.flatnonzero(((low == value[: len(low)]) | (low == value[scale:])) & (low != _NONE))


def _pairs(place: np.ndarray, context: np.ndarray, scale: int) -> Iterator[tuple[int, int]]:
    """(distance, place) of the places of equal context that are 1.5 to 3 scales apart, ascending."""
    order = np.lexsort((place, context))
    place, context = place[order], context[order]
    found = []
    for k in range(1, len(place)):
        apart = place[k:] - place[:-k]
        near = (context[k:] == context[:-k]) & (apart < 3 * scale)
        if not near.any():
            break
        near &= 2 * apart >= 3 * scale
        found.append(np.stack([apart[near], place[:-k][near]]))
    if found:
        both = np.concatenate(found, axis=1)
        yield from zip(*both[:, np.lexsort((both[1], both[0]))].tolist())


def runs_of_symbols(x: np.ndarray, longest: int, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> list[Run]:
    """All runs (start, length, period) of ``times`` (3 at least) periods and ``least`` symbols, none longer
    than ``longest``, in ascending order."""
    if times < 3:
        raise ValueError("pairs of equal context propose every period of runs of three periods or more only")
    regions: dict[tuple[int, int], int] = {}

    def region(start: int, end: int, period: int) -> None:
        regions[start, end] = min(period, regions.get((start, end), period))

    for p in range(1, min(_SHIFTS, len(x) - 1) + 1):
        for start, end in zip(*(e.tolist() for e in _stretches(x[p:] == x[:-p]))):
            if end + p - start >= 3 * p:
                region(start, end + p, p)
    scale = _FIRST_SCALE
    hashes, width = _mixed(x.astype(np.uint64) + _MIX[2]), 1
    while scale * 3 // 2 * times <= longest and 2 * scale <= len(x):
        while width < scale:
            hashes, width = _mixed(hashes[:-width] * _MIX[2] + hashes[width:]), 2 * width
        contexts = _mixed(hashes[:-scale] * _MIX[2] + hashes[scale:])
        place = _chosen(hashes, scale, [(a, e - a, p) for (a, e), p in regions.items()])
        held = (0, 0)  # the last distance, and where its last stretch ends
        for distance, at in _pairs(place, contexts[place], scale):
            if distance == held[0] and at < held[1]:
                continue
            start = at - _first_difference(x, at, distance, -1)
            end = at + _first_difference(x, at, distance, 1)
            held = (distance, end)
            if end + distance - start >= 3 * distance:
                region(start, end + distance, distance)
        hashes, width, scale = contexts, 2 * scale, 2 * scale
    return sorted((a, e - a, p) for (a, e), p in regions.items() if e - a >= max(least, times * p))


def runs_of_texts(texts: Sequence[list[bytes]], least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> list[list[Run]]:
    """The runs of each list of words. Lists of like length are worked on together, with a symbol of its
    own between two of them, so that no run crosses."""
    found: list[list[Run]] = [[] for _ in texts]
    lot: list[int] = []
    order = sorted((i for i, words in enumerate(texts) if len(words) >= least), key=lambda i: len(texts[i]))
    size = 0
    for i in order:
        lot.append(i)
        size += len(texts[i]) + 1
        if size > _LOT_WORDS or i == order[-1]:
            _lot_runs(texts, lot, found, least, times)
            lot, size = [], 0
    return found


def _lot_runs(texts: Sequence[list[bytes]], lot: list[int], found: list[list[Run]], least: int, times: int) -> None:
    number: dict[bytes, int] = {}
    symbols: list[int] = []
    starts = []
    for k, i in enumerate(lot):
        starts.append(len(symbols))
        symbols += [number.setdefault(w, len(number)) for w in texts[i]]
        symbols.append(-1 - k)
    begin = np.array(starts)
    for start, length, period in runs_of_symbols(np.array(symbols, np.int64), len(texts[lot[-1]]), least, times):
        k = int(np.searchsorted(begin, start, side="right")) - 1
        found[lot[k]].append((start - starts[k], length, period))


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or (run[1] * best[2], -run[0], -run[2]) > (best[1] * run[2], -best[0], -best[2]):
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words, one space between them, with each run's first period only."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_DDL = "struct<start:long,length:long,period:long>"


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """The columns to keep, and of each text: ``n_words``; ``runs``, by start, then period; ``strongest``, the run
    of greatest length / period; ``collapsed``, the text's words with each run's first period only."""
    added = f"n_words long, runs array<{_DDL}>, strongest {_DDL}, collapsed binary"

    def named(run: Run | None) -> dict | None:
        return run and {"start": run[0], "length": run[1], "period": run[2]}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            # bytes.split parts at 9 to 13 and 32, no other white space
            texts = [(t or b"").split() for t in batch.column(batch.num_columns - 1).to_pylist()]
            runs = runs_of_texts(texts, least, times)
            yield extended(
                batch, keep,
                n_words=pa.array(map(len, texts), pa.int64()),
                runs=pa.array([[named(r) for r in rs] for rs in runs], pa.list_(_RUN)),
                strongest=pa.array([named(strongest(rs)) for rs in runs], _RUN),
                collapsed=pa.array([collapsed(t, rs) for t, rs in zip(texts, runs)], pa.binary()),
            )

    rows = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(found, schema_of(rows, keep, added)).withColumn("collapsed", F.col("collapsed").cast("string"))
