"""Spelling variants: words one code point apart, found through a variable-length gram index.

A dictionary of grams comes from the words themselves: a gram is made longer only while it is frequent, so frequent
beginnings lead to long grams and rare ones stay short. A word is decomposed into the dictionary's longest gram at
each of its places (with marks at both ends). Which gram that is depends on the gram's own characters
alone, so an edit affects those grams only that hold its place; the most that any place is held by bounds how many
grams one edit can affect, word by word. Words one edit apart share all others, at places that are equal or, behind
an inserted or deleted character, one apart. So of each word only the lists of its rarest grams, one more than that
bound, are merged, kept apart by place and length, and members of a common list are verified.

A gram is at most as long as the shorter of two words, so that one gram always stays unaffected and no
word needs another way. Long lists are dealt into blocks, and each pair of blocks is a group of its own.

Defined results: words are compared by code points, whatever they are; null and empty words are left out; a
word given in several rows is one word with the sum of its counts; words of fewer than LEAST_LENGTH code points are
an error, as the bound doesn't hold for them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_mart.llm.common import joined, small, written
from ledger_mart.llm.partenum import mixed

LEAST_LENGTH = 3
SHORTEST, LONGEST = 2, 6  # of grams
#: A gram is frequent above this many places of words, and above a share of all places: so no more than
#: SHARES grams of a length are, at any size.
FREQUENT, SHARES = 200, 100_000
_HELD = 300_000  # gram counts that a task sums up before it sends them on
_BLOCK = 1024
_START, _END = "\x02", "\x03"


def marked(word: str) -> str:
    return f"{_START}{word}{_END}"


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """Counts of the frequent grams shorter than LONGEST; as many as SHARES for each length at most."""
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)

        for batch in batches:
            for word in batch.column("word").to_pylist():
                text = marked(word)
                for size in range(SHORTEST, LONGEST):
                    counts.update(text[i : i + size] for i in range(len(text) - size + 1))
                if len(counts) > _HELD:
                    yield batch_of()
                    counts.clear()
        yield batch_of()

    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    grams = words.select("word").mapInArrow(counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in grams.where(F.col("n") > max(FREQUENT, places // SHARES)).collect()}


def decomposed(text: str, cap: int, frequent: dict[str, int]) -> list[str]:
    """The dictionary's longest gram at each place of a marked word, none longer than ``cap``."""
    found = []
    for place in range(len(text) - 1):
        end = place + SHORTEST
        most = min(place + cap, len(text))
        while end < most and text[place:end] in frequent:
            end += 1
        found.append(text[place:end])
    return found


def affected(grams: list[str]) -> int:
    """The most grams that an edit at any one place can affect: those that hold it."""
    change = [0] * (len(grams) + LONGEST + 2)
    for place, gram in enumerate(grams):
        change[place] += 1
        change[place + len(gram)] -= 1
    most = held = change[0]
    for place in range(1, len(grams)):  # the marks at both ends are never edited
        held += change[place]
        most = held if place == 1 else max(most, held)
    return most


def listed(grams: list[str], frequent: dict[str, int]) -> list[tuple[str, int]]:
    """The rarest grams with their places: one more than an edit can affect. The order depends on the gram
    first and its place last, so it is the same in any two words."""
    order = sorted(range(len(grams)), key=lambda i: (frequent.get(grams[i], 0), -len(grams[i]), grams[i], i))
    return [(grams[i], i) for i in order[: affected(grams) + 1]]


def entries(word: str, frequent: dict[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """(gram, place, length, longer): the lists a word is in, as one of words of ``length`` (longer is 0), or as one that
    is longer by a character than those (1), at both places that its gram can have in the shorter word."""
    text, n = marked(word), len(word)
    own = listed(decomposed(text, min(LONGEST, n), frequent), frequent)
    for gram, place in own:
        yield gram, place, n, 0
    if min(LONGEST, n - 1) < min(LONGEST, n):
        own = listed(decomposed(text, min(LONGEST, n - 1), frequent), frequent)
    for gram, place in own:
        yield gram, place, n - 1, 1
        if place:
            yield gram, place - 1, n - 1, 1


def gram_lists(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """(list, longer, word, n) for each list a word is in."""
    sent = words.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("list", pa.int64()), ("longer", pa.int8()), ("word", pa.string()), ("n", pa.int64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                name, place, longer, length, row = [], [], [], [], []
                for i, word in enumerate(part.column("word").to_pylist()):
                    for gram, at, n, more in entries(word, known):
                        name.append(xxhash.xxh64_intdigest(gram))
                        place.append(at)
                        length.append(n)
                        longer.append(more)
                        row.append(i)
                key = mixed(np.array(name, np.uint64) + np.array(place, np.uint64), 21)
                key = mixed(key + np.array(length, np.uint64), 22).view(np.int64)
                own = part.take(pa.array(row, pa.int32()))
                yield pa.record_batch([pa.array(key), pa.array(longer, pa.int8()), own.column("word"), own.column("n")], schema=schema)

    return words.select("word", "n").mapInArrow(made, "list long, longer byte, word string, n long")


def in_blocks(lists: DataFrame) -> DataFrame:
    """The lists' rows with the pair of blocks (low, high) in which they are compared, and their own block."""
    many = lists.groupBy("list").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > _BLOCK)
    many = small(written(many.select("list", F.ceil(F.col("_m") / _BLOCK).cast("int").alias("_blocks")), "long_lists"))
    dealt = joined(lists, many, ["list"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "longer", "word", "n")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row for each word, and lengths."""
    length = np.array([len(w) for w in words])
    wide = max(1, int(length.max()))
    codes = np.array(words, dtype=f"U{wide}").view(np.uint32).reshape(len(words), wide)
    return (codes.astype(np.uint8) if codes.max() < 256 else codes), length


def near(x: np.ndarray, x_length: np.ndarray, y: np.ndarray, y_length: np.ndarray) -> np.ndarray:
    """Whether words, row by row, differ by exactly one inserted, deleted or replaced code point."""
    wide = max(x.shape[1], y.shape[1])
    x, y = (np.pad(a, ((0, 0), (0, wide - a.shape[1]))) if a.shape[1] < wide else a for a in (x, y))
    same = x == y
    level = x_length == y_length
    found = level & (same.sum(axis=1) == wide - 1)
    # one inserted: what is equal in front, and equal behind when shifted by one, covers the shorter word
    at = np.flatnonzero(np.abs(x_length - y_length) == 1)
    if len(at):
        less = (x_length < y_length)[at, None]
        short, long = np.where(less, x[at], y[at]), np.where(less, y[at], x[at])
        size = np.minimum(x_length, y_length)[at]
        beyond = np.arange(wide) >= size[:, None]
        front = np.logical_and.accumulate(same[at] & ~beyond, axis=1).sum(axis=1)
        shifted = np.zeros_like(same[at])
        shifted[:, :-1] = short[:, :-1] == long[:, 1:]
        back = np.logical_and.accumulate((shifted | beyond)[:, ::-1], axis=1).sum(axis=1) - (wide - size)
        found[at] = front + back >= size
    return found


def halves(words: list[str], longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the front and back halves of words of one list. An edit lies in one of a word's halves at most, so near
    words agree in the other; half of what, the length of the list's words says."""
    half = [(len(w) - more) // 2 for w, more in zip(words, longer.tolist())]
    parts = ([w[:h] for w, h in zip(words, half)], [w[len(w) - h :] for w, h in zip(words, half)])
    return tuple(np.fromiter(map(hash, part), np.int64, len(words)) for part in parts)


def _group_pairs(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of each group [start, end), some at a time. Groups follow each other, the first from 0 on."""
    size = end - start
    most = int(size.max()) if len(size) else 0
    row, last = np.arange(int(size.sum())), np.repeat(end, size)
    lots: list[np.ndarray] = []
    held = 0
    for k in range(1, most):
        keep = row + k < last
        row, last = row[keep], last[keep]
        lots.append(np.stack([row, row + k]))
        held += len(row)
        if held > 200_000 or k == most - 1:
            yield tuple(np.concatenate(lots, axis=1))
            lots, held = [], 0


def near_pairs(lists: DataFrame) -> DataFrame:
    """(word, near, n, near_n) of the words of one list that are one edit apart, ``word`` before ``near``."""
    key = ["list", "low", "high"]
    dealt = in_blocks(lists).repartition(*key).sortWithinPartitions(*key)
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("n", pa.int64()), ("near_n", pa.int64())])

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows in tables that end where a group does."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(k).to_numpy() for k in key]
            same = np.logical_and.reduce([name == name[-1] for name in names])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            end = tuple(name[-1] for name in names)
            if cut or end != last:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)], schema=batch.schema)
                held = []
            held.append(batch.slice(cut))
            last = end
        if held:
            yield pa.Table.from_batches(held)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            if rows.num_rows < 2:
                continue
            names = [rows.column(k).to_numpy() for k in key]
            first = np.r_[True, np.logical_or.reduce([name[1:] != name[:-1] for name in names])]
            start = np.flatnonzero(first)
            end = np.r_[start[1:], rows.num_rows]
            several = end - start > 1
            if not several.any():
                continue
            keep = np.repeat(several, end - start)
            rows = rows.filter(pa.array(keep))
            size = (end - start)[several]
            end = np.cumsum(size)
            longer, own = rows.column("longer").to_numpy(), rows.column("own").to_numpy()
            apart = rows.column("low").to_numpy() != rows.column("high").to_numpy()
            words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
            codes, length = _codes(words)
            front, back = halves(words, longer)
            for i, j in _group_pairs(end - size, end):
                # two that are longer are compared in the lists of their own length; two blocks are held against each other
                pick = ((longer[i] == 0) | (longer[j] == 0)) & (~apart[i] | (own[i] != own[j]))
                pick &= (front[i] == front[j]) | (back[i] == back[j])
                i, j = i[pick], j[pick]
                hit = near(codes[i], length[i], codes[j], length[j])
                found = set()
                for a, b in zip(i[hit].tolist(), j[hit].tolist()):
                    a, b = (a, b) if words[a] < words[b] else (b, a)
                    found.add((words[a], words[b], n[a], n[b]))
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return dealt.mapInArrow(compared, "word string, near string, n long, near_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow from each word of (word, form). A form's count is twice a
    word's at least, so a chain is short and has no circle; each round doubles the step."""
    found = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = small(found.select(F.col("word").alias("root"), F.col("root").alias("_next")))
        step = written(joined(found, further, ["root"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        found = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return found


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n).

    ``n_near`` counts the words one edit apart; ``form`` is the most frequent of them (ties: the first in code-point
    order) if it is ``times`` as frequent as the word, and ``root`` where following forms ends.
    """
    words = written(words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    if not words.where(F.length("word") < LEAST_LENGTH).isEmpty():
        raise ValueError(f"words of fewer than {LEAST_LENGTH} code points may share no gram with words near them")
    lists = written(gram_lists(words, frequent_grams(words)), "lists")
    pairs = near_pairs(lists)
    sides = [F.struct(F.col(w).alias("word"), F.col(o).alias("near"), F.col(m).alias("near_n")) for w, o, m in (("word", "near", "near_n"), ("near", "word", "n"))]
    both = pairs.select(F.explode(F.array(*sides)).alias("side")).select("side.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    best = best.select("word", "n_near", F.col("_best.near").alias("form"), (-F.col("_best.less")).alias("form_n"))
    enough = F.col("form_n") >= times * F.col("n")
    formed = joined(words, best, ["word"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"),
    )
    formed = written(formed, "formed")
    found = small(roots(formed.where("form is not null")))
    return joined(formed, found, ["word"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
