"""Joining documents by the Jaccard similarity of their word shingles, with PartEnum signatures.

Sizes fall into bands, so that like sets lie in one band or in two that follow each
other. Within a band, like sets differ in at most ``distance`` shingles. The domain of
shingles is cut into parts and each part into inner parts; like sets agree, in at least
one part, on all but a few inner parts. A signature is the hash of a set's shingles in
one choice of inner parts, and all choices are enumerated, so like sets share one.

Equal sets are one class. In each bucket of a signature every class is held against the
bucket's centre, by the exact sets; classes that this leaves in different components are
then held against each other, in blocks. So a group of near copies costs pairs in
proportion to its size, and no link is lost.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; with fewer
words than a shingle has, the whole sequence is one; rows that share an id belong
together; a row without id gets the component of its class, if another row gives it one;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_mart.llm.common import SMALL_ROWS, extended, in_slices, joined, kept, small, written

_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]
_SALTED = 500  # members of a centre that one group holds at most, or about so
_SEEN = 200_000
_LOT_BYTES = 1 << 20
_KEPT_POWERS = 2 * _LOT_BYTES - 1
_BLOCK = 512  # members of a centre whose texts are compared with each other at once, or with as many more
_SKETCH_BLOCK = 4096  # the same for sketches, which are a tenth of the size or less
_COLUMNS = 2048  # shingles of a presence matrix, a row for each member of two blocks


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the public splitmix64 finaliser)."""
    x = x + np.uint64(seed * int(_MIX[2]) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    both = [np.ones(n, np.uint64) for _ in range(2)]
    for array, x in zip(both, (base, pow(base, -1, 2**64))):
        array[1:] = np.uint64(x)
        np.multiply.accumulate(array, out=array)
    return both[0], both[1]


def kept_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers or more; those of a longer text than a lot are not kept."""
    if n > _KEPT_POWERS:
        return _powers(n)
    held = kept("partenum", "powers", list)
    if not held or len(held[0]) < n:
        held[:] = _powers(1 << max(16, n.bit_length()))
    return held[0], held[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words, A-Z as lower case.

    A word's hash is a polynomial in its bytes, each replaced by a random number, taken
    from running sums over all of them.
    """
    byte = np.frombuffer(data, np.uint8)
    power, inverse = kept_powers(len(data))
    spaces, value = kept("partenum", "bytes", _byte_tables)
    space = np.r_[True, spaces[byte], True]
    starts = np.flatnonzero(space[:-2] & ~space[1:-1])
    ends = np.flatnonzero(~space[1:-1] & space[2:]) + 1
    sums = np.zeros(len(byte) + 1, np.uint64)
    np.cumsum(value[byte] * power[: len(byte)], out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * inverse[starts], 1)


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    value = mixed(np.arange(256, dtype=np.uint64), 101)
    value[65:91] = value[97:123]
    return space, value


def shingle_sets(texts: Sequence[str | None], words: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles; texts are worked on together."""
    found: list[np.ndarray] = []
    lot: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        lot.append((text or "").encode())
        size += len(lot[-1])
        if size > _LOT_BYTES or i == len(texts) - 1:
            found += _lot_sets(lot, words)
            lot, size = [], 0
    return found


def _lot_sets(lot: list[bytes], words: int) -> list[np.ndarray]:
    starts, hashes = word_hashes(b"\n".join(lot))
    ends = np.cumsum([len(x) + 1 for x in lot])
    bounds = np.r_[0, np.searchsorted(starts, ends)]

    def runs(hashes: np.ndarray, size: int) -> np.ndarray:
        n = max(0, len(hashes) - size + 1)
        found = np.full(n, size, np.uint64)
        for i in range(size):
            found = mixed(found * _MIX[2] + hashes[i : i + n], i + 1)
        return found

    whole = runs(hashes, words)
    sets = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if z - a >= words:
            own = np.sort(whole[a : z - words + 1])
            sets.append(own[np.r_[True, own[1:] != own[:-1]]])
        else:
            sets.append(runs(hashes[a:z], z - a) if z > a else hashes[:0])
    return sets


class Bands:
    """The bands of sizes and the cuts of the domain for a similarity of ``percent``."""

    def __init__(self, percent: int):
        self.percent, self.most = percent, [0]

    def of(self, size: int) -> int:
        while self.most[-1] < size:
            self.most.append((self.most[-1] + 1) * 100 // self.percent)
        return bisect_left(self.most, size)

    def cut(self, band: int) -> tuple[int, int, list[tuple[int, ...]], int] | None:
        """Parts, inner parts, the choices of inner parts, and spare parts; None if like sets are equal.

        A part in which sets differ in at most ``misses`` shingles has a choice that avoids
        them. At most distance // (misses + 1) parts are worse, and ``spare`` parts more than
        needed are kept, for parts that are empty.
        """
        while len(self.most) <= band:
            self.of(self.most[-1] + 1)
        distance = 2 * self.most[band] * (100 - self.percent) // (100 + self.percent)
        if distance == 0:
            return None
        if distance <= 3:
            return 1, distance + 3, list(combinations(range(distance + 3), 3)), 0
        spare = 2 if self.percent >= 85 else 8
        return distance // 2 + 1 + spare, 3, list(combinations(range(3), 2)), spare

    def signatures(self, sets: list[np.ndarray], band: int) -> list[np.ndarray]:
        """Signatures of sets for a band, their own or the next.

        Empty choices would gather unrelated sets. Like sets agree in one part more than there are spare parts, so a set leaves out
        its empty choices if no more than the spare parts have one; whatever the other set leaves out, they agree on a choice
        that isn't empty. A set with more of them leaves out those of half as many parts: two such sets leave out no
        more than the spare parts together.
        """
        cut = self.cut(band)
        if cut is None or not sets:
            return [np.zeros(0, np.uint64)] * len(sets)
        parts, inner, choices, spare = cut
        x = np.concatenate(sets)
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = mixed(x, 1000 + band)
        cell = (own * parts + (place >> np.uint64(32)).astype(np.int64) % parts) * inner + (place & np.uint64(0xFFFFFFFF)).astype(np.int64) % inner
        sums = np.zeros(len(sets) * parts * inner, np.uint64)
        np.add.at(sums, cell, mixed(x, 7))
        sums = sums.reshape(len(sets), parts, inner)
        chosen = np.stack([sums[:, :, list(c)].sum(axis=2, dtype=np.uint64) for c in choices], axis=2)
        empty = chosen == 0
        some = empty.any(axis=2)
        drop = empty & ((some.sum(axis=1) <= spare)[:, None] | (np.cumsum(some, axis=1) <= spare // 2))[:, :, None]
        name = np.arange(parts * len(choices), dtype=np.uint64).reshape(1, parts, -1) + np.uint64((band + 1) << 32)
        found = mixed(chosen + mixed(name, 11), 13)
        return [f[~d] for f, d in zip(found.reshape(len(sets), -1), drop.reshape(len(sets), -1))]


def set_classes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, class): documents with equal sets have equal class, the set's hash; null if empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            classes = [name if len(s) else None for s, name in zip(sets, classes_of(sets))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(classes, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(hashed, "doc_id long, n_shingles long, class long")


def classes_of(sets: list[np.ndarray]) -> list[int]:
    """A hash of each set; of the empty one too."""
    length = np.array([len(s) for s in sets], np.uint64)
    sums = np.zeros(len(sets) + 1, np.uint64)
    if sets:
        running = np.cumsum(np.r_[np.zeros(1, np.uint64), mixed(np.concatenate(sets), 3)], dtype=np.uint64)
        sums = running[np.r_[0, np.cumsum(length.astype(np.int64))]]
    return mixed(np.diff(sums) + length * _MIX[2], 5).view(np.int64).tolist()


def class_signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(signature, class, n) for every class; a class that several tasks meet comes from each of them."""
    schema = pa.schema([("signature", pa.int64()), ("class", pa.int64()), ("n", pa.int32())])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in in_slices(batches, _LOT_BYTES):
            by_band: dict[int, list[tuple[int, np.ndarray]]] = {}
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            for name, own in zip(classes_of(sets), sets):
                if len(own) and name not in seen:
                    seen = {name} if len(seen) > _SEEN else seen
                    seen.add(name)
                    for band in (bands.of(len(own)), bands.of(len(own)) + 1):
                        by_band.setdefault(band, []).append((name, own))
            for band, named in by_band.items():
                names, sets = zip(*named)
                found = bands.signatures(list(sets), band)
                many = [len(f) for f in found]
                if sum(many):
                    yield pa.record_batch([
                        pa.array(np.concatenate(found).view(np.int64)),
                        pa.array(np.repeat(np.array(names, np.int64), many)),
                        pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), many)),
                    ], schema=schema)

    return docs.select("text").mapInArrow(signed, "signature long, class long, n int")


def sketch(found: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of its cells, two to four on average; empty if
    a count is beyond a byte."""
    bits = max(4, (len(found) // 4).bit_length())
    counts = np.bincount((mixed(found, 17) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def folded(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(size, -1).sum(axis=1, dtype=np.uint16)


def may_be_like(x: tuple[int, bytes], y: tuple[int, bytes], percent: int) -> bool:
    """Whether the sizes and sketches allow for it: sets share no more than the lesser count of each cell."""
    (n, a), (m, b) = x, y
    if not a or not b:
        return True
    size = min(len(a), len(b))
    both = min(int(np.minimum(folded(a, size), folded(b, size)).sum()), n, m)
    return 100 * both >= percent * (n + m - both)


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(class, n, sketch) of rows (class, text)."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            yield extended(batch, ["class"], n=pa.array(map(len, sets), pa.int64()), sketch=pa.array(map(sketch, sets), pa.binary()))

    return texts.mapInArrow(made, "class long, n long, sketch binary")


def _held_against(pairs: DataFrame, kept_of: DataFrame, read: Callable, alike: Callable) -> DataFrame:
    """The pairs (a, b) that are alike by what ``kept_of`` has of their classes.

    That goes where the pair's b is compared; a class b with many partners is compared in
    several groups. Groups are read row by row, b first, so that memory holds one of each side.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / _SALTED).cast("int").alias("salts"))
    salted = joined(pairs, many, ["b"])
    members = salted.select(F.col("a").alias("class"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    centres = many.select(F.col("b").alias("class"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    dealt = (
        joined(members.unionByName(centres), kept_of, ["class"])
        .repartition("b", "salt")
        .sortWithinPartitions("b", "salt", "role")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for batch in in_slices(batches, _LOT_BYTES):
            found = []
            for b, salt, role, a, own in zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "role", "class")), read(batch)):
                if role == 0:  # rows that share an id may give a class several texts
                    centres = [*centres, own] if at == (b, salt) else [own]
                    at = (b, salt)
                elif any(alike(own, centre) for centre in centres):
                    found.append((a, b))
            yield pa.record_batch([pa.array([pair[side] for pair in found], pa.int64()) for side in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(compared, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, sketched: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose exact sets are like enough; texts go only where sketches allow for it."""
    possible = _held_against(pairs, sketched, lambda rows: zip(rows.column("n").to_pylist(), rows.column("sketch").to_pylist()), lambda x, y: may_be_like(x, y, percent))
    return _held_against(
        written(possible, "possible"), texts, lambda rows: shingle_sets(rows.column("text").to_pylist(), words), lambda x, y: is_like(x, y, percent)
    )


def is_like(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def linked(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of sets alike enough that have different labels; of those that other pairs link
    already, not every one.

    Common shingles are counted by products of the sets' presence matrix, a range of
    shingles at a time.
    """
    size = np.array([len(s) for s in sets])
    item, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(item, kind="stable")
    item, of = item[order], of[order]
    first = np.r_[True, item[1:] != item[:-1]]
    shared = np.repeat(np.diff(np.r_[np.flatnonzero(first), len(item)]) > 1, np.diff(np.r_[np.flatnonzero(first), len(item)]))
    column = np.cumsum(first & shared) - 1
    column, of = column[shared], of[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, z = np.searchsorted(column, [start, start + _COLUMNS])
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        held[of[a:z], column[a:z] - start] = 1
        both += held @ held.T
    alike = (100 * both >= percent * (size[:, None] + size - both)) & (labels[:, None] < labels)
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(alike))):
        a, b = top(i), top(j)
        if a != b:
            root[a] = b
            found.append((i, j))
    return found


def dealt_in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Members (centre, class, label) with the pairs (low, high) of their centre's blocks that they are in."""
    many = members.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    each = joined(members, many, ["centre"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("centre", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "class", "label")


def verified_blocks(members: DataFrame, texts: DataFrame, sketched: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members (centre, class, label) of one centre that differ in label.

    A centre's members are dealt into blocks, and each pair of blocks is a group of its own, so
    that no task holds more than two blocks. Sketches go first; texts follow for those members
    that may be like another.
    """
    group = ["centre", "low", "high"]

    def promising(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", ignore_index=True)
        found = np.zeros(len(rows), bool)
        n, label, data = rows["n"].to_numpy(), rows["label"].to_numpy(), rows["sketch"].tolist()
        if not all(data):
            found[:] = True
        else:
            size = min(map(len, data))
            cells = np.stack([folded(x, size) for x in data])
            ends = np.searchsorted(n * percent, n * 100, side="right")  # the largest that may be like each
            for i, end in enumerate(ends.tolist()):
                both = np.minimum(cells[i], cells[i + 1 : end]).sum(axis=1)
                alike = (100 * both >= percent * (n[i] + n[i + 1 : end] - both)) & (label[i + 1 : end] != label[i])
                found[i + 1 : end] |= alike
                found[i] |= alike.any()
        return rows.loc[found, ["centre", "class", "label"]]

    of_sketches = joined(dealt_in_blocks(members, _SKETCH_BLOCK), sketched, ["class"])
    left = of_sketches.groupBy(*group).applyInPandas(promising, "centre long, class long, label long").distinct()
    left = dealt_in_blocks(written(left, "promising"), _BLOCK)

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(rows["text"].tolist(), words)
        name = rows["class"].to_numpy(np.int64)
        pairs = linked(sets, rows["label"].to_numpy(np.int64), percent) if len(sets) > 1 else []
        return pd.DataFrame([(name[i], name[j]) for i, j in pairs], columns=["a", "b"], dtype="int64")

    return joined(left, texts, ["class"]).groupBy(*group).applyInPandas(compared, "a long, b long").distinct()


def _joined_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([pd.DataFrame({"kind": [], "x": [], "y": []}, dtype="int64"), *batches])
    nodes, edges = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
    root = {x: x for x in nodes["x"].tolist()}
    label = dict(zip(nodes["x"].tolist(), nodes["y"].tolist()))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(edges["x"].tolist(), edges["y"].tolist()):
        a, b = top(a), top(b)
        root[a] = b
        label[b] = min(label[a], label[b])
    found = [(x, label[top(x)]) for x in root]
    yield pd.DataFrame(found, columns=["class", "label"], dtype="int64")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(class, label): the least label that edges (a, b) reach from each of ``nodes`` (class, label).

    Both are written tables. Up to SMALL_ROWS rows one task joins them up; beyond, it takes rounds
    of the neighbours' least label, then the label of that label's own node, until none
    changes. Each round is written, so lost executors cost one round at most.
    """
    if nodes.count() + edges.count() <= SMALL_ROWS:
        rows = nodes.selectExpr("0 as kind", "class as x", "label as y").unionByName(edges.selectExpr("1 as kind", "a as x", "b as y"))
        return written(rows.coalesce(1).mapInPandas(_joined_up, "class long, label long"), "labels")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = nodes.groupBy(F.col("label").alias("of")).agg(F.min("class").alias("class"))
    labels = nodes
    while True:
        near = joined(both.withColumnRenamed("a", "class"), labels, ["class"]).groupBy("b").agg(F.min("label").alias("near"))
        taken = joined(labels, near.withColumnRenamed("b", "class"), ["class"], "left").select("class", "label", F.least("label", "near").alias("new"))
        of_label = joined(own, taken.select("class", F.col("new").alias("far")), ["class"]).select(F.col("of").alias("new"), "far")
        moved = written(joined(taken, of_label, ["new"], "left").select("class", "label", F.least("new", "far").alias("new")), "labels")
        labels = moved.select("class", F.col("new").alias("label"))
        if moved.where("new < label").isEmpty():
            return labels


def like_size(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    documents = written(set_classes(docs, words), "sets")
    classes = documents.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("_many"))
    by_signature = Window.partitionBy("signature")
    buckets = written(
        class_signatures(docs, words, percent)
        .withColumns({"centre": F.min("class").over(by_signature), "_last": F.max("class").over(by_signature)})
        .where("centre < _last").drop("_last"),
        "buckets",
    )
    sizes = buckets.select("class", "n").distinct()
    to_centre = buckets.where("class <> centre").select(F.col("class").alias("a"), F.col("centre").alias("b"), "n").distinct()
    to_centre = joined(to_centre, sizes.select(F.col("class").alias("b"), F.col("n").alias("n_b")), ["b"])
    tried = written(to_centre.where(like_size("n", "n_b", percent)).select("a", "b"), "pairs")
    nodes = written(joined(sizes.select("class").distinct(), classes, ["class"]).select("class", F.col("first_id").alias("label")), "nodes")
    texts = docs.select(F.col("doc_id").cast("long").alias("label"), "text")
    texts = written(joined(texts, small(nodes), ["label"]).select("class", "text"), "texts")
    sketched = written(sketches(texts, words), "sketches")
    links = written(verified(tried, texts, sketched, words, percent), "links")
    labels = components(nodes, links)

    # classes of one bucket that are still in different components; the centre has met them all
    apart = joined(buckets.where("class <> centre").select("signature", "centre", "class"), labels, ["class"])
    mixed_up = apart.groupBy("signature").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("signature")
    rest = joined(apart, mixed_up, ["signature"], "left_semi").select("centre", "class", "label").distinct()
    rest = written(rest, "rest")
    if not rest.isEmpty():
        more = written(verified_blocks(rest, texts, sketched, words, percent), "links")
        if not more.isEmpty():
            labels = components(labels, links.unionByName(more))

    named = joined(classes, labels, ["class"], "left").where("_many > 1 or label <> first_id").select("class", F.coalesce("label", "first_id").alias("component_id"))
    shared = joined(documents, named, ["class"], "left")
    return shared.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose id is their component's; one row of each id. Rows without id stay."""
    found = written(near_duplicates(docs, words, percent), "components")
    others = small(written(found.where("doc_id <> component_id").select("doc_id").distinct(), "others"))
    kept_docs = joined(docs, others, ["doc_id"], "left_anti")
    again = written(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept_docs
    first = joined(kept_docs, small(again), ["doc_id"], "left_semi").dropDuplicates(["doc_id"])
    return joined(kept_docs, small(again), ["doc_id"], "left_anti").unionByName(first)
