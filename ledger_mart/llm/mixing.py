"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source expects the same number of copies, target / source size.
Documents line up by falling size; the running sum of expected copies, shifted by one
random offset for the source, yields a copy at each whole number it passes. A document
so gets the whole part of its expectation or one more, and as neighbours are of like
size, the words taken stay near the target.

Defined results: null text is empty and has size 0; a null source is a source of its
own, the last; repeated rows count as documents of their own; an empty table gives an
empty mix; other columns of the input are not read. The offset comes from the source's
name and the seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_mart.llm.common import joined, ranked, small, unit_hash, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2


def word_count(text: Column) -> Column:
    # The words part what split() returns; a text that begins or ends with space has an empty first or last part.
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(parts).cast("long") - F.when(parts[0] == "", 1).otherwise(0) - F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to one row for each source (source, source_size).

    Sources by code point, null last, take the weights in turn. Filling all sources at a
    pace given by weight, those with the least cap for their weight stop first; the level
    of the first that doesn't stop holds for all after it. Its windows see one row for
    each source, never the documents.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_stop = Window.orderBy("_stop", "_turn")
    rest = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    weighed = (
        totals.withColumn("_turn", turn)
        .withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * cap)
        .withColumn("_stop", F.col("_cap") / F.col("_weight"))
    )
    level = (share * F.sum("source_size").over(whole) - (F.sum("_cap").over(by_stop) - F.col("_cap"))) / F.sum("_weight").over(rest)
    levels = weighed.withColumn("_level", level).withColumn("_open", F.col("_stop") > F.col("_level"))
    first = F.min(F.when(F.col("_open"), F.struct("_stop", "_turn", "_level"))).over(whole)
    return (
        levels.withColumn("_first", first)
        .withColumn("target", F.when(F.col("_open"), F.col("_weight") * F.col("_first._level")).otherwise(F.col("_cap").cast("double")))
        .select(*totals.columns, "target")
    )


def systematic_mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = "mix"
) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies) for each document.

    One scan of the texts; then ids, sources and sizes only. The hot source's documents
    are ranked by ranges, not in one task.
    """
    sized = written(
        docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size")), "sizes"
    )
    totals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    lined = ranked(sized.withColumn("_falling", -F.col("size")), ["source"], ["_falling", "doc_id"])
    both = joined(lined, totals, ["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit_hash(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))))
    passed = lambda rank: F.floor(rate * rank + offset)
    copies = passed(F.col("rank") + 1) - passed(F.col("rank"))
    return both.select(*sized.columns, "source_size", "target", copies.cast("long").alias("copies"))


def emit(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The documents, each as often as the mix has copies of it. Rows alike in doc_id,
    source and text are one document with the copies of all of them."""
    keys = ["doc_id", "source", "text_hash"]
    often = written(mix.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("_rows")), "copies")
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", "source", F.xxhash64("text").alias("text_hash"))
    again = often.where("_rows > 1").select(*keys)
    if not again.isEmpty():  # only these rows are sorted to keep one of each
        again = small(written(again, "again"))
        once = joined(rows, again, keys, "left_semi").dropDuplicates(keys)
        rows = joined(rows, again, keys, "left_anti").unionByName(once)
    times = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return joined(rows, often.where("copies > 0"), keys).select("_doc", times.alias("_copy")).select("_doc.*")
