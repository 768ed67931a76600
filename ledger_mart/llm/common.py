"""Helpers that several operators share."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: Lower case for A-Z only, other letters as they are.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
SMALL_ROWS = 1_000_000
MOST_BATCH = 4 << 20  # bytes of rows that one batch takes to Python
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_local_folders: dict[str, str] = {}
_ROW_BITS = 33  # of monotonically_increasing_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session gets a temporary folder; a cluster is refused,
    as no folder of one machine would do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = spark.sparkContext.applicationId
        root = _local_folders.get(own) or _local_folders.setdefault(own, tempfile.mkdtemp(prefix="llm-"))
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder once and read back: a lost executor costs
    nothing that came before."""
    path = shared_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python some megabytes at a time, whatever the length of their texts, for plans made
    within the block; then the session's own setting holds again."""
    own = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, min(int(own.removesuffix("b")), MOST_BATCH) if own.removesuffix("b").isdigit() else MOST_BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, own)


def schema_of(df: DataFrame, keep: Sequence[str], added: str) -> T.StructType:
    """The columns kept and those of a DDL string, all nullable."""
    own = [T.StructField(c, df.schema[c].dataType) for c in keep]
    return T.StructType([*own, *T.StructType.fromDDL(added).fields])


def extended(batch: pa.RecordBatch, keep: Sequence[str], **added: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added.values()], names=[*keep, *added])


def in_slices(batches: Iterable[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes, or of one longer row, however long the texts of one batch are."""
    for batch in batches:
        low = 0
        while low < batch.num_rows:
            rows = batch.num_rows - low
            while rows > 1 and batch.slice(low, rows).nbytes > most:
                rows = max(1, min(rows - 1, rows * most // batch.slice(low, rows).nbytes))
            yield batch.slice(low, rows)
            low += rows


def kept(of: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` returned for the key, kept by this process for later tasks of the same operator. Functions
    travel by value, so their module's globals would last for one task only.

    Spark gives its Python processes to whatever runs next, so what another operator kept goes first: together
    the operators of a pipeline would hold more than an executor has.
    """
    store = sys.modules.setdefault("_llm_kept", types.ModuleType("_llm_kept")).__dict__
    if store.get("of") != of:
        store["of"], store["found"] = of, {}
        pa.default_memory_pool().release_unused()
    found = store["found"]
    if key not in found:
        found[key] = make()
    return found[key]


def is_small(df: DataFrame) -> bool:
    """Whether a written table has at most SMALL_ROWS rows, of a few numbers each."""
    return df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is small; as it is beyond that, and joins shuffle."""
    return F.broadcast(df) if is_small(df) else df


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of both, null equal to null, with the left side's keys.
    Apart from the keys the two have no column name in common."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, on, how).drop(*[f"__{k}" for k in keys])


def held_out(doc_id: str, parts: int, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts == part


def unit_hash(value: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("double") / float(2**32)


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds each row's position in its group, from 0, in ascending ``order`` (nulls first).

    Rows are dealt out by ranges of (groups, order), so a group of any size spreads over
    as many tasks as its rows need. Within a range the position is the row number of the
    sorted task; what lies before comes from one count for each task and group. The
    numbered rows are written before they are counted, so a task that runs again can't
    number them otherwise. Rows equal in groups and order get different positions.
    """
    keys = [*groups, *order]
    numbered = written(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_part", F.shiftright("_row", _ROW_BITS))
    spans = numbered.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_n")
    spans = spans.select("_part", *groups, "_first", before.alias("_before"))
    rank = F.col("_before") + F.col("_row") - F.col("_first")
    return joined(numbered, spans, ["_part", *groups]).select(*df.columns, rank.alias(name))
