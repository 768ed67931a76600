"""Which raw files may hold a date.

A daily job over a folder that only grows would read every raw file ever landed. The map is a small Parquet table
with a row for each raw file: its length and time, the least and greatest date text, and the date texts themselves
where they are few. One listing of the folder tells which files are new, rewritten or gone; only new and rewritten
ones are scanned, for their dates. A job then opens only the files that may hold its dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_mart.functions.columns import row_total
from ledger_mart.schema import DATE
from ledger_mart.sinks.publish import current, publish
from ledger_mart.sources.raw import read_raw
from ledger_mart.storage import path_exists

SCHEMA = "file string, length long, time timestamp, least string, greatest string, dates array<string>"
SEEN = ["file", "length", "time"]
#: Files with more date texts are known by the least and greatest alone.
MOST_DATES = 400
#: More files than this are not named one by one: all are read, which gives the same rows.
MOST_FILES = 10_000


def raw_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file, length, time) of the raw files, from the listing; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return found.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("time"),
    )


def read_date_map(spark: SparkSession, map_path: str) -> DataFrame:
    folder = current(spark, map_path)
    if not path_exists(spark, folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(folder)


def only_files(raw: DataFrame, files: Sequence[str]) -> DataFrame:
    """The rows of these files. Spark leaves the others out when it lists the scan's files."""
    if len(files) > MOST_FILES:
        return raw
    return raw.where(F.col("_metadata.file_path").isin(list(files)) if files else F.lit(False))


def _first_files(files: DataFrame) -> list[str]:
    return [r["file"] for r in files.select("file").limit(MOST_FILES + 1).collect()]


def refresh_date_map(spark: SparkSession, raw_path: str, map_path: str, recursive: bool = False) -> int:
    """Bring the map in line with the raw folder: how many files (MOST_FILES + 1 at most) were new to it."""
    known, listed = read_date_map(spark, map_path), raw_files(spark, raw_path, recursive)
    fresh = listed.join(known.select(*SEEN), SEEN, "left_anti")
    names = _first_files(fresh)
    if not names and known.join(listed, SEEN, "left_anti").isEmpty() and path_exists(spark, current(spark, map_path)):
        return 0
    raw = only_files(read_raw(spark, raw_path, recursive=recursive), names)
    dated = raw.select(F.col("_metadata.file_path").alias("file"), DATE).where(F.col(DATE).isNotNull())
    dates = dated.groupBy("file", DATE).agg(row_total().alias("rows")).groupBy("file").agg(
        F.min(DATE).alias("least"),
        F.max(DATE).alias("greatest"),
        F.when(row_total() <= MOST_DATES, F.sort_array(F.collect_list(DATE))).alias("dates"),
    )
    kept = known.join(listed, SEEN, "left_semi")
    rows = kept.unionByName(fresh.join(dates, "file", "left"))
    publish(spark, map_path, lambda folder: rows.write.parquet(folder))
    return len(names)


def may_hold(dates: Sequence[str]) -> Column:
    """Whether a file of the map may hold one of these date texts."""
    within = F.lit(False)
    for date in dates:
        within = within | ((F.col("least") <= date) & (F.col("greatest") >= date))
    listed = F.arrays_overlap("dates", F.array(*[F.lit(d) for d in dates]))
    return F.coalesce(listed, within)


def read_raw_mapped(
    spark: SparkSession,
    path: str,
    map_path: str,
    dates: Sequence[str],
    recursive: bool = False,
    corrupt_column: str | None = None,
) -> DataFrame:
    """The raw ledger, as far as it may hold the dates; the map is refreshed first."""
    refresh_date_map(spark, path, map_path, recursive)
    files = _first_files(read_date_map(spark, map_path).where(may_hold(dates)))
    return only_files(read_raw(spark, path, corrupt_column, recursive), files)
