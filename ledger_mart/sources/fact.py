"""Fact ledger: Parquet, one directory per transaction date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_mart.schema import DATE, PLAIN_DATE, fact_schema
from ledger_mart.sinks.publish import current, reading
from ledger_mart.storage import date_key, partition_path


def dated(table: DataFrame) -> DataFrame:
    """The date under its own name, however the folders spell it."""
    return table.withColumnRenamed(PLAIN_DATE, DATE)


def read_fact(
    spark: SparkSession,
    path: str,
    dates: Sequence[str] | None = None,
    flagged: bool | None = None,
    merge_schema: bool | None = None,
) -> DataFrame:
    """The fact table, or the given dates of it by partition pruning.

    With ``flagged`` unset every column that any file has is there, found in a distributed
    job that reads all footers: full-load files have no flag, daily files do, and a flag
    step may add more. ``flagged`` declares the contract's columns with or without the flag
    and opens no footer; ``merge_schema=False`` takes the columns of one file.
    """
    reader = spark.read
    if merge_schema is None:
        merge_schema = flagged is None

    def read(folder: str) -> DataFrame:
        if flagged is not None:
            reader.schema(fact_schema(flagged, date_key(spark, folder)))
        return dated(reader.option("mergeSchema", merge_schema).parquet(folder))

    fact = reading(spark, path, read)
    if dates is not None:
        fact = fact.where(F.col(DATE).isin([F.lit(d).cast("date") for d in dates]))
    return fact


def read_fact_partitions(
    spark: SparkSession, path: str, dates: Sequence[str], merge_schema: bool = True
) -> DataFrame:
    """Existing dates of the fact table; only their directories are listed.

    Whatever columns any of their files has are there, so none is lost where dates
    come from loads with and without the flag. Dates of one and the same write need
    no ``merge_schema``.
    """
    path = current(spark, path)
    return dated(
        spark.read.option("basePath", path)
        .option("mergeSchema", merge_schema)
        .parquet(*[partition_path(spark, path, d) for d in dates])
    )


def file_inventory(
    spark: SparkSession, path: str, dates: Sequence[str] | None = None
) -> DataFrame:
    """Date, path and length of every Parquet file, or of those of existing dates.

    All three come from the listing; no file is opened.
    """
    path = current(spark, path)
    targets = [path] if dates is None else [partition_path(spark, path, d) for d in dates]
    files = dated(
        spark.read.format("binaryFile")
        .option("basePath", path)
        .option("pathGlobFilter", "*.parquet")
        .load(targets)
    )
    if DATE not in files.columns:  # no file to infer it from
        files = files.withColumn(DATE, F.lit(None))
    # Tasks are cut by bytes, none of which is read: a few of them will do.
    listed = files.select(F.col(DATE).cast("date").alias(DATE), "path", "length")
    return listed.coalesce(spark.sparkContext.defaultParallelism)
