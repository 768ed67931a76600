"""Counts, inventories and gates over batches and written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_mart.functions.columns import row_total
from ledger_mart.schema import DATE
from ledger_mart.sinks.publish import current
from ledger_mart.sources.fact import file_inventory
from ledger_mart.storage import partition_count, partition_path, path_exists


class NoOutputError(RuntimeError):
    """A run that should have left partitions left none."""


def batch_row_count(batch: DataFrame) -> DataFrame:
    return batch.agg(row_total().alias("row_count"))


def partition_audit(fact: DataFrame) -> DataFrame:
    """Rows per date. Needs no column but the partition key, so the row counts come
    from the Parquet footers, and each task sends one row per date."""
    return fact.groupBy(DATE).agg(row_total().alias("row_count"))


def output_gate(spark: SparkSession, path: str) -> DataFrame:
    """One row with the number of date partitions; raises when there are none."""
    partitions = partition_count(spark, current(spark, path))
    if partitions == 0:
        raise NoOutputError(f"no output partitions under {path}")
    return spark.range(1).select(
        F.lit(partitions).cast("long").alias("partitions"),
        F.lit(True).alias("passed"),
    )


def export_status(spark: SparkSession, path: str, batch_date: str) -> str:
    """What an export of ``batch_date`` will meet: no partition at all, a partition
    without Parquet files, or data."""
    if not path_exists(spark, partition_path(spark, current(spark, path), batch_date)):
        return "skipped"
    if file_inventory(spark, path, [batch_date]).isEmpty():
        return "empty"
    return "exported"
