"""A ledger derived from the ``events`` table, for queries, tests and benchmarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_mart.plans.load import full_load
from ledger_mart.schema import (
    ACCOUNT,
    AMOUNT,
    APPROVER,
    COUNTERPARTY,
    DATE,
    LABEL,
    LABEL_TYPE,
    MEMO,
    PREPARER,
    RAW_COLUMNS,
    TXN_NO,
)
from ledger_mart.storage import path_exists, remove_scratch, scratch_path

_staged: dict[tuple, str] = {}


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one raw ledger row, some without amount or label."""
    event_id, user_id = F.col("event_id"), F.col("user_id")
    is_error = F.col("event_type") == "error"
    columns: dict[str, Column] = {
        TXN_NO: event_id.cast("string"),
        DATE: F.col("ts").cast("date").cast("string"),
        ACCOUNT: F.col("event_type"),
        COUNTERPARTY: user_id.cast("string"),
        AMOUNT: F.when(event_id % 17 == 0, None).otherwise(F.floor(F.col("value") * 100)),
        MEMO: F.col("props"),
        PREPARER: F.concat(F.lit("p"), (user_id % 7).cast("string")),
        APPROVER: F.concat(F.lit("a"), (user_id % 5).cast("string")),
        LABEL: F.when(event_id % 13 == 0, None).when(is_error, 1).otherwise(0).cast("long"),
        LABEL_TYPE: F.when(is_error, F.lit("dup")),
    }
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return events.select([c.alias(name) for name, c in columns.items()])


def write_raw_csv(ledger: DataFrame, path: str) -> str:
    ledger.write.option("header", True).csv(path)
    return path


def _once(spark: SparkSession, key: tuple, make: Callable[[], str]) -> str:
    """The path that ``make`` wrote, once per application."""
    key = (spark.sparkContext.applicationId, *key)
    path = _staged.get(key)
    if path is None or not path_exists(spark, path):
        path = _staged[key] = make()
    return path


def staged_ledger(spark: SparkSession, sf_dir: str) -> str:
    """The ledger as a directory of CSV files."""
    ledger = lambda: write_raw_csv(events_ledger(spark, sf_dir), scratch_path(spark, "raw"))
    return _once(spark, ("raw", sf_dir), ledger)


def staged_dated_ledger(spark: SparkSession, sf_dir: str) -> str:
    """The ledger as CSV files that hold few dates each, as they land day by day."""
    ledger = lambda: events_ledger(spark, sf_dir).repartitionByRange(16, DATE)
    return _once(spark, ("dated", sf_dir), lambda: write_raw_csv(ledger(), scratch_path(spark, "dated")))


def staged_bad_text(spark: SparkSession, sf_dir: str, column: str, text: str, every: int) -> str:
    """The whole ledger as CSV, with ``text`` for the column in some of the rows."""
    bad = F.col(TXN_NO).cast("long") % every == 0

    def ledger() -> str:
        rows = events_ledger(spark, sf_dir).withColumn(
            column, F.when(bad, F.lit(text)).otherwise(F.col(column).cast("string"))
        )
        return write_raw_csv(rows, scratch_path(spark, "bad-text"))

    return _once(spark, ("bad text", sf_dir, column, text, every), ledger)


def staged_swapped_header(spark: SparkSession, sf_dir: str) -> str:
    """The ledger as CSV whose header names two columns in each other's place."""
    swapped = {TXN_NO: ACCOUNT, ACCOUNT: TXN_NO}
    header = [swapped.get(c, c) for c in RAW_COLUMNS]
    rows = lambda: events_ledger(spark, sf_dir).toDF(*header)
    return _once(spark, ("swapped", sf_dir), lambda: write_raw_csv(rows(), scratch_path(spark, "swapped")))


def staged_fact(spark: SparkSession, sf_dir: str) -> str:
    """A full load of the ledger, for those who only read it."""
    def load() -> str:
        out = scratch_path(spark, "fact")
        full_load(spark, staged_ledger(spark, sf_dir), out)
        return out

    return _once(spark, ("fact", sf_dir), load)


def remove_staged(spark: SparkSession) -> None:
    for key in [k for k in _staged if k[0] == spark.sparkContext.applicationId]:
        remove_scratch(spark, _staged.pop(key))
