"""Writers of date-partitioned Parquet tables.

The overwrite radius is an option of each write. The session is left alone, so
one session can run jobs of both kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledger_mart.schema import DATE
from ledger_mart.sinks.publish import current, publish, settle
from ledger_mart.storage import date_key, require_target


def _overwrite(df: DataFrame, path: str, radius: str) -> None:
    require_target(df.sparkSession, path)
    key = date_key(df.sparkSession, path)
    (
        df.withColumnRenamed(DATE, key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", radius)
        .partitionBy(key)
        .parquet(path)
    )


def replace_dates(df: DataFrame, path: str) -> None:
    """Replace the dates that occur in ``df``; every other date stays."""
    settle(df.sparkSession, path)
    _overwrite(df, current(df.sparkSession, path), "dynamic")


def replace_table(df: DataFrame, path: str) -> None:
    """Replace the whole table, also by nothing if ``df`` is empty. Readers have the old
    table until the new one is whole; if the write fails they keep it."""
    publish(df.sparkSession, path, lambda folder: _overwrite(df, folder, "static"))
