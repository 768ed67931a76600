"""Row-wise ledger steps, each DataFrame to DataFrame, for ``df.transform``.

They are narrow projections and filters: Catalyst folds a chain of them into one
and pushes the batch filter into the CSV scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_mart.functions.columns import flag_of, is_batch, parsed_date
from ledger_mart.schema import DATE, FLAG, LABEL, NULL_FILL


def filter_batch_date(raw: DataFrame, batch_date: str) -> DataFrame:
    """Rows whose date text equals ``batch_date``; nothing is parsed or trimmed."""
    return raw.where(is_batch(batch_date))


def filter_batch_dates(raw: DataFrame, batch_dates: Sequence[str]) -> DataFrame:
    return raw.where(F.col(DATE).isin(list(batch_dates)))


def cast_txn_date(raw: DataFrame) -> DataFrame:
    return raw.withColumn(DATE, parsed_date(F.col(DATE)))


def fill_nulls(df: DataFrame) -> DataFrame:
    """Zero for a missing amount or label; no other column is touched."""
    return df.fillna(NULL_FILL)


def clean(raw: DataFrame) -> DataFrame:
    return raw.transform(cast_txn_date).transform(fill_nulls)


def add_flag(cleaned: DataFrame) -> DataFrame:
    """The default flag step: the label as a 32-bit integer.

    It runs after the fill, so a missing label gives 0. Jobs take any other
    DataFrame-to-DataFrame step that adds the same column.
    """
    return cleaned.withColumn(FLAG, flag_of(F.col(LABEL)))
