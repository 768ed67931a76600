"""Column expressions of the ledger; all built in, safe with ANSI mode on or off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledger_mart.schema import DATE, FLAG


def parsed_date(text: Column) -> Column:
    """Date of a text; NULL where it is none."""
    return text.try_cast("date")


def flag_of(label: Column) -> Column:
    """32-bit flag of a label; NULL where it does not fit."""
    return label.try_cast("int")


def is_batch(batch_date: str) -> Column:
    """Exact match of the raw date text, before any parsing."""
    return F.col(DATE) == F.lit(batch_date)


def row_total() -> Column:
    return F.count(F.lit(1))


def flag_total() -> Column:
    return F.sum(F.col(FLAG).cast("long"))
