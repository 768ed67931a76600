"""Multiset fingerprints: whether two tables hold the same rows, date by date, whatever their order and files.

A fingerprint is the number of rows with the sum and the exclusive or of their hashes. It merges, so each table is
read once and each task sends a row for each date. A lost row, one that is there twice and a changed one each
change it (up to a chance of about 1 in 2^64).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_mart.functions.columns import row_total
from ledger_mart.schema import DATE

PARTS = ["rows", "low", "high", "mixed"]


def row_hash(columns: Sequence[str]) -> Column:
    """A 64-bit hash of the columns in order of their names; a null is not like a missing value of its neighbour."""
    own = sorted(columns)
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in own])
    return F.xxhash64(nulls, *[F.col(c) for c in own])


def fingerprint(columns: Sequence[str]) -> list[Column]:
    """Aggregates, named as PARTS. The hashes' halves are summed apart, so that no sum overflows."""
    own = row_hash(columns)
    return [
        row_total().alias("rows"),
        F.sum(own.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.sum(F.shiftrightunsigned(own, 32)).alias("high"),
        F.bit_xor(own).alias("mixed"),
    ]


def date_fingerprints(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(date, PARTS) of a table; rows without date have one of their own."""
    return table.groupBy(DATE).agg(*fingerprint(columns or table.columns))


def _with_columns_of(table: DataFrame, other: DataFrame) -> DataFrame:
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in other.schema if f.name not in table.columns}
    return table.withColumns(lacking)


def compare_tables(fact: DataFrame, mart: DataFrame) -> DataFrame:
    """(date, status, fact_rows, mart_rows) of every date of either: ``same``, ``missing`` or ``extra`` in the mart,
    ``lost`` or ``doubled`` rows by their number, ``changed`` with as many rows. A column that one of the two lacks counts as
    null there."""
    left, right = _with_columns_of(fact, mart), _with_columns_of(mart, fact)
    ours, theirs = date_fingerprints(left), date_fingerprints(right, left.columns)
    ours = ours.select(DATE, *[F.col(p).alias(f"fact_{p}") for p in PARTS])
    theirs = theirs.select(F.col(DATE).alias("_date"), *[F.col(p).alias(f"mart_{p}") for p in PARTS])
    both = ours.join(theirs, F.col(DATE).eqNullSafe(F.col("_date")), "full")
    equal = [F.col(f"fact_{p}").eqNullSafe(F.col(f"mart_{p}")) for p in PARTS]
    same = equal[0] & equal[1] & equal[2] & equal[3]
    status = (
        F.when(F.col("mart_rows").isNull(), "missing").when(F.col("fact_rows").isNull(), "extra").when(same, "same")
        .when(F.col("mart_rows") < F.col("fact_rows"), "lost").when(F.col("mart_rows") > F.col("fact_rows"), "doubled")
        .otherwise("changed")
    )
    none = F.lit(0).cast("long")
    return both.select(
        F.when(F.col("fact_rows").isNull(), F.col("_date")).otherwise(F.col(DATE)).alias(DATE),
        status.alias("status"),
        F.coalesce("fact_rows", none).alias("fact_rows"), F.coalesce("mart_rows", none).alias("mart_rows"),
    )
