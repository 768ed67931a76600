"""Rejected lines: what a load cannot take as it is, and why.

Reasons are ``fields`` (a line of too few or too many), ``number`` (text in the amount or the label that is no long) and
``date`` (text that is no date). The facts stay what they are without: nulls that become zeros, and the NULL
partition. A date or a number that is simply missing is no reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_mart.functions.columns import parsed_date, row_total
from ledger_mart.schema import AMOUNT, DATE, LABEL, RAW_COLUMNS, TXN_NO

LINE, PROBLEMS = "_line", "_problems"
_ODD = "_odd"
#: Names of the observed counts, with reason and column.
COUNTS = {
    "bad_fields": ("fields", None),
    "bad_amounts": ("number", AMOUNT),
    "bad_labels": ("number", LABEL),
    "bad_dates": ("date", DATE),
}
_TYPE = "struct<reason:string,column:string>"


def _problem(reason: str, column: str | None, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(reason).alias("reason"), F.lit(column).cast("string").alias("column")))


def with_problems(raw: DataFrame) -> DataFrame:
    """The raw columns, the list of what is wrong with each line, and the line's text where something is.

    ``raw`` was read with LINE as the column of corrupt lines. Those alone are parted again, as text.
    """
    fields = ", ".join(f"`{c}` string" for c in [*RAW_COLUMNS, _ODD])
    text = F.from_csv(F.col(LINE), fields, {"columnNameOfCorruptRecord": _ODD, "mode": "PERMISSIVE"})
    bad_line = F.col(LINE).isNotNull()
    texted = raw.withColumn("_text", F.when(bad_line, text))
    found = [
        _problem("fields", None, F.col(f"_text.{_ODD}").isNotNull()),
        *[_problem("number", c, F.col(f"_text.`{c}`").isNotNull() & F.col(c).isNull()) for c in (AMOUNT, LABEL)],
        _problem("date", DATE, F.col(DATE).isNotNull() & parsed_date(F.col(DATE)).isNull()),
    ]
    problems = F.array_compact(F.array(*found)).cast(f"array<{_TYPE}>")
    return texted.withColumn(PROBLEMS, problems).select(*RAW_COLUMNS, PROBLEMS, F.when(F.size(PROBLEMS) > 0, F.col(LINE)).alias(LINE))


def problem_counts() -> list[Column]:
    """Aggregates over rows with problems: the rows, those with any, and those of each kind."""
    def with_one(reason: str, column: str | None) -> Column:
        return F.exists(PROBLEMS, lambda p: (p["reason"] == reason) & p["column"].eqNullSafe(F.lit(column)))

    kinds = [F.count_if(with_one(*kind)).alias(name) for name, kind in COUNTS.items()]
    return [row_total().alias("rows"), F.count_if(F.size(PROBLEMS) > 0).alias("rejected"), *kinds]


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """(transaction number, reason, column, line, date): a row for each thing wrong with a line."""
    rows = parsed.where(F.size(PROBLEMS) > 0).withColumn("_problem", F.explode(PROBLEMS))
    return rows.select(
        TXN_NO, F.col("_problem.reason").alias("reason"), F.col("_problem.column").alias("column"),
        F.col(LINE).alias("line"), parsed_date(F.col(DATE)).alias(DATE),
    )
