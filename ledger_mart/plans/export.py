"""Exports: fact table to mart, same layout.

Fact files hold one date each, so a task meets few dates and writes few files
without any shuffle. With ``verify`` on, the fingerprint of the rows is observed as they are
written and then computed over the mart; where the two differ, both tables are compared date by date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledger_mart.functions.columns import row_total
from ledger_mart.lease import lease
from ledger_mart.operators.audit import export_status
from ledger_mart.operators.fingerprint import PARTS, compare_tables, fingerprint
from ledger_mart.plans.batch_date import checked_batch_date
from ledger_mart.plans.report import RunReport
from ledger_mart.schema import DATE
from ledger_mart.sinks.publish import current
from ledger_mart.sinks.fact import replace_dates, replace_table
from ledger_mart.sources.fact import read_fact, read_fact_partitions
from ledger_mart.storage import partition_count, require_apart


class ExportMismatchError(RuntimeError):
    """The mart does not hold the rows that were exported."""


def _observed(fact: DataFrame, seen: Observation, verify: bool) -> DataFrame:
    return fact.observe(seen, *(fingerprint(fact.columns) if verify else [row_total().alias("rows")]))


def _verified(fact: DataFrame, mart: DataFrame, seen: dict) -> bool:
    """Read the mart once; only a mart that differs is compared with the table, to name the dates."""
    found = mart.agg(*fingerprint(fact.columns)).first()
    if all(found[p] == seen[p] for p in PARTS):
        return True
    amiss = compare_tables(fact, mart).where("status <> 'same'").orderBy(DATE).limit(10).collect()
    named = ", ".join(f"{r[DATE]} {r['status']} ({r['fact_rows']} rows, {r['mart_rows']} in the mart)" for r in amiss)
    raise ExportMismatchError(f"the mart differs from what was exported: {named or 'the table changed meanwhile'}")


def export_full(
    spark: SparkSession, fact_path: str, export_path: str, flagged: bool | None = None, verify: bool = False
) -> RunReport:
    """Replace the mart by the whole fact table, with every column any file has.

    That reads every footer first. ``flagged`` declares the columns instead, for a table
    that has no others: those of the contract with or without the flag. A table without
    dates is ``empty`` and leaves the mart as it is.
    """
    require_apart(spark, fact_path, export_path)
    if partition_count(spark, current(spark, fact_path)) == 0:
        return RunReport(None, "empty", 0, fact_path, export_path)
    with lease(spark, export_path):
        seen = Observation("full export")
        fact = read_fact(spark, fact_path, flagged=flagged)
        replace_table(_observed(fact, seen, verify), export_path)
        mart = read_fact(spark, export_path, flagged=flagged) if verify else None
        verified = _verified(fact, mart, seen.get) if verify else None
        return RunReport(None, "exported", seen.get["rows"], fact_path, export_path, verified=verified)


def export_partition(
    spark: SparkSession, fact_path: str, export_path: str, batch_date: str, verify: bool = False
) -> RunReport:
    """Replace one date of the mart by that of the fact table.

    Nothing is left of an earlier export of the date. Without data to export the
    mart stays as it is and the status says why.
    """
    checked_batch_date(batch_date)
    require_apart(spark, fact_path, export_path)
    status = export_status(spark, fact_path, batch_date)
    rows, verified = 0, None
    if status == "exported":
        with lease(spark, export_path, [batch_date]):
            seen = Observation("partition export")
            fact = read_fact_partitions(spark, fact_path, [batch_date])
            replace_dates(_observed(fact, seen, verify), export_path)
            rows = seen.get["rows"]
            if verify and rows:
                verified = _verified(fact, read_fact_partitions(spark, export_path, [batch_date]), seen.get)
    return RunReport(batch_date, status, rows, fact_path, export_path, verified=verified)


def export_audit(
    spark: SparkSession, fact_path: str, export_path: str, flagged: bool | None = None
) -> DataFrame:
    """Which dates of the mart hold other rows than the fact table; each table is read once."""
    fact, mart = (read_fact(spark, p, flagged=flagged) for p in (fact_path, export_path))
    return compare_tables(fact, mart).withColumn("passed", F.col("status") == "same")
