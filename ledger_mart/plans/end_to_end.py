"""Load, check and export in one call; the first failing step ends the run."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledger_mart.operators.audit import output_gate
from ledger_mart.operators.transform import add_flag
from ledger_mart.plans.export import export_full, export_partition
from ledger_mart.plans.load import FlagStep, daily_job, full_load
from ledger_mart.plans.report import RunReport
from ledger_mart.storage import require_apart


def daily_end_to_end(
    spark: SparkSession,
    input_path: str,
    fact_path: str,
    export_path: str,
    batch_date: str,
    flag: FlagStep = add_flag,
    gather: bool = True,
) -> tuple[RunReport, RunReport]:
    """Daily load, output gate, export of the date: the load's and export's report.

    A date without rows passes as long as the table has partitions at all; its
    export then says whether an earlier load of the date was there.
    """
    require_apart(spark, input_path, fact_path, export_path)
    loaded = daily_job(spark, input_path, fact_path, batch_date, flag, gather)
    output_gate(spark, fact_path)
    return loaded, export_partition(spark, fact_path, export_path, batch_date)


def full_end_to_end(
    spark: SparkSession,
    input_path: str,
    fact_path: str,
    export_path: str,
    allow_empty: bool = True,
    gather: bool = True,
) -> tuple[RunReport, RunReport]:
    """Full load, then export of the whole table; an emptied table leaves the mart as it is."""
    require_apart(spark, input_path, fact_path, export_path)
    loaded = full_load(spark, input_path, fact_path, allow_empty, gather)
    return loaded, export_full(spark, fact_path, export_path)
