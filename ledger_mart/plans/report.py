"""What a run did."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledger_mart.operators.quarantine import COUNTS
from ledger_mart.schema import DATE
from ledger_mart.sinks.publish import current
from ledger_mart.sources.fact import file_inventory
from ledger_mart.storage import partition_count

REPORT_TYPES = {
    "batch_date": pa.string(),
    "status": pa.string(),
    "rows": pa.int64(),
    "input_path": pa.string(),
    "output_path": pa.string(),
    "flagged": pa.int64(),
}
LISTED_TYPES = {**REPORT_TYPES, "partitions": pa.int64(), "files": pa.int64()}


@dataclass(frozen=True)
class RunReport:
    """``status`` is written or no_data for a load; exported, skipped or empty for an
    export. ``batch_date`` is None for a run over all dates, ``flagged`` for one that
    derives no flag. ``rejected`` counts the lines that went to quarantine and ``reasons`` what was wrong with
    them, where a load was given one; ``verified`` is True for an export that was compared row by row."""

    batch_date: str | None
    status: str
    rows: int
    input_path: str
    output_path: str
    flagged: int | None = None
    rejected: int | None = None
    reasons: dict[str, int] | None = None
    verified: bool | None = None


def _frame(spark: SparkSession, records: Sequence[dict], types: dict) -> DataFrame:
    """Driver-side records, one for each date asked for, as local rows."""
    return spark.createDataFrame(pa.Table.from_pylist(list(records), pa.schema(types)))


def report_frame(spark: SparkSession, reports: Sequence[RunReport]) -> DataFrame:
    return _frame(spark, [asdict(r) for r in reports], REPORT_TYPES)


def status_frame(spark: SparkSession, reports: Sequence[RunReport]) -> DataFrame:
    return report_frame(spark, reports).select("batch_date", "status", "rows")


def reject_frame(spark: SparkSession, reports: Sequence[RunReport]) -> DataFrame:
    """Rejected lines of each run, in all and for each thing wrong with them."""
    types = {"batch_date": pa.string(), "status": pa.string(), "rejected": pa.int64()}
    records = [{**asdict(r), **(r.reasons or {})} for r in reports]
    return _frame(spark, records, types | {name: pa.int64() for name in COUNTS})


def report_records(spark: SparkSession, reports: Sequence[RunReport]) -> list[dict]:
    """The reports with the number of date partitions in the output and of Parquet
    files in the run's part of it, both from listings."""
    partitions: dict[str, int] = {}
    files: dict[tuple[str, str | None], int] = {}
    for path in {r.output_path for r in reports}:
        partitions[path] = partition_count(spark, current(spark, path))
        with_data = [
            r.batch_date
            for r in reports
            if r.output_path == path and r.status in ("written", "exported")
        ]
        dates = [d for d in with_data if d]
        if dates:
            per_date = file_inventory(spark, path, dates).groupBy(DATE).count()
            for row in per_date.collect():
                files[path, row[DATE].isoformat()] = row["count"]
        if None in with_data:
            files[path, None] = file_inventory(spark, path).count()
    return [
        {
            **asdict(r),
            "partitions": partitions[r.output_path],
            "files": files.get((r.output_path, r.batch_date), 0),
        }
        for r in reports
    ]


def run_report(spark: SparkSession, reports: Sequence[RunReport]) -> DataFrame:
    return _frame(spark, report_records(spark, reports), LISTED_TYPES)
