"""Loads: raw ledger to fact table.

A load scans the raw files once. The row counts come from an observation in the stage
that writes, above the last shuffle: Spark counts each task of that stage once, also
when tasks are retried or an executor is lost.

``gather`` off skips the shuffle before the write, which is right where each raw file
holds few dates.

With a ``quarantine`` table the parsed rows are written once, to the shared folder; facts and rejected lines are
both read from there, so the raw files are still scanned once. A ``date_map`` lets loads by date open only the raw
files that may hold their dates. Each load holds a lease of what it replaces.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledger_mart.functions.columns import flag_of, flag_total, row_total
from ledger_mart.lease import lease
from ledger_mart.operators.layout import gather_by_date, spread_one_date
from ledger_mart.operators.quarantine import LINE, problem_counts, rejected_lines, with_problems
from ledger_mart.operators.transform import (
    add_flag,
    clean,
    filter_batch_date,
    filter_batch_dates,
)
from ledger_mart.plans.batch_date import checked_batch_date
from ledger_mart.plans.report import RunReport
from ledger_mart.schema import DATE, FLAG, RAW_COLUMNS
from ledger_mart.sinks.fact import replace_dates, replace_table
from ledger_mart.sinks.publish import current
from ledger_mart.sources.date_map import read_raw_mapped
from ledger_mart.sources.fact import read_fact_partitions
from ledger_mart.sources.raw import read_raw
from ledger_mart.storage import (
    path_exists,
    remove_empty_folder,
    remove_partition,
    remove_scratch,
    require_apart,
    scratch_path,
)

FlagStep = Callable[[DataFrame], DataFrame]


def _flagged(batch: DataFrame, flag: FlagStep) -> DataFrame:
    """Cleaned rows with the flag as the contract's type, whatever the step gives.

    A flag that doesn't fit is NULL; further columns of the step stay.
    """
    return batch.transform(clean).transform(flag).withColumn(FLAG, flag_of(F.col(FLAG)))


def _replace_dates(spark: SparkSession, facts: DataFrame, output_path: str, seen: Observation) -> None:
    """One scan, also of a batch without rows: an empty write with dynamic overwrite changes
    nothing in a table that exists, and the empty folder it makes of one that doesn't is
    removed again."""
    existed = path_exists(spark, output_path)
    replace_dates(facts, output_path)
    if not existed and not any(seen.get.values()):
        remove_empty_folder(spark, output_path)


def _given(*paths: str | None) -> list[str]:
    return [p for p in paths if p]


def _raw(
    spark: SparkSession, path: str, dates: Sequence[str] | None, date_map: str | None, quarantine: str | None
) -> DataFrame:
    """The raw ledger, with the text of odd lines where they go to quarantine."""
    line = LINE if quarantine else None
    if date_map and dates:
        return read_raw_mapped(spark, path, date_map, dates, corrupt_column=line)
    return read_raw(spark, path, line)


@contextlib.contextmanager
def _quarantined(
    spark: SparkSession, batch: DataFrame, quarantine: str | None, dates: Sequence[str] | None
) -> Iterator[tuple[DataFrame, dict[str, int]]]:
    """The batch without what only the quarantine needs, and the observed counts of rejected lines.

    The quarantine's dates, or all of it, are replaced by the batch's rejected lines, so a
    run that is repeated does not add to it.
    """
    if not quarantine:
        yield batch, {}
        return
    path, seen = scratch_path(spark, "parsed"), Observation("parsed lines")
    with_problems(batch).observe(seen, *problem_counts()).write.parquet(path)
    parsed = spark.read.parquet(path)
    rejected = rejected_lines(parsed)
    try:
        if dates is None:
            replace_table(rejected, quarantine)
        else:
            replace_dates(rejected, quarantine)
            left = {r[DATE].isoformat() for r in rejected.select(DATE).distinct().collect()}
            for date in set(dates) - left:
                remove_partition(spark, current(spark, quarantine), date)
        yield parsed.select(*RAW_COLUMNS), seen.get
    finally:
        remove_scratch(spark, path)


def _rejected(counts: dict[str, int]) -> dict:
    """The report's fields of the observed counts."""
    reasons = {k: v for k, v in counts.items() if k.startswith("bad_")}
    return {"rejected": counts["rejected"], "reasons": reasons} if counts else {}


def daily_job(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    batch_date: str,
    flag: FlagStep = add_flag,
    gather: bool = True,
    date_map: str | None = None,
    quarantine: str | None = None,
) -> RunReport:
    """Load one date, replacing it in the fact table.

    A date without rows leaves the table as it is, and ends normally.
    """
    checked_batch_date(batch_date)
    require_apart(spark, *_given(input_path, output_path, date_map, quarantine))
    with lease(spark, output_path, [batch_date]):
        raw = _raw(spark, input_path, [batch_date], date_map, quarantine)
        batch = raw.transform(filter_batch_date, batch_date)
        with _quarantined(spark, batch, quarantine, [batch_date]) as (batch, counts):
            return _load_date(spark, batch, input_path, output_path, batch_date, flag, gather, counts)


def _load_date(
    spark: SparkSession,
    batch: DataFrame,
    input_path: str,
    output_path: str,
    batch_date: str,
    flag: FlagStep,
    gather: bool,
    counts: dict[str, int],
) -> RunReport:
    seen = Observation("daily job")
    facts = _flagged(batch, flag)
    if gather:
        facts = facts.transform(spread_one_date)
    facts = facts.observe(seen, row_total().alias("rows"), flag_total().alias("flagged"))
    _replace_dates(spark, facts, output_path, seen)
    rows, flagged = seen.get["rows"], seen.get["flagged"] or 0
    return RunReport(
        batch_date=batch_date,
        status="written" if rows else "no_data",
        rows=rows,
        input_path=input_path,
        output_path=output_path,
        flagged=flagged,
        **_rejected(counts),
    )


def backfill(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    batch_dates: Sequence[str],
    flag: FlagStep = add_flag,
    gather: bool = True,
    date_map: str | None = None,
    quarantine: str | None = None,
) -> list[RunReport]:
    """Load many dates in one scan and one write.

    Table and reports are as after a daily job for each date, in date order: dates
    without rows keep what they had. Rejected lines are counted in the quarantine only.
    """
    if not batch_dates:
        raise ValueError("no batch dates")
    wanted = sorted({checked_batch_date(d) for d in batch_dates})
    require_apart(spark, *_given(input_path, output_path, date_map, quarantine))
    with lease(spark, output_path, wanted):
        batch = _raw(spark, input_path, wanted, date_map, quarantine).transform(filter_batch_dates, wanted)
        with _quarantined(spark, batch, quarantine, wanted) as (batch, _):
            return _load_dates(spark, batch, input_path, output_path, wanted, flag, gather)


def _load_dates(
    spark: SparkSession,
    batch: DataFrame,
    input_path: str,
    output_path: str,
    wanted: Sequence[str],
    flag: FlagStep,
    gather: bool,
) -> list[RunReport]:
    counts = {}
    seen = Observation("backfill")
    facts = _flagged(batch, flag)
    if gather:
        facts = facts.transform(gather_by_date)
    # The set holds requested dates only, so it is no longer than the request.
    facts = facts.observe(seen, F.collect_set(DATE).alias("dates"))
    _replace_dates(spark, facts, output_path, seen)
    written = [d.isoformat() for d in seen.get["dates"]]
    if written:
        fresh = read_fact_partitions(spark, output_path, written, merge_schema=False)
        per_date = fresh.groupBy(DATE).agg(
            row_total().alias("rows"), flag_total().alias("flagged")
        )
        counts = {r[DATE].isoformat(): r for r in per_date.collect()}
    return [
        RunReport(
            batch_date=d,
            status="written" if d in counts else "no_data",
            rows=counts[d]["rows"] if d in counts else 0,
            input_path=input_path,
            output_path=output_path,
            flagged=(counts[d]["flagged"] or 0) if d in counts else 0,
        )
        for d in wanted
    ]


def full_load(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    allow_empty: bool = True,
    gather: bool = True,
    quarantine: str | None = None,
) -> RunReport:
    """Replace the whole fact table by all dates of the raw ledger, without the flag.

    Rows whose date does not parse go to the NULL partition. An empty raw ledger
    empties the table, as a full refresh means; with ``allow_empty`` off it leaves
    the table alone. Readers have the old table until the new one is whole.
    """
    require_apart(spark, *_given(input_path, output_path, quarantine))
    raw = _raw(spark, input_path, None, None, quarantine)
    if not allow_empty and raw.isEmpty():
        return RunReport(None, "no_data", 0, input_path, output_path)
    with lease(spark, output_path), _quarantined(spark, raw, quarantine, None) as (raw, counts):
        seen = Observation("full load")
        facts = raw.transform(clean)
        if gather:
            facts = facts.transform(gather_by_date)
        replace_table(facts.observe(seen, row_total().alias("rows")), output_path)
        rows = seen.get["rows"]
        status = "written" if rows else "no_data"
        return RunReport(None, status, rows, input_path, output_path, **_rejected(counts))
