"""Queries over the given tables, each with the SQL that gives the same result.

The ledger is derived from ``events``. Queries that need raw files read it from CSV
that Spark wrote; queries that write do so into a new folder and return the table
read back.
"""

from __future__ import annotations

import contextlib
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_mart import cli
from ledger_mart.fixtures import (
    events_ledger,
    staged_bad_text,
    staged_dated_ledger,
    staged_fact,
    staged_ledger,
    staged_swapped_header,
)
from ledger_mart.operators import audit, transform
from ledger_mart.plans.end_to_end import daily_end_to_end, full_end_to_end
from ledger_mart.plans.export import export_audit, export_full, export_partition
from ledger_mart.plans.load import backfill, daily_job, full_load
from ledger_mart.plans.report import reject_frame, run_report, status_frame
from ledger_mart.schema import AMOUNT, DATE, FLAG, LABEL, RAW_COLUMNS, TXN_NO
from ledger_mart.sinks.fact import replace_dates, replace_table
from ledger_mart.sinks.publish import publish
from ledger_mart.sources.fact import file_inventory, read_fact
from ledger_mart.sources.raw import read_raw
from ledger_mart.storage import make_folder, partition_path, scratch_path

DAY = "2024-01-03"
NEXT_DAY = "2024-01-04"
NO_DAY = "1999-01-01"
EMPTY_DAY = "1999-01-02"
RANGE = ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08", "2024-01-09"]
MISSING_DAY = "2024-01-06"
FACT_COLUMNS = RAW_COLUMNS
FLAGGED_COLUMNS = [*RAW_COLUMNS, FLAG]


# Sources


def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw(spark, staged_ledger(spark, sf_dir))


def permissive_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw(spark, staged_bad_text(spark, sf_dir, AMOUNT, "abc", every=19))


def corrupt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_bad_text(spark, sf_dir, AMOUNT, "12.5", every=19)
    raw = read_raw(spark, path, corrupt_column="line")
    return raw.select(*RAW_COLUMNS, F.col("line").isNotNull().alias("corrupt"))


def positional_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw(spark, staged_swapped_header(spark, sf_dir))


def fact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_fact(spark, staged_fact(spark, sf_dir)).select(*FACT_COLUMNS)


def mixed_fact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _loaded(spark, sf_dir)
    daily_job(spark, staged_ledger(spark, sf_dir), out, DAY)
    return read_fact(spark, out).select(*FLAGGED_COLUMNS)


# Row-wise steps


def filter_batch_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_ledger(spark, sf_dir).transform(transform.filter_batch_date, DAY)


def cast_txn_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_ledger(spark, sf_dir).transform(transform.cast_txn_date)


def fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_ledger(spark, sf_dir).transform(transform.fill_nulls)


def clean_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_ledger(spark, sf_dir).transform(transform.clean)


def fds_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_ledger(spark, sf_dir).transform(transform.clean).transform(transform.add_flag)


# Loads


def _loaded(spark: SparkSession, sf_dir: str) -> str:
    out = scratch_path(spark, "fact")
    full_load(spark, staged_ledger(spark, sf_dir), out)
    return out


def _daily(spark: SparkSession, sf_dir: str, *days: str) -> DataFrame:
    out = scratch_path(spark, "fact")
    for day in days:
        daily_job(spark, staged_ledger(spark, sf_dir), out, day)
    return read_fact(spark, out).select(*FLAGGED_COLUMNS)


def full_load_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_fact(spark, _loaded(spark, sf_dir), flagged=False).select(*FACT_COLUMNS)


def unparsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "fact")
    full_load(spark, staged_bad_text(spark, sf_dir, DATE, "2024/01/03", every=3), out)
    return read_fact(spark, out).select(*FACT_COLUMNS)


def static_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _loaded(spark, sf_dir)
    day = read_raw(spark, staged_ledger(spark, sf_dir)).transform(
        transform.filter_batch_date, DAY
    )
    replace_table(day.transform(transform.clean), out)
    return read_fact(spark, out).select(*FACT_COLUMNS)


class Interrupted(RuntimeError):
    """The end of a run that doesn't reach its own."""


def full_load_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replacement that ends after it wrote a part of the new table."""
    out = _loaded(spark, sf_dir)
    part = events_ledger(spark, sf_dir).where(F.col(DATE) == DAY).transform(transform.clean)

    def dies(folder: str) -> None:
        replace_dates(part, folder)
        raise Interrupted

    with contextlib.suppress(Interrupted):
        publish(spark, out, dies)
    return read_fact(spark, out).select(*FACT_COLUMNS)


def daily_job_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days, of which the second finds the map that the first made."""
    raw, out, date_map = staged_dated_ledger(spark, sf_dir), scratch_path(spark, "fact"), scratch_path(spark, "date-map")
    for day in (DAY, NEXT_DAY):
        daily_job(spark, raw, out, day, date_map=date_map)
    return read_fact(spark, out).select(*FLAGGED_COLUMNS)


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, rejected = scratch_path(spark, "fact"), scratch_path(spark, "rejected")
    full_load(spark, staged_bad_text(spark, sf_dir, AMOUNT, "abc", every=19), out, quarantine=rejected)
    lines = read_fact(spark, rejected)
    return lines.select(TXN_NO, "reason", "column", F.col("line").isNotNull().alias("has_line"), DATE)


def quarantine_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = staged_bad_text(spark, sf_dir, AMOUNT, "abc", every=19)
    out, rejected = scratch_path(spark, "fact"), scratch_path(spark, "rejected")
    reports = [daily_job(spark, raw, out, day, quarantine=rejected) for day in (DAY, NO_DAY)]
    whole = staged_bad_text(spark, sf_dir, DATE, "2024/01/03", every=3)
    return reject_frame(spark, [*reports, full_load(spark, whole, scratch_path(spark, "fact"), quarantine=rejected)])


def daily_job_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir, DAY)


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "fact")
    argv = ["daily", "--input", staged_ledger(spark, sf_dir), "--output", out, "--date", DAY]
    cli.run(spark, cli.parse(argv))
    return read_fact(spark, out).select(*FLAGGED_COLUMNS)


def rerun_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir, DAY, DAY)


def dynamic_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir, DAY, NEXT_DAY)


def backfill_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "fact")
    backfill(spark, staged_ledger(spark, sf_dir), out, RANGE)
    return read_fact(spark, out).select(*FLAGGED_COLUMNS)


# Counts, gates and reports


def flag_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two daily runs into one table, the flag step of one giving longs."""
    raw, out = staged_ledger(spark, sf_dir), scratch_path(spark, "fact")
    daily_job(spark, raw, out, DAY)
    daily_job(spark, raw, out, NEXT_DAY, flag=lambda df: df.withColumn(FLAG, F.col(LABEL) * 3_000_000_000))
    return read_fact(spark, out).select(*FLAGGED_COLUMNS)


def batch_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = read_raw(spark, staged_ledger(spark, sf_dir)).transform(
        transform.filter_batch_date, DAY
    )
    return audit.batch_row_count(batch)


def empty_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "fact")
    return status_frame(spark, [daily_job(spark, staged_ledger(spark, sf_dir), out, NO_DAY)])


def run_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "fact")
    report = daily_job(spark, staged_ledger(spark, sf_dir), out, DAY)
    return run_report(spark, [report]).select(
        "batch_date", "status", "rows", "flagged", "partitions", (F.col("files") > 0).alias("has_files")
    )


def partition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.partition_audit(read_fact(spark, staged_fact(spark, sf_dir), flagged=False))


def output_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "fact")
    full_load(spark, staged_bad_text(spark, sf_dir, DATE, "2024/01/03", every=3), out)
    return audit.output_gate(spark, out)


def file_inventory_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = file_inventory(spark, staged_fact(spark, sf_dir))
    return files.groupBy(DATE).agg(
        (F.count(F.lit(1)) > 0).alias("has_files"),
        (F.min("length") > 0).alias("has_bytes"),
    )


# Exports


def export_full_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = scratch_path(spark, "mart")
    export_full(spark, staged_fact(spark, sf_dir), mart, flagged=False)
    return read_fact(spark, mart).select(*FACT_COLUMNS)


def export_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, mart = _loaded(spark, sf_dir), scratch_path(spark, "mart")
    daily_job(spark, staged_ledger(spark, sf_dir), fact, DAY)
    export_full(spark, fact, mart)
    return read_fact(spark, mart).select(*FLAGGED_COLUMNS)


def export_partition_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, mart = staged_fact(spark, sf_dir), scratch_path(spark, "mart")
    for _ in range(2):
        export_partition(spark, fact, mart, DAY)
    return read_fact(spark, mart).select(*FACT_COLUMNS)


def export_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, mart = scratch_path(spark, "fact"), scratch_path(spark, "mart")
    daily_job(spark, staged_ledger(spark, sf_dir), fact, DAY)
    make_folder(spark, partition_path(spark, fact, EMPTY_DAY))
    reports = [export_partition(spark, fact, mart, day) for day in (DAY, NO_DAY, EMPTY_DAY)]
    return status_frame(spark, reports)


def export_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mart that lost a row of one date, has one of another twice, one changed, and lacks a date."""
    fact, mart = staged_fact(spark, sf_dir), scratch_path(spark, "mart")
    rows = read_fact(spark, fact, flagged=False)
    first = rows.groupBy(DATE).agg(F.min(F.col(TXN_NO).cast("long")).alias("first"))
    rows = rows.join(first, DATE)
    of_first = lambda day: (F.col(DATE) == F.lit(day).cast("date")) & (F.col(TXN_NO).cast("long") == F.col("first"))
    damaged = (
        rows.where(~of_first(DAY)).where(F.col(DATE) != F.lit(MISSING_DAY).cast("date"))
        .unionByName(rows.where(of_first(NEXT_DAY)))
        .withColumn(AMOUNT, F.when(of_first(RANGE[0]), F.col(AMOUNT) + 1).otherwise(F.col(AMOUNT)))
    )
    replace_table(damaged.drop("first"), mart)
    return export_audit(spark, fact, mart, flagged=False)


def daily_end_to_end_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, mart = scratch_path(spark, "fact"), scratch_path(spark, "mart")
    daily_end_to_end(spark, staged_ledger(spark, sf_dir), fact, mart, DAY)
    return read_fact(spark, mart).select(*FLAGGED_COLUMNS)


def full_end_to_end_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, mart = scratch_path(spark, "fact"), scratch_path(spark, "mart")
    full_end_to_end(spark, staged_ledger(spark, sf_dir), fact, mart)
    return read_fact(spark, mart).select(*FACT_COLUMNS)


# The subpackage llm and its pipeline, where they are installed

try:
    import corpus_pipeline
    from ledger_mart.llm import queries as llm_queries
except ModuleNotFoundError as missing:  # the subpackage itself, or something that it needs
    if missing.name not in ("ledger_mart.llm", "corpus_pipeline"):
        warnings.warn(f"only ledger queries are registered: {missing}", stacklevel=2)
    llm_queries = corpus_pipeline = None


def entry(spark: SparkSession) -> DataFrame:
    """The daily job on the smallest tables, read back."""
    return daily_job_query(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = ledger_queries()
    if llm_queries:
        found |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = ledger_sql()
    if llm_queries:
        found |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def ledger_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "raw_scan": raw_scan,
        "permissive_parse": permissive_parse,
        "corrupt_lines": corrupt_lines,
        "positional_header": positional_header,
        "fact_scan": fact_scan,
        "mixed_fact_scan": mixed_fact_scan,
        "filter_batch_date": filter_batch_date,
        "cast_txn_date": cast_txn_date,
        "fill_nulls": fill_nulls,
        "clean_ledger": clean_ledger,
        "fds_flag": fds_flag,
        "full_load": full_load_query,
        "unparsed_dates": unparsed_dates,
        "static_overwrite": static_overwrite,
        "daily_job": daily_job_query,
        "command_line": command_line,
        "rerun_idempotent": rerun_idempotent,
        "dynamic_overwrite": dynamic_overwrite,
        "backfill": backfill_query,
        "flag_types": flag_types,
        "batch_row_count": batch_row_count,
        "empty_batch": empty_batch,
        "run_report": run_report_query,
        "partition_audit": partition_audit,
        "output_gate": output_gate,
        "file_inventory": file_inventory_query,
        "export_full": export_full_query,
        "export_mixed": export_mixed,
        "export_partition": export_partition_query,
        "export_status": export_status,
        "daily_end_to_end": daily_end_to_end_query,
        "full_end_to_end": full_end_to_end_query,
        "daily_job_mapped": daily_job_mapped,
        "full_load_interrupted": full_load_interrupted,
        "export_audit": export_audit_query,
        "quarantine": quarantine,
        "quarantine_report": quarantine_report,
    }


def ledger_sql() -> dict[str, str]:
    raw = """(
        select cast(event_id as varchar) as "거래번호",
               strftime(ts, '%Y-%m-%d') as "거래일자",
               event_type as "계정과목",
               cast(user_id as varchar) as "거래처",
               case when event_id % 17 = 0 then null
                    else cast(floor(value * 100) as bigint) end as "금액",
               props as "적요",
               'p' || cast(user_id % 7 as varchar) as "담당자",
               'a' || cast(user_id % 5 as varchar) as "승인자",
               case when event_id % 13 = 0 then null
                    when event_type = 'error' then cast(1 as bigint)
                    else cast(0 as bigint) end as "이상여부",
               case when event_type = 'error' then 'dup' end as "이상유형"
        from events)"""
    to_date = 'cast("거래일자" as date) as "거래일자"'
    filled = 'coalesce("금액", 0) as "금액", coalesce("이상여부", 0) as "이상여부"'
    clean = f"(select * replace ({to_date}, {filled}) from {raw})"
    flagged = f'(select *, cast("이상여부" as integer) as fds_flag from {clean})'
    on_day = f"\"거래일자\" = '{DAY}'"
    both_days = f"\"거래일자\" in ('{DAY}', '{NEXT_DAY}')"
    days = ", ".join(f"'{d}'" for d in RANGE)

    def status(day: str, present: str, absent: str) -> str:
        return f"""
            select '{day}' as batch_date,
                   case when count(*) > 0 then '{present}' else '{absent}' end as status,
                   count(*) as "rows"
            from {raw} where "거래일자" = '{day}'"""

    all_clean = f"select * from {clean}"
    day_clean = f"select * from {clean} where {on_day}"
    day_flagged = f"select * from {flagged} where {on_day}"
    return {
        "raw_scan": f"select * from {raw}",
        "permissive_parse": f"""
            select * replace (case when cast("거래번호" as bigint) % 19 <> 0
                                   then "금액" end as "금액")
            from {raw}""",
        "corrupt_lines": f"""
            select * replace (case when cast("거래번호" as bigint) % 19 <> 0
                                   then "금액" end as "금액"),
                   cast("거래번호" as bigint) % 19 = 0 as corrupt
            from {raw}""",
        "positional_header": f"select * from {raw}",
        "fact_scan": all_clean,
        "mixed_fact_scan": f"""
            select * replace (case when {on_day} then fds_flag end as fds_flag)
            from {flagged}""",
        "filter_batch_date": f"select * from {raw} where {on_day}",
        "cast_txn_date": f"select * replace ({to_date}) from {raw}",
        "fill_nulls": f"select * replace ({filled}) from {raw}",
        "clean_ledger": all_clean,
        "fds_flag": f"select * from {flagged}",
        "full_load": all_clean,
        "unparsed_dates": f"""
            select * replace (case when cast("거래번호" as bigint) % 3 <> 0
                                   then "거래일자" end as "거래일자")
            from {clean}""",
        "static_overwrite": day_clean,
        "daily_job": day_flagged,
        "command_line": day_flagged,
        "rerun_idempotent": day_flagged,
        "dynamic_overwrite": f"select * from {flagged} where {both_days}",
        "backfill": f'select * from {flagged} where "거래일자" in ({days})',
        "flag_types": f"""
            select * replace (cast(case when {on_day} or fds_flag = 0 then fds_flag end as integer) as fds_flag)
            from {flagged} where {both_days}""",
        "batch_row_count": f"select count(*) as row_count from {raw} where {on_day}",
        "empty_batch": status(NO_DAY, "written", "no_data"),
        "run_report": f"""
            select '{DAY}' as batch_date,
                   case when count(*) > 0 then 'written' else 'no_data' end as status,
                   count(*) as "rows",
                   cast(coalesce(sum(fds_flag), 0) as bigint) as flagged,
                   count(distinct "거래일자") as partitions, count(*) > 0 as has_files
            from {flagged} where {on_day}""",
        "partition_audit": f"""
            select "거래일자", count(*) as row_count from {clean} group by "거래일자" """,
        "output_gate": f"""
            select count(distinct "거래일자") filter (number % 3 <> 0)
                     + cast(bool_or(number % 3 = 0) as bigint) as partitions,
                   count(*) > 0 as passed
            from (select *, cast("거래번호" as bigint) as number from {clean})""",
        "file_inventory": f"""
            select "거래일자", count(*) > 0 as has_files, count(*) > 0 as has_bytes
            from {clean} group by "거래일자" """,
        "export_full": all_clean,
        "export_mixed": f"""
            select * replace (case when {on_day} then fds_flag end as fds_flag)
            from {flagged}""",
        "export_partition": day_clean,
        "export_status": f"""{status(DAY, 'exported', 'skipped')}
            union all {status(NO_DAY, 'exported', 'skipped')}
            union all {status(EMPTY_DAY, 'exported', 'empty')}""",
        "daily_end_to_end": day_flagged,
        "full_end_to_end": all_clean,
        "daily_job_mapped": f"select * from {flagged} where {both_days}",
        "full_load_interrupted": all_clean,
        "export_audit": f"""
            select "거래일자", status, fact_rows, fact_rows + more as mart_rows, status = 'same' as passed
            from (select "거래일자", count(*) as fact_rows,
                         case cast("거래일자" as varchar) when '{DAY}' then 'lost' when '{NEXT_DAY}' then 'doubled'
                              when '{RANGE[0]}' then 'changed' when '{MISSING_DAY}' then 'missing' else 'same' end as status,
                         case status when 'lost' then -1 when 'doubled' then 1 when 'missing' then -count(*) else 0 end as more
                  from {clean} group by "거래일자")""",
        "quarantine": f"""
            select "거래번호", 'number' as reason, '금액' as "column", true as has_line, "거래일자"
            from {clean} where cast("거래번호" as bigint) % 19 = 0""",
        "quarantine_report": f"""
            with lines as (select "거래일자" as day, cast("거래번호" as bigint) as number from {raw})
            select '{DAY}' as batch_date, case when count(*) > 0 then 'written' else 'no_data' end as status,
                   count(*) filter (number % 19 = 0) as rejected, cast(0 as bigint) as bad_fields,
                   count(*) filter (number % 19 = 0) as bad_amounts, cast(0 as bigint) as bad_labels, cast(0 as bigint) as bad_dates
            from lines where day = '{DAY}'
            union all select '{NO_DAY}', 'no_data', 0, 0, 0, 0, 0
            union all select null, 'written', count(*), 0, 0, 0, count(*) from lines where number % 3 = 0""",
    }
