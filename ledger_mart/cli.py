"""Command line: one subcommand per job, run reports as JSON lines on stdout."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ledger_mart.operators.audit import partition_audit
from ledger_mart.plans.batch_date import checked_batch_date, resolve_batch_date
from ledger_mart.plans.end_to_end import daily_end_to_end, full_end_to_end
from ledger_mart.plans.export import export_full, export_partition
from ledger_mart.plans.load import backfill, daily_job, full_load
from ledger_mart.plans.report import RunReport, report_records
from ledger_mart.schema import DATE
from ledger_mart.session import build_session
from ledger_mart.sources.fact import read_fact


def _day(text: str) -> str:
    try:
        return checked_batch_date(text)
    except ValueError as error:
        raise argparse.ArgumentTypeError(str(error)) from error


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="ledger_mart", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(
        name: str, text: str, *, load: bool = True, export: bool = False
    ) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name, help=text)
        sub.add_argument("--input", required=True, help="path the job reads")
        sub.add_argument("--output", required=True, help="table the job writes")
        if load:
            sub.add_argument(
                "--as-scanned",
                action="store_true",
                help="no shuffle before the write; for raw files of few dates each",
            )
        if export:
            sub.add_argument("--export", required=True, help="mart to export to")
        return sub

    def dated(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--date", type=_day, help="YYYY-MM-DD, today if left out")

    def refreshing(sub: argparse.ArgumentParser) -> None:
        sub.add_argument(
            "--keep-if-empty",
            action="store_true",
            help="leave the table alone when the raw ledger is empty",
        )

    def rejecting(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--quarantine", help="table for lines that cannot be taken as they are")

    def mapped(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--date-map", help="table that tells which raw files may hold a date")

    def verified(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--verify", action="store_true", help="compare the mart with the rows that were exported")

    daily = job("daily", "load one date")
    dated(daily)
    mapped(daily)
    rejecting(daily)
    dated(job("daily-export", "load one date, check, export it", export=True))
    full = job("full", "replace the fact table by all dates")
    refreshing(full)
    rejecting(full)
    refreshing(job("full-export", "replace the fact table and the mart", export=True))
    dates = job("backfill", "load the given dates in one scan")
    dates.add_argument("--dates", required=True, nargs="+", type=_day)
    mapped(dates)
    rejecting(dates)
    one = job("export-date", "export one date of a fact table", load=False)
    dated(one)
    verified(one)
    whole = job("export", "export a whole fact table", load=False)
    verified(whole)
    whole.add_argument(
        "--columns",
        choices=["found", "plain", "flagged"],
        default="found",
        help="those of all files (reads every footer), or the contract's without or with the flag",
    )
    audit = jobs.add_parser("audit", help="rows per date of a fact table")
    audit.add_argument("--input", required=True)
    return parser


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    """The arguments, with the batch date resolved where the job has one."""
    args = _parser().parse_args(argv)
    if "date" in args:
        args.date = resolve_batch_date(args.date)
    return args


def run(spark: SparkSession, args: argparse.Namespace) -> Sequence[RunReport]:
    """The load or export that ``args`` ask for, on the caller's session."""
    source, target = args.input, args.output
    layout = {"gather": not getattr(args, "as_scanned", False)}
    refresh = {"allow_empty": not getattr(args, "keep_if_empty", False)}
    match args.job:
        case "daily":
            return [daily_job(spark, source, target, args.date, **layout, date_map=args.date_map, quarantine=args.quarantine)]
        case "daily-export":
            return daily_end_to_end(spark, source, target, args.export, args.date, **layout)
        case "full":
            return [full_load(spark, source, target, **refresh, **layout, quarantine=args.quarantine)]
        case "full-export":
            return full_end_to_end(spark, source, target, args.export, **refresh, **layout)
        case "backfill":
            return backfill(spark, source, target, args.dates, **layout, date_map=args.date_map, quarantine=args.quarantine)
        case "export-date":
            return [export_partition(spark, source, target, args.date, args.verify)]
        case "export":
            flagged = {"found": None, "plain": False, "flagged": True}[args.columns]
            return [export_full(spark, source, target, flagged, args.verify)]
        case _:
            raise ValueError(f"unknown job {args.job}")


def main(argv: Sequence[str] | None = None) -> None:
    args = parse(argv)
    spark = build_session(f"ledger_mart_{args.job}", getattr(args, "date", None))
    try:
        if args.job == "audit":
            audit = partition_audit(read_fact(spark, args.input, flagged=False))
            for row in audit.orderBy(DATE).collect():  # one row per date
                print(json.dumps({"date": row[DATE] and str(row[DATE]), "rows": row["row_count"]}))
        else:
            for record in report_records(spark, run(spark, args)):
                print(json.dumps(record, ensure_ascii=False))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
