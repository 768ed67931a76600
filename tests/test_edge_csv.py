"""What becomes of odd lines, on a small hand-written ledger."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import pytest

from ledger_csv import HEADER, write_csv
from ledger_mart.operators.audit import partition_audit
from ledger_mart.operators.transform import add_flag, cast_txn_date, clean, fill_nulls
from ledger_mart.plans.load import backfill, daily_job, full_load
from ledger_mart.schema import (
    AMOUNT, COUNTERPARTY, DATE, FLAG, LABEL, LABEL_TYPE, MEMO, RAW_COLUMNS, TXN_NO,
)
from ledger_mart.sources.fact import file_inventory, read_fact
from ledger_mart.sources.raw import read_raw
from ledger_mart.storage import partition_count


def by_number(df, *columns):
    return {r[TXN_NO]: tuple(r[c] for c in columns) for r in df.collect()}


def test_scan_is_permissive_and_positional(spark, edge_csv):
    raw = read_raw(spark, edge_csv)
    assert raw.columns == RAW_COLUMNS
    assert all(f.nullable for f in raw.schema)
    rows = by_number(raw, DATE, COUNTERPARTY, AMOUNT, MEMO, LABEL, LABEL_TYPE)
    assert len(rows) == raw.count() == 11
    assert rows["T1"] == ("2024-12-30", "A사", 1000, "memo", 0, None)
    assert rows["T2"] == ("2024-12-30", "B,사", None, None, None, None)
    assert rows["T3"] == ("2024-12-30", "C", None, "memo", 1, "dup")
    assert rows["T4"] == ("2024-12-30", "D", None, "memo", 1, None)
    assert rows["T5"] == ("2024-12-31", "E", 5_000_000_000, "memo", 5_000_000_000, "dup")
    assert rows["T6"] == ("2024/12/31", "F", 1, "memo", 1, "dup")
    assert rows[None] == ("2024-12-30", "G", 2, "memo", 0, None)
    assert rows["T8"][0] == " 2024-12-30"
    assert rows["T9"][0] is None
    assert rows["2024-12-30"] == ("T7", "K", 9, "memo", 0, None)


def test_corrupt_column_keeps_the_bad_lines(spark, edge_csv):
    raw = read_raw(spark, edge_csv, corrupt_column="line")
    bad = {r["line"].split(",")[0] for r in raw.collect() if r["line"]}
    assert bad == {"T3", "T4", "T6"}


def test_scan_takes_several_paths(spark, edge_csv):
    paths = [f"{edge_csv}/a.csv", f"{edge_csv}/b.csv"]
    assert read_raw(spark, paths).count() == 11


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_cleaning_does_not_depend_on_ansi_mode(spark, session_conf, edge_csv, ansi):
    session_conf({"spark.sql.ansi.enabled": ansi})
    facts = read_raw(spark, edge_csv).transform(clean).transform(add_flag)
    day = date(2024, 12, 30)
    assert by_number(facts, DATE, AMOUNT, LABEL, FLAG) == {
        "T1": (day, 1000, 0, 0),
        "T2": (day, 0, 0, 0),
        "T3": (day, 0, 1, 1),
        "T4": (day, 0, 1, 1),
        "T5": (date(2024, 12, 31), 5_000_000_000, 5_000_000_000, None),
        "T6": (None, 1, 1, 1),
        None: (day, 2, 0, 0),
        "T8": (day, 3, 0, 0),
        "T9": (None, 4, 0, 0),
        "T10": (date(2024, 1, 5), 4, 0, 0),
        "2024-12-30": (None, 9, 0, 0),
    }


def test_only_amount_and_label_are_filled(spark, edge_csv):
    raw = read_raw(spark, edge_csv)
    filled = by_number(fill_nulls(raw), DATE, MEMO, LABEL_TYPE, AMOUNT, LABEL)
    assert filled["T2"] == ("2024-12-30", None, None, 0, 0)
    assert filled["T9"][0] is None
    assert cast_txn_date(raw).columns == RAW_COLUMNS


def test_flag_before_the_fill_would_differ(spark, edge_csv):
    raw = read_raw(spark, edge_csv)
    assert by_number(add_flag(raw), FLAG)["T2"] == (None,)
    assert by_number(add_flag(clean(raw)), FLAG)["T2"] == (0,)


def test_full_load(spark, edge_csv, tmp_path):
    out = str(tmp_path / "fact")
    report = full_load(spark, edge_csv, out)
    assert (report.batch_date, report.status, report.rows) == (None, "written", 11)
    assert {p.name for p in Path(out).iterdir() if not p.name.startswith(".")} == {
        "_SUCCESS",
        f"{DATE}=2024-01-05",
        f"{DATE}=2024-12-30",
        f"{DATE}=2024-12-31",
        f"{DATE}=__HIVE_DEFAULT_PARTITION__",
    }
    fact = read_fact(spark, out)
    assert fact.columns == [c for c in RAW_COLUMNS if c != DATE] + [DATE]
    assert dict(fact.dtypes)[DATE] == "date"
    days = by_number(fact, DATE)
    assert {n for n, (d,) in days.items() if d == date(2024, 12, 30)} == {
        "T1", "T2", "T3", "T4", None, "T8",
    }
    assert {n for n, (d,) in days.items() if d is None} == {"T6", "T9", "2024-12-30"}


def test_daily_job_matches_the_date_text_exactly(spark, edge_csv, tmp_path):
    out = str(tmp_path / "fact")
    report = daily_job(spark, edge_csv, out, "2024-12-30")
    assert (report.status, report.rows, report.flagged) == ("written", 5, 2)
    assert by_number(read_fact(spark, out), AMOUNT, FLAG) == {
        "T1": (1000, 0), "T2": (0, 0), "T3": (0, 1), "T4": (0, 1), None: (2, 0),
    }
    assert not (Path(out) / "_SUCCESS").exists()


def test_flag_that_does_not_fit_is_null(spark, edge_csv, tmp_path):
    out = str(tmp_path / "fact")
    report = daily_job(spark, edge_csv, out, "2024-12-31")
    assert (report.rows, report.flagged) == (1, 0)
    assert by_number(read_fact(spark, out), LABEL, FLAG) == {"T5": (5_000_000_000, None)}


def test_rerun_leaves_other_dates(spark, edge_csv, tmp_path):
    out = str(tmp_path / "fact")
    for day in ("2024-12-30", "2024-12-31", "2024-12-31"):
        daily_job(spark, edge_csv, out, day)
    assert set(by_number(read_fact(spark, out), DATE)) == {"T1", "T2", "T3", "T4", None, "T5"}


def test_backfill_takes_dates_as_text_too(spark, edge_csv, tmp_path):
    out = str(tmp_path / "fact")
    reports = backfill(spark, edge_csv, out, ["2024-12-31", "2024-12-30", "2024-01-05"])
    assert [(r.batch_date, r.status, r.rows) for r in reports] == [
        ("2024-01-05", "no_data", 0),
        ("2024-12-30", "written", 5),
        ("2024-12-31", "written", 1),
    ]


# What Spark makes of a text, with ANSI mode on or off.
AMOUNT_TEXTS = {
    "7": 7,
    "-7": -7,
    "+7": 7,
    "007": 7,
    "9223372036854775807": 9223372036854775807,
    "9223372036854775808": None,
    "12.0": None,
    "1e3": None,
    "1,000": None,
    " 7": None,
    "": None,
}
DATE_TEXTS = {
    "2024-12-30": date(2024, 12, 30),
    " 2024-12-30 ": date(2024, 12, 30),
    "2024-1-5": date(2024, 1, 5),
    "2024-12-30T10:00:00": date(2024, 12, 30),
    "2024-12": date(2024, 12, 1),
    "2024/12/30": None,
    "20241230": None,
    "2024-02-30": None,
    "30.12.2024": None,
    "": None,
}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_amount_and_date_texts(spark, session_conf, tmp_path, ansi):
    session_conf({"spark.sql.ansi.enabled": ansi})
    write_csv(
        tmp_path / "raw" / "a.csv",
        HEADER,
        *[f'A{i},2024-12-30,acc,A,"{t}",m,p,a,0,' for i, t in enumerate(AMOUNT_TEXTS)],
        *[f'D{i},"{t}",acc,A,1,m,p,a,0,' for i, t in enumerate(DATE_TEXTS)],
    )
    raw = read_raw(spark, str(tmp_path / "raw"))
    amounts, dates = by_number(raw, AMOUNT), by_number(cast_txn_date(raw), DATE)
    assert {t: amounts[f"A{i}"][0] for i, t in enumerate(AMOUNT_TEXTS)} == AMOUNT_TEXTS
    assert {t: dates[f"D{i}"][0] for i, t in enumerate(DATE_TEXTS)} == DATE_TEXTS
    filled = by_number(clean(raw), AMOUNT)
    assert {t: filled[f"A{i}"][0] for i, t in enumerate(AMOUNT_TEXTS)} == {
        t: n or 0 for t, n in AMOUNT_TEXTS.items()
    }


def test_inventory_and_audit_know_the_null_partition(spark, edge_csv, tmp_path):
    out = str(tmp_path / "fact")
    full_load(spark, edge_csv, out)
    days = [date(2024, 1, 5), date(2024, 12, 30), date(2024, 12, 31), None]
    assert {r[DATE] for r in file_inventory(spark, out).collect()} == set(days)
    assert partition_count(spark, out) == 4
    counts = {r[DATE]: r["row_count"] for r in partition_audit(read_fact(spark, out)).collect()}
    assert counts == dict(zip(days, [1, 6, 1, 3]))
