from __future__ import annotations

from collections import Counter
from datetime import date

import pytest
from ledger_csv import HEADER, write_csv

from ledger_mart.plans.load import backfill, daily_job, full_load
from ledger_mart.plans.report import reject_frame
from ledger_mart.schema import AMOUNT, DATE, LABEL, RAW_COLUMNS, TXN_NO
from ledger_mart.sources.fact import read_fact

DAY = "2024-12-30"


@pytest.fixture
def bad(edge_csv, tmp_path):
    return edge_csv, str(tmp_path / "fact"), str(tmp_path / "rejected")


def problems(spark, path):
    rows = spark.read.parquet(path).collect()
    return sorted((r[TXN_NO] or "", r["reason"], r["column"] or "", str(r[DATE])) for r in rows)


EDGE = sorted([
    ("T3", "number", AMOUNT, DAY),
    ("T4", "fields", "", DAY),
    ("T4", "number", AMOUNT, DAY),
    ("T6", "fields", "", "None"),
    ("T6", "date", DATE, "None"),
])


def test_full_load(spark, bad):
    raw, fact, rejected = bad
    plain = fact + "-plain"
    want = full_load(spark, raw, plain)
    report = full_load(spark, raw, fact, quarantine=rejected)
    found = problems(spark, rejected)
    assert [f for f in found if f[0] in ("T3", "T4", "T6")] == EDGE
    assert (report.status, report.rows) == (want.status, want.rows)
    rows = lambda p: Counter(tuple(r) for r in read_fact(spark, p).select(RAW_COLUMNS).collect())
    assert rows(fact) == rows(plain)
    counted = Counter((reason, column) for _, reason, column, _ in found)
    assert report.reasons == {
        "bad_fields": counted["fields", ""], "bad_amounts": counted["number", AMOUNT],
        "bad_labels": counted["number", LABEL], "bad_dates": counted["date", DATE],
    }
    assert report.rejected == len({f[0] for f in found})
    lines = {r[TXN_NO]: r["line"] for r in spark.read.parquet(rejected).collect()}
    assert lines["T3"] == "T3,2024-12-30,acc,C,abc,memo,p1,a1,1,dup"
    got = reject_frame(spark, [report]).first()
    assert (got["rejected"], got["bad_amounts"]) == (report.rejected, report.reasons["bad_amounts"])


def test_daily_job_replaces_its_date_only(spark, bad):
    raw, fact, rejected = bad
    report = daily_job(spark, raw, fact, DAY, quarantine=rejected)
    assert problems(spark, rejected) == [p for p in EDGE if p[3] == DAY]
    assert (report.rejected, report.reasons["bad_amounts"], report.reasons["bad_fields"]) == (2, 2, 1)
    daily_job(spark, raw, fact, DAY, quarantine=rejected)
    assert problems(spark, rejected) == [p for p in EDGE if p[3] == DAY]
    assert [r[DATE] for r in read_fact(spark, fact).select(DATE).distinct().collect()] == [date(2024, 12, 30)]


def test_a_mended_date_leaves_the_quarantine(spark, tmp_path):
    raw, fact, rejected = (str(tmp_path / n) for n in ("raw", "fact", "rejected"))
    line = "T1,{},acc,A,{},memo,p1,a1,0,"
    write_csv(tmp_path / "raw" / "a.csv", HEADER, line.format("2024-01-01", "x"), line.format("2024-01-02", "1.5"), line.format("2024-01-03", "7"))
    days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    reports = backfill(spark, raw, fact, days, quarantine=rejected)
    assert [r.rows for r in reports] == [1, 1, 1]
    assert [p[3] for p in problems(spark, rejected)] == days[:2]
    write_csv(tmp_path / "raw" / "a.csv", HEADER, line.format("2024-01-01", "5"), line.format("2024-01-02", "1.5"))
    assert daily_job(spark, raw, fact, days[0], quarantine=rejected).rejected == 0
    assert [p[3] for p in problems(spark, rejected)] == days[1:2]


def test_nothing_rejected(spark, tmp_path):
    write_csv(tmp_path / "raw" / "a.csv", HEADER, "T1,2024-01-01,acc,A,,memo,p1,a1,,")
    report = full_load(spark, str(tmp_path / "raw"), str(tmp_path / "fact"), quarantine=str(tmp_path / "rejected"))
    assert report.rejected == 0 and set(report.reasons.values()) == {0}
    assert full_load(spark, str(tmp_path / "raw"), str(tmp_path / "fact")).rejected is None
