"""Properties of the loads over the derived ledger."""

from __future__ import annotations

from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledger_mart.fixtures import events_ledger, staged_ledger, write_raw_csv
from ledger_mart.operators.audit import NoOutputError, output_gate, partition_audit
from ledger_mart.operators.transform import add_flag, clean, filter_batch_date
from ledger_mart.plans.export import export_full
from ledger_mart.plans.load import backfill, daily_job, full_load
from ledger_mart.plans.report import run_report
from ledger_mart.schema import AMOUNT, DATE, FLAG, LABEL, RAW_COLUMNS
from ledger_mart.sinks.fact import replace_dates, replace_table
from ledger_mart.sources.fact import file_inventory, read_fact
from ledger_mart.sources.raw import read_raw
from ledger_mart.storage import overlap, partition_count, require_shared

SF_DIR = "/root/testdata/sf0.001"
DAYS = ["2024-01-03", "2024-01-04", "2024-01-05"]
FLAGGED = [*RAW_COLUMNS, FLAG]


def rows(df, columns=FLAGGED):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def expected(spark, *days):
    ledger = events_ledger(spark, SF_DIR).where(F.col(DATE).isin(list(days)))
    return rows(ledger.transform(clean).transform(add_flag))


def parquet_files(path):
    return {str(p) for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def raw(spark):
    return staged_ledger(spark, SF_DIR)


@pytest.fixture
def out(tmp_path):
    return str(tmp_path / "fact")


def test_daily_job_twice_equals_once(spark, raw, out):
    first = daily_job(spark, raw, out, DAYS[0])
    once = rows(read_fact(spark, out))
    assert daily_job(spark, raw, out, DAYS[0]) == first
    assert rows(read_fact(spark, out)) == once == expected(spark, DAYS[0])


def test_backfill_equals_daily_jobs(spark, raw, out, tmp_path):
    one_by_one = str(tmp_path / "loop")
    loop = [daily_job(spark, raw, one_by_one, d) for d in DAYS]
    reports = backfill(spark, raw, out, list(reversed(DAYS)) + DAYS)
    assert reports == [replace(r, output_path=out) for r in loop]
    assert rows(read_fact(spark, out)) == rows(read_fact(spark, one_by_one))
    assert rows(read_fact(spark, out)) == expected(spark, *DAYS)


def test_different_dates_can_be_loaded_at_once(spark, raw, out):
    days = [f"2024-01-{d:02}" for d in range(3, 9)]
    with ThreadPoolExecutor(len(days)) as pool:
        reports = list(pool.map(lambda d: daily_job(spark, raw, out, d), days))
    assert [r.batch_date for r in reports] == days
    for report in reports:
        assert report.rows == sum(expected(spark, report.batch_date).values())
    assert rows(read_fact(spark, out)) == expected(spark, *days)


def test_dynamic_overwrite_leaves_the_files_of_other_dates(spark, raw, out):
    daily_job(spark, raw, out, DAYS[0])
    before = parquet_files(out)
    daily_job(spark, raw, out, DAYS[1])
    assert before < parquet_files(out)
    backfill(spark, raw, out, DAYS[1:])
    assert before < parquet_files(out)
    assert rows(read_fact(spark, out)) == expected(spark, *DAYS)


def test_static_overwrite_drops_other_dates(spark, out):
    ledger = events_ledger(spark, SF_DIR).transform(clean)
    replace_table(ledger, out)
    assert partition_count(spark, out) == 30
    replace_table(ledger.where(F.col(DATE) == F.lit(DAYS[0])), out)
    assert partition_count(spark, out) == 1


@pytest.mark.parametrize("session_mode", ["static", "dynamic"])
def test_session_overwrite_mode_does_not_matter(spark, session_conf, raw, out, session_mode):
    session_conf({"spark.sql.sources.partitionOverwriteMode": session_mode})
    full_load(spark, raw, out)
    daily_job(spark, raw, out, DAYS[0])
    assert partition_count(spark, out) == 30
    replace_dates(
        events_ledger(spark, SF_DIR).transform(filter_batch_date, DAYS[1]).transform(clean), out
    )
    assert partition_count(spark, out) == 30
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == session_mode


def test_empty_day_does_not_create_the_table(spark, raw, out):
    report = daily_job(spark, raw, out, "1999-01-01")
    assert (report.status, report.rows, report.flagged) == ("no_data", 0, 0)
    assert not Path(out).exists()
    assert [r.status for r in backfill(spark, raw, out, ["1999-01-01"])] == ["no_data"]
    assert not Path(out).exists()


def test_empty_day_leaves_an_existing_table(spark, raw, out):
    daily_job(spark, raw, out, DAYS[0])
    before = parquet_files(out)
    assert daily_job(spark, raw, out, "1999-01-01").status == "no_data"
    reports = backfill(spark, raw, out, ["1999-01-01", "1999-01-02"])
    assert [(r.status, r.rows) for r in reports] == [("no_data", 0)] * 2
    assert parquet_files(out) == before


def test_a_date_that_lost_its_rows_keeps_its_old_partition(spark, raw, out, tmp_path):
    daily_job(spark, raw, out, DAYS[0])
    without = events_ledger(spark, SF_DIR).where(F.col(DATE) != DAYS[0])
    shrunk = write_raw_csv(without, str(tmp_path / "shrunk"))
    reports = backfill(spark, shrunk, out, DAYS)
    assert [r.status for r in reports] == ["no_data", "written", "written"]
    assert rows(read_fact(spark, out)) == expected(spark, *DAYS)


def test_changed_input_replaces_the_date(spark, raw, out, tmp_path):
    daily_job(spark, raw, out, DAYS[0])
    changed = events_ledger(spark, SF_DIR).where(F.col(LABEL) == 1)
    report = daily_job(spark, write_raw_csv(changed, str(tmp_path / "new")), out, DAYS[0])
    fact = read_fact(spark, out)
    assert fact.count() == report.rows == report.flagged
    assert fact.agg(F.min(FLAG)).first()[0] == 1


def test_full_load_of_nothing_empties_the_table_unless_told_not_to(spark, raw, out, tmp_path):
    empty = write_raw_csv(events_ledger(spark, SF_DIR).where("1 = 0"), str(tmp_path / "empty"))
    full_load(spark, raw, out)
    assert full_load(spark, empty, out, allow_empty=False).status == "no_data"
    assert partition_count(spark, out) == 30
    assert full_load(spark, empty, out).status == "no_data"
    assert partition_count(spark, out) == 0
    assert [p.name for p in Path(out).iterdir() if not p.name.startswith(".")] == ["_SUCCESS"]


def test_daily_job_on_a_full_load_table(spark, raw, out):
    full_load(spark, raw, out)
    daily_job(spark, raw, out, DAYS[0])
    flagged = F.col(FLAG).isNotNull()
    day = F.col(DATE) == F.lit(DAYS[0]).cast("date")
    for fact in (
        read_fact(spark, out, flagged=True),
        read_fact(spark, out, merge_schema=True),
    ):
        assert fact.count() == 1000
        assert fact.where(flagged != day).isEmpty()
        assert rows(fact.where(flagged)) == expected(spark, DAYS[0])
    assert FLAG not in read_fact(spark, out, flagged=False).columns


def test_layout_does_not_change_the_rows(spark, raw, out, tmp_path):
    other = str(tmp_path / "other")
    full_load(spark, raw, out)
    full_load(spark, raw, other, gather=False)
    assert rows(read_fact(spark, out), RAW_COLUMNS) == rows(read_fact(spark, other), RAW_COLUMNS)
    backfill(spark, raw, out, DAYS)
    backfill(spark, raw, other, DAYS, gather=False)
    daily_job(spark, raw, other, DAYS[2], gather=False)
    assert rows(read_fact(spark, out, DAYS, flagged=True)) == rows(
        read_fact(spark, other, DAYS, flagged=True)
    )


def test_any_flag_step_can_be_used(spark, raw, out):
    def large(df):
        return df.withColumn(FLAG, (F.col(AMOUNT) > 1000).cast("int"))

    report = daily_job(spark, raw, out, DAYS[0], flag=large)
    fact = read_fact(spark, out)
    assert 0 < report.flagged == fact.where(F.col(AMOUNT) > 1000).count() < report.rows
    assert backfill(spark, raw, out, DAYS[:1], flag=large) == [report]


def test_a_flag_step_may_have_another_type_and_more_columns(spark, raw, out):
    def scored(df):
        return df.withColumn("score", F.lit(0.5)).withColumn(FLAG, F.col(LABEL))

    reports = backfill(spark, raw, out, DAYS, flag=scored)
    assert reports == [daily_job(spark, raw, out, d, flag=scored) for d in DAYS]
    assert dict(read_fact(spark, out).dtypes)["score"] == "double"


def test_flags_of_other_types_share_a_table(spark, raw, out):
    daily_job(spark, raw, out, DAYS[0])
    daily_job(spark, raw, out, DAYS[1], flag=lambda df: df.withColumn(FLAG, F.col(LABEL) * 3_000_000_000))
    daily_job(spark, raw, out, DAYS[2], flag=lambda df: df.withColumn(FLAG, F.col(LABEL) == 1).withColumn("extra", F.lit("x")))
    fact = read_fact(spark, out)
    assert dict(fact.dtypes)[FLAG] == "int" and "extra" in fact.columns
    assert fact.where((F.col(DATE) == DAYS[1]) & (F.col(LABEL) == 1)).select(FLAG).distinct().collect() == [(None,)]
    assert export_full(spark, out, f"{out}-mart").rows == read_fact(spark, out, flagged=True).count() == fact.count()


def test_a_default_read_has_every_column(spark, raw, out):
    full_load(spark, raw, out)
    daily_job(spark, raw, out, DAYS[0])
    fact = read_fact(spark, out)
    assert FLAG in fact.columns and fact.where(F.col(FLAG).isNotNull()).count() == sum(expected(spark, DAYS[0]).values())


@pytest.mark.parametrize("job", [full_load, daily_job, backfill])
def test_a_load_onto_its_own_input_is_refused(spark, raw, job):
    rest = {full_load: [], daily_job: [DAYS[0]], backfill: [DAYS]}[job]
    folder = Path(raw)
    for source, target in (
        (raw, raw), (raw, f"{raw}/fact"), (raw, str(folder.parent)),
        (f"{folder.parent}/*", raw), (f"{folder.parent}/*/", f"{folder.parent}/fact"),
        (f"{folder.parent.parent}/*/{folder.name}", str(folder.parent)),
        (f"{folder.parent.parent}/[!x]*/raw", f"{folder.parent}"),
        (f"{raw}/*.csv", raw),
    ):
        with pytest.raises(ValueError):
            job(spark, source, target, *rest)
    assert (folder / "_SUCCESS").exists() and list(folder.glob("*.csv"))


def test_a_first_run_without_rows_keeps_what_another_job_wrote(spark, raw, out, monkeypatch):
    """The folder of an empty first run goes, but not if it has filled meanwhile."""
    from ledger_mart.plans import load

    write = load.replace_dates

    def slow(facts, path):
        write(facts, path)
        daily_job(spark, raw, path, DAYS[0])

    monkeypatch.setattr(load, "replace_dates", lambda facts, path: (monkeypatch.undo(), slow(facts, path)))
    assert daily_job(spark, raw, out, "1999-01-01").status == "no_data"
    assert read_fact(spark, out).count() == sum(expected(spark, DAYS[0]).values())


def test_paths_of_other_stores_and_names_do_not_overlap(spark):
    assert not overlap(spark, "file:///a/b", "file:///a/bc")
    assert not overlap(spark, "/a/*/raw", "/a/b/fact")
    assert overlap(spark, "/a/{b,c}", "file:/a/c/d") and overlap(spark, "/a/b", "/a/b/")
    with pytest.raises(ValueError):
        overlap(spark, "/a/{b/x,c}", "/z")


def test_local_disks_are_refused_on_a_cluster(spark, tmp_path):
    cluster = SimpleNamespace(
        sparkContext=SimpleNamespace(master="yarn", _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc)
    )
    with pytest.raises(ValueError):
        require_shared(cluster, str(tmp_path))
    require_shared(spark, str(tmp_path))


def test_subfolders_are_read_if_asked(spark, raw, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "deeper").symlink_to(raw)
    assert read_raw(spark, str(tmp_path / "raw"), recursive=True).count() == 1000


@pytest.mark.parametrize("bad", ["20240103", "2024-1-3", "2024-01-03T00:00:00", "2024-02-30", ""])
def test_malformed_dates_are_refused(spark, raw, out, bad):
    with pytest.raises(ValueError):
        daily_job(spark, raw, out, bad)
    with pytest.raises(ValueError):
        backfill(spark, raw, out, [DAYS[0], bad])
    assert not Path(out).exists()


def test_backfill_needs_dates(spark, raw, out):
    with pytest.raises(ValueError):
        backfill(spark, raw, out, [])


def test_gate_ignores_markers(spark, out):
    with pytest.raises(NoOutputError):
        output_gate(spark, out)
    Path(out).mkdir()
    (Path(out) / "_SUCCESS").touch()
    with pytest.raises(NoOutputError):
        output_gate(spark, out)
    (Path(out) / f"{DATE}=2024-01-03").mkdir()
    assert output_gate(spark, out).first().asDict() == {"partitions": 1, "passed": True}


def test_audit_and_inventory(spark, raw, out):
    full_load(spark, raw, out)
    fact = read_fact(spark, out)
    counts = {r[DATE]: r["row_count"] for r in partition_audit(fact).collect()}
    assert len(counts) == 30 and sum(counts.values()) == 1000
    files = file_inventory(spark, out)
    assert {r["path"].removeprefix("file:") for r in files.collect()} == parquet_files(out)
    one = file_inventory(spark, out, DAYS[:1])
    assert {str(r[DATE]) for r in one.collect()} == {DAYS[0]}


def test_run_report_counts_partitions_and_files(spark, raw, out, tmp_path):
    jobs = [
        full_load(spark, raw, out),
        daily_job(spark, raw, out, "1999-01-01"),
        *backfill(spark, raw, out, DAYS),
        daily_job(spark, raw, str(tmp_path / "other"), DAYS[0]),
    ]
    got = run_report(spark, jobs).collect()
    sizes = [sum(expected(spark, d).values()) for d in DAYS]
    assert [(r["status"], r["rows"], r["partitions"]) for r in got] == [
        ("written", 1000, 30),
        ("no_data", 0, 30),
        *[("written", n, 30) for n in sizes],
        ("written", sizes[0], 1),
    ]
    assert [r["files"] for r in got] == [
        len(parquet_files(out)),
        0,
        *[len(parquet_files(f"{out}/{DATE}={d}")) for d in DAYS],
        len(parquet_files(tmp_path / "other")),
    ]
    assert run_report(spark, jobs[1:2]).first()["flagged"] == 0
