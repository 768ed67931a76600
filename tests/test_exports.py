from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledger_mart.fixtures import events_ledger, staged_ledger, write_raw_csv
from ledger_mart.operators.audit import NoOutputError, export_status
from ledger_mart.plans.end_to_end import daily_end_to_end, full_end_to_end
from ledger_mart.plans.export import export_full, export_partition
from ledger_mart.plans.load import daily_job, full_load
from ledger_mart.schema import DATE, FLAG, LABEL, RAW_COLUMNS
from ledger_mart.sources.fact import file_inventory, read_fact
from ledger_mart.storage import partition_count

SF_DIR = "/root/testdata/sf0.001"
DAY, NEXT_DAY, NO_DAY = "2024-01-03", "2024-01-04", "1999-01-01"


def rows(df):
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture
def raw(spark):
    return staged_ledger(spark, SF_DIR)


@pytest.fixture
def fact(tmp_path):
    return str(tmp_path / "fact")


@pytest.fixture
def mart(tmp_path):
    return str(tmp_path / "mart")


def test_full_export_equals_the_table(spark, raw, fact, mart):
    full_load(spark, raw, fact)
    report = export_full(spark, fact, mart)
    assert (report.status, report.rows) == ("exported", 1000)
    assert read_fact(spark, mart).columns == read_fact(spark, fact).columns
    assert rows(read_fact(spark, mart)) == rows(read_fact(spark, fact))


def test_full_export_keeps_the_flag_of_a_mixed_table(spark, raw, fact, mart):
    full_load(spark, raw, fact)
    daily_job(spark, raw, fact, DAY)
    export_full(spark, fact, mart)
    assert rows(read_fact(spark, mart)) == rows(read_fact(spark, fact, merge_schema=True))
    assert read_fact(spark, mart).where(F.col(FLAG).isNotNull()).count() == 35


def test_full_export_drops_what_the_table_lost(spark, raw, fact, mart):
    full_load(spark, raw, fact)
    export_full(spark, fact, mart)
    one = write_raw_csv(events_ledger(spark, SF_DIR).where(F.col(DATE) == DAY), f"{fact}-raw")
    full_end_to_end(spark, one, fact, mart)
    assert partition_count(spark, mart) == 1


def test_null_dates_are_exported(spark, edge_csv, fact, mart):
    full_end_to_end(spark, edge_csv, fact, mart)
    assert rows(read_fact(spark, mart)) == rows(read_fact(spark, fact))
    assert read_fact(spark, mart).where(F.col(DATE).isNull()).count() == 3


def test_partition_export_leaves_nothing_stale(spark, raw, fact, mart, tmp_path):
    daily_job(spark, raw, fact, DAY)
    daily_job(spark, raw, fact, NEXT_DAY)
    for day in (DAY, NEXT_DAY, DAY):
        export_partition(spark, fact, mart, day)
    assert rows(read_fact(spark, mart)) == rows(read_fact(spark, fact))
    changed = events_ledger(spark, SF_DIR).where(F.col(LABEL) == 1)
    daily_job(spark, write_raw_csv(changed, str(tmp_path / "new")), fact, DAY)
    report = export_partition(spark, fact, mart, DAY)
    assert report.rows == read_fact(spark, mart, [DAY]).count() < 35
    assert rows(read_fact(spark, mart)) == rows(read_fact(spark, fact))


def test_partition_export_has_the_columns_of_its_date(spark, raw, fact, mart):
    full_load(spark, raw, fact)
    daily_job(spark, raw, fact, DAY)
    export_partition(spark, fact, mart, DAY)
    assert FLAG in read_fact(spark, mart).columns
    export_partition(spark, fact, f"{mart}-2", NEXT_DAY)
    assert set(read_fact(spark, f"{mart}-2").columns) == set(RAW_COLUMNS)


def test_export_status(spark, raw, fact, mart):
    assert export_status(spark, fact, DAY) == "skipped"
    daily_job(spark, raw, fact, DAY)
    empty = Path(fact) / f"{DATE}={NEXT_DAY}"
    empty.mkdir()
    (empty / "notes.txt").touch()
    found = {d: export_partition(spark, fact, mart, d) for d in (DAY, NEXT_DAY, NO_DAY)}
    assert {d: (r.status, r.rows) for d, r in found.items()} == {
        DAY: ("exported", 35),
        NEXT_DAY: ("empty", 0),
        NO_DAY: ("skipped", 0),
    }
    assert partition_count(spark, mart) == 1
    none = file_inventory(spark, fact, [NEXT_DAY])
    assert none.isEmpty()
    assert none.dtypes == file_inventory(spark, fact).dtypes


@pytest.mark.parametrize("target", ["", "/", "/inside", "/.."])
def test_export_onto_its_own_source_is_refused(spark, raw, fact, target):
    daily_job(spark, raw, fact, DAY)
    before = rows(read_fact(spark, fact))
    with pytest.raises(ValueError):
        export_full(spark, fact, fact + target)
    with pytest.raises(ValueError):
        export_partition(spark, fact, fact + target, DAY)
    assert rows(read_fact(spark, fact)) == before


def test_daily_end_to_end(spark, raw, fact, mart):
    loaded, exported = daily_end_to_end(spark, raw, fact, mart, DAY)
    assert (loaded.status, loaded.rows) == ("written", 35)
    assert (exported.status, exported.rows) == ("exported", 35)
    loaded, exported = daily_end_to_end(spark, raw, fact, mart, NO_DAY)
    assert (loaded.status, exported.status) == ("no_data", "skipped")
    assert rows(read_fact(spark, mart)) == rows(read_fact(spark, fact))


def test_daily_end_to_end_stops_at_the_gate(spark, raw, fact, mart):
    with pytest.raises(NoOutputError):
        daily_end_to_end(spark, raw, fact, mart, NO_DAY)
    assert not Path(mart).exists()


def test_mart_outlives_a_table_that_was_emptied(spark, raw, fact, mart, tmp_path):
    full_end_to_end(spark, raw, fact, mart)
    empty = write_raw_csv(events_ledger(spark, SF_DIR).where("1 = 0"), str(tmp_path / "none"))
    loaded, exported = full_end_to_end(spark, empty, fact, mart, allow_empty=False)
    assert (loaded.status, exported.rows) == ("no_data", 1000)
    loaded, exported = full_end_to_end(spark, empty, fact, mart)
    assert (loaded.status, exported.status, exported.rows) == ("no_data", "empty", 0)
    assert partition_count(spark, mart) == 30
    assert export_full(spark, f"{fact}-none", mart).status == "empty"


@pytest.mark.parametrize("target", ["{raw}", "{raw}/mart", "{parent}", "{fact}", "{fact}/mart", "{parent}/r*"])
def test_no_end_to_end_run_touches_what_it_reads(spark, raw, fact, target):
    before = sorted(Path(raw).iterdir())
    export = target.format(raw=raw, parent=Path(raw).parent, fact=fact)
    with pytest.raises(ValueError):
        full_end_to_end(spark, raw, fact, export)
    with pytest.raises(ValueError):
        daily_end_to_end(spark, raw, fact, export, DAY)
    assert sorted(Path(raw).iterdir()) == before and not Path(fact).exists()


def test_declared_columns_spare_the_footer_pass(spark, raw, fact, mart):
    full_load(spark, raw, fact)
    daily_job(spark, raw, fact, DAY)

    def jobs(run, group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            run()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    found = jobs(lambda: export_full(spark, fact, f"{mart}-found"), "found")
    declared = jobs(lambda: export_full(spark, fact, mart, flagged=True), "declared")
    assert declared < found
    assert rows(read_fact(spark, mart)) == rows(read_fact(spark, f"{mart}-found")) == rows(read_fact(spark, fact))
