from __future__ import annotations

import os
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from ledger_mart import lease as leases
from ledger_mart.fixtures import staged_ledger
from ledger_mart.lease import LeaseHeldError, held_parts, holder, lease
from ledger_mart.plans.export import export_full, export_partition
from ledger_mart.plans.load import backfill, daily_job, full_load

SF_DIR = "/root/testdata/sf0.001"
DAY, NEXT_DAY = "2024-01-03", "2024-01-04"


@pytest.fixture
def table(tmp_path):
    return str(tmp_path / "table")


def test_a_second_run_of_a_date_stops_before_it_writes(spark, table):
    raw = staged_ledger(spark, SF_DIR)
    with lease(spark, table, [DAY], owner="first"):
        for run in (
            lambda: daily_job(spark, raw, table, DAY),
            lambda: backfill(spark, raw, table, [NEXT_DAY, DAY]),
            lambda: full_load(spark, raw, table),
        ):
            with pytest.raises(LeaseHeldError, match="first"):
                run()
            assert not Path(table).exists()
        assert daily_job(spark, raw, table, NEXT_DAY).status == "written"
    assert daily_job(spark, raw, table, DAY).status == "written"
    assert not Path(table + "__leases").exists()


def test_a_run_of_the_whole_table_bars_dates(spark, table):
    raw = staged_ledger(spark, SF_DIR)
    full_load(spark, raw, table)
    with lease(spark, table + "-mart", owner="whole"):
        with pytest.raises(LeaseHeldError, match="whole"):
            export_partition(spark, table, table + "-mart", DAY)
        with pytest.raises(LeaseHeldError, match="whole"):
            export_full(spark, table, table + "-mart")
        assert held_parts(spark, table + "-mart") == [leases.WHOLE]
    assert export_partition(spark, table, table + "-mart", DAY).status == "exported"


def test_failed_runs_give_their_lease_back(spark, table):
    with pytest.raises(RuntimeError, match="inside"):
        with lease(spark, table, [DAY]):
            raise RuntimeError("inside")
    assert holder(spark, table, DAY) is None


def test_a_dead_owners_lease_lapses(spark, table):
    file = Path(table + "__leases") / DAY
    file.parent.mkdir(parents=True)
    file.write_text('{"owner": "dead", "lapses": 60}')
    with pytest.raises(LeaseHeldError, match="dead"):
        with lease(spark, table, [DAY]):
            pass
    os.utime(file, (time.time() - 61,) * 2)
    with lease(spark, table, [DAY], owner="next"):
        assert holder(spark, table, DAY) == "next"
    assert not file.exists()


def test_a_live_owner_renews_its_lease(spark, table):
    with lease(spark, table, [DAY], owner="slow", lapses=0.9):
        time.sleep(2)
        with pytest.raises(LeaseHeldError):
            with lease(spark, table, [DAY]):
                pass


def test_one_of_many_at_once_gets_it(spark, table):
    def take(i):
        try:
            with lease(spark, table, [DAY], owner=str(i)):
                time.sleep(1.5)
                return 1
        except LeaseHeldError:
            return 0

    for lapsed in (False, True):
        if lapsed:
            file = Path(table + "__leases") / DAY
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text('{"owner": "dead", "lapses": 1}')
            os.utime(file, (1, 1))
        with ThreadPoolExecutor(6) as pool:
            assert sum(pool.map(take, range(6))) == 1
