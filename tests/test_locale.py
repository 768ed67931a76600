"""JVMs whose file names can't hold the Korean name of the date folders."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledger_mart import storage
from ledger_mart.schema import DATE, PLAIN_DATE
from ledger_mart.sinks.fact import replace_dates, replace_table
from ledger_mart.sources.fact import file_inventory, read_fact, read_fact_partitions
from ledger_mart.storage import can_spell, partition_count, remove_partition

HERE = Path(__file__).resolve().parent
DAYS = ["2024-01-01", "2024-01-02"]


@pytest.fixture
def unspelled(spark, monkeypatch):
    """The session as one in the POSIX locale."""
    monkeypatch.setitem(storage._spelled, spark.sparkContext.applicationId, False)


def facts(spark, *days):
    return spark.createDataFrame([(i, d) for i, d in enumerate(days)], "n int, day string").select("n", F.col("day").cast("date").alias(DATE))


def folders(path):
    return sorted(p.name for p in Path(path).iterdir() if p.is_dir())


def test_queries_equal_their_sql_in_the_posix_locale():
    wanted = "daily_job or full_load or quarantine or export_status or file_inventory or export_audit"
    call = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", str(HERE / "test_oracle.py"), "-k", f"test_query_equals_sql and ({wanted})"]
    done = subprocess.run(call, env=os.environ | {"LC_ALL": "C"}, cwd=HERE.parent, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout[-3000:]


def test_a_session_that_can_spell_keeps_the_korean_name(spark, tmp_path):
    assert can_spell(spark)
    replace_dates(facts(spark, *DAYS), str(tmp_path / "fact"))
    assert folders(tmp_path / "fact") == [f"{DATE}={d}" for d in DAYS]


@pytest.mark.parametrize("encoding, holds", [("ANSI_X3.4-1968", False), ("UTF-8", True), ("EUC-KR", True), (None, False)])
def test_encodings_of_file_names(encoding, holds):
    assert storage._holds(encoding, DATE) is holds


def test_a_table_keeps_the_name_it_was_written_with(spark, tmp_path, monkeypatch):
    table, app = str(tmp_path / "fact"), spark.sparkContext.applicationId
    with monkeypatch.context() as posix:
        posix.setitem(storage._spelled, app, False)
        replace_table(facts(spark, DAYS[0]), table)
    replace_dates(facts(spark, DAYS[1]), table)  # by a session that could spell the other one
    assert folders(table) == [f"{PLAIN_DATE}={d}" for d in DAYS]
    assert [str(r[DATE]) for r in read_fact(spark, table).orderBy(DATE).collect()] == DAYS
    assert read_fact(spark, table, dates=DAYS[1:]).columns == ["n", DATE]
    assert read_fact_partitions(spark, table, DAYS[:1]).count() == file_inventory(spark, table, DAYS[:1]).count() == 1
    assert partition_count(spark, table) == 2
    remove_partition(spark, table, DAYS[0])
    assert folders(table) == [f"{PLAIN_DATE}={DAYS[1]}"]


def test_a_table_of_the_korean_name_is_not_mixed(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "fact")
    replace_dates(facts(spark, DAYS[0]), table)
    monkeypatch.setitem(storage._spelled, spark.sparkContext.applicationId, False)
    with pytest.raises(ValueError, match="UTF-8 locale"):
        replace_dates(facts(spark, DAYS[1]), table)


def test_other_stores_take_the_korean_name(spark, unspelled):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.names.link./here", "file:///tmp")
    assert storage.date_key(spark, "viewfs://names/here/nothing") == DATE
    assert storage.date_key(spark, "/tmp/nothing") == PLAIN_DATE
