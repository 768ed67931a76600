"""A cluster whose shared folder is mounted on every machine, so that its paths begin with file:."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledger_mart import fixtures
from ledger_mart.schema import DATE
from ledger_mart.sinks.fact import replace_dates, replace_table
from ledger_mart.storage import in_shared_folder

SF_DIR = "/root/testdata/sf0.001"
WRITERS = ["daily_job", "full_load", "quarantine", "daily_job_mapped", "export_mixed", "file_inventory"]

FURTHER = [
    "backfill", "command_line", "daily_end_to_end", "dynamic_overwrite", "empty_batch", "export_audit", "export_full", "export_partition", "export_status",
    "fact_scan", "flag_types", "full_end_to_end", "full_load_interrupted", "mixed_fact_scan", "output_gate", "partition_audit", "quarantine_report",
    "rerun_idempotent", "run_report", "static_overwrite", "unparsed_dates",
]


@pytest.fixture
def mounted(spark, tmp_path, monkeypatch):
    """The session as one of a cluster that shares this folder."""
    folder, lets = tmp_path / "shared", "spark.sql.legacy.setCommandRejectsSparkCoreConfs"
    spark.conf.set(lets, "false")
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}/")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(fixtures, "_staged", {})  # made in this folder, and only for these tests
    yield folder
    spark.conf.unset("spark.checkpoint.dir")
    spark.conf.unset(lets)


@pytest.mark.parametrize("name", WRITERS)
def test_queries_write_to_a_mounted_shared_folder(spark, mounted, name):
    assert __spark_entry__.queries()[name](spark, SF_DIR).count() > 0


@pytest.mark.parametrize("name", FURTHER)
def test_further_queries_write_to_a_mounted_shared_folder(spark, mounted, name):
    assert __spark_entry__.queries()[name](spark, SF_DIR).count() > 0


def test_only_the_shared_folder_is_taken_for_shared(spark, mounted):
    assert in_shared_folder(spark, str(mounted / "a" / "b"))
    assert not in_shared_folder(spark, f"{mounted}-not/a")
    assert not in_shared_folder(spark, f"{mounted}/../a")


@pytest.mark.parametrize("write", [replace_dates, replace_table])
def test_other_local_folders_are_still_refused(spark, mounted, write):
    rows = spark.range(1).select("id", F.lit("2024-01-01").cast("date").alias(DATE))
    with pytest.raises(ValueError, match="local disk"):
        write(rows, str(mounted.parent / "fact"))
    write(rows, str(mounted / "fact"))
