from __future__ import annotations

import pytest
from ledger_csv import EDGE_LINES, HEADER, SWAPPED_HEADER, SWAPPED_LINES, write_csv
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4,3]")
        .appName("ledger-mart-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def session_conf(spark):
    """Set session options for one test."""
    changed = []

    def set_all(options):
        for key, value in options.items():
            changed.append((key, spark.conf.get(key)))
            spark.conf.set(key, value)

    yield set_all
    for key, value in reversed(changed):
        spark.conf.set(key, value)


@pytest.fixture
def edge_csv(tmp_path):
    """A ledger with one line for every way a line can be odd."""
    folder = tmp_path / "raw"
    write_csv(folder / "a.csv", HEADER, *EDGE_LINES)
    write_csv(folder / "b.csv", SWAPPED_HEADER, *SWAPPED_LINES)
    return str(folder)
