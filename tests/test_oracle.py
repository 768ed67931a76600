"""Every registered query against its SQL in DuckDB, rows in any order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry

SF_DIR = "/root/testdata/sf0.01"
KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER",
    "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def test_every_query_has_sql():
    assert registry.ledger_queries().keys() == registry.ledger_sql().keys()


@pytest.mark.parametrize("name", registry.ledger_queries())
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF_DIR)
    want = duck.sql(registry.ledger_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS[t] for c, t in got.dtypes} == kinds
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = Counter(tuple(r) for r in got.select(*columns).collect())
    assert rows == Counter(want.project(quoted).fetchall())
    assert rows


def test_entry(spark):
    assert registry.entry(spark).count() == 35
