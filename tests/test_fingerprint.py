from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledger_mart.fixtures import staged_ledger
from ledger_mart.operators.fingerprint import compare_tables, date_fingerprints
from ledger_mart.plans import export as exports
from ledger_mart.plans.export import ExportMismatchError, export_audit, export_full, export_partition
from ledger_mart.plans.load import daily_job, full_load
from ledger_mart.schema import AMOUNT, DATE, MEMO, TXN_NO
from ledger_mart.sinks.fact import replace_table
from ledger_mart.sources.fact import read_fact

SF_DIR = "/root/testdata/sf0.001"
DAY = "2024-01-03"


@pytest.fixture(scope="module")
def fact(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("print") / "fact")
    full_load(spark, staged_ledger(spark, SF_DIR), path)
    daily_job(spark, staged_ledger(spark, SF_DIR), path, DAY)
    return path


def amiss(audit):
    return {str(r[DATE]): r["status"] for r in audit.where("not passed").collect()}


def test_equal_tables_pass_whatever_their_order_and_files(spark, fact, tmp_path):
    mart = str(tmp_path / "mart")
    report = export_full(spark, fact, mart, verify=True)
    assert report.verified and report.rows == 1000
    assert amiss(export_audit(spark, fact, mart)) == {}
    replace_table(read_fact(spark, fact).repartition(7).sort(TXN_NO), mart)
    assert amiss(export_audit(spark, fact, mart)) == {}
    assert export_partition(spark, fact, mart, DAY, verify=True).verified
    assert export_partition(spark, fact, mart, "1999-01-01", verify=True).verified is None


def test_the_audit_names_the_dates(spark, fact, tmp_path):
    mart = str(tmp_path / "mart")
    days = [r[0] for r in read_fact(spark, fact).select(DATE).distinct().sort(DATE).collect()]
    first = read_fact(spark, fact).groupBy(DATE).agg(F.min(TXN_NO).alias("first"))
    whole = read_fact(spark, fact).join(first, DATE)
    is_first = F.col(TXN_NO) == F.col("first")
    on = lambda i: F.col(DATE) == F.lit(days[i])
    damaged = (
        whole.where(~(on(0) & is_first)).where(~on(3))
        .unionByName(whole.where(on(1) & is_first))
        .withColumn(AMOUNT, F.when(on(2) & is_first, F.col(AMOUNT) + 1).otherwise(F.col(AMOUNT)))
        .withColumn(MEMO, F.when(on(4) & is_first, None).otherwise(F.col(MEMO)))
        .unionByName(whole.where(on(5) & is_first).withColumn(DATE, F.lit("1990-01-01").cast("date")))
        .drop("first")
    )
    replace_table(damaged, mart)
    want = {str(days[0]): "lost", str(days[1]): "doubled", str(days[2]): "changed", str(days[3]): "missing", str(days[4]): "changed", "1990-01-01": "extra"}
    assert amiss(export_audit(spark, fact, mart)) == want


def test_each_table_is_read_once(spark, fact, tmp_path, capsys):
    export_full(spark, fact, str(tmp_path / "mart"))
    export_audit(spark, fact, str(tmp_path / "mart")).explain("formatted")
    assert capsys.readouterr().out.count("(1) Scan parquet") >= 1
    plan = export_audit(spark, fact, str(tmp_path / "mart"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_swapped_rows_and_nulls_change_the_fingerprint(spark):
    make = lambda rows: spark.createDataFrame(rows, f"`{DATE}` date, a string, b string")
    same = make([(None, "x", None), (None, None, "y")])
    assert amiss(compare_tables(same, make([(None, None, "y"), (None, "x", None)])).withColumn("passed", F.col("status") == "same")) == {}
    for other in ([(None, None, "x"), (None, "y", None)], [(None, "x", "y"), (None, None, None)], [(None, "x", None)] * 2):
        assert compare_tables(same, make(other)).first()["status"] == "changed"
    assert date_fingerprints(same.where("false")).count() == 0


def test_a_mart_with_other_rows_is_noticed(spark, fact, tmp_path, monkeypatch):
    mart = str(tmp_path / "mart")
    export_full(spark, fact, mart)
    real = exports.read_fact_partitions
    monkeypatch.setattr(exports, "read_fact_partitions", lambda s, p, d: real(s, p, d).union(real(s, p, d).limit(1)) if p == mart else real(s, p, d))
    with pytest.raises(ExportMismatchError, match=f"{DAY} doubled"):
        export_partition(spark, fact, mart, DAY, verify=True)
