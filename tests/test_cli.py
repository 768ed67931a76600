from __future__ import annotations

import json
import os
import subprocess
import sys
from datetime import date
from pathlib import Path
from types import SimpleNamespace

import pytest

from ledger_mart import cli
from ledger_mart.fixtures import staged_ledger
from ledger_mart.plans.batch_date import resolve_batch_date
from ledger_mart.session import PROFILE
from ledger_mart.storage import scratch_path

REPO = Path(__file__).resolve().parents[1]
SF_DIR = "/root/testdata/sf0.001"


def test_override_wins_over_schedule_and_today():
    assert resolve_batch_date("2024-01-03", "2024-01-04") == "2024-01-03"
    assert resolve_batch_date(None, "2024-01-04") == "2024-01-04"
    assert resolve_batch_date() == date.today().isoformat()
    with pytest.raises(ValueError):
        resolve_batch_date("2024-01-03T00:00:00+00:00", "2024-01-04")


@pytest.mark.parametrize(
    "argv",
    [
        [],
        ["daily", "--input", "a"],
        ["daily", "--input", "a", "--output", "b", "--date", "20240103"],
        ["backfill", "--input", "a", "--output", "b"],
        ["daily-export", "--input", "a", "--output", "b"],
    ],
)
def test_bad_arguments_are_refused(argv):
    with pytest.raises(SystemExit):
        cli.main(argv)


def test_date_defaults_to_today():
    args = cli.parse(["daily", "--input", "a", "--output", "b"])
    assert args.date == date.today().isoformat()


def run_job(spark, *argv):
    return [(r.batch_date, r.status, r.rows) for r in cli.run(spark, cli.parse(argv))]


def test_every_job_has_a_subcommand(spark, tmp_path):
    raw, fact, mart = staged_ledger(spark, SF_DIR), str(tmp_path / "f"), str(tmp_path / "m")
    io = ["--input", raw, "--output", fact]
    day = ["--date", "2024-01-03"]
    assert run_job(spark, "daily", *io, *day) == [("2024-01-03", "written", 35)]
    assert run_job(spark, "daily-export", *io, "--export", mart, *day) == [
        ("2024-01-03", "written", 35),
        ("2024-01-03", "exported", 35),
    ]
    filled = run_job(spark, "backfill", *io, "--dates", "2024-01-03", "2024-01-04", "1999-01-01")
    assert [s for _, s, _ in filled] == ["no_data", "written", "written"]
    assert run_job(spark, "full", *io) == [(None, "written", 1000)]
    assert run_job(spark, "full-export", *io, "--export", mart, "--keep-if-empty") == [
        (None, "written", 1000),
        (None, "exported", 1000),
    ]
    out = ["--input", fact, "--output", mart]
    assert run_job(spark, "export-date", *out, *day) == [("2024-01-03", "exported", 35)]
    assert run_job(spark, "export", *out) == [(None, "exported", 1000)]
    assert run_job(spark, "export", *out, "--columns", "plain") == [(None, "exported", 1000)]
    with pytest.raises(ValueError):
        cli.run(spark, SimpleNamespace(job="other", input=fact, output=mart))


def test_command_line_run(spark, tmp_path):
    raw, fact = staged_ledger(spark, SF_DIR), str(tmp_path / "fact")
    run = subprocess.run(
        [sys.executable, "-m", "ledger_mart", "daily", "--input", raw,
         "--output", fact, "--date", "2024-01-03"],
        cwd=REPO, capture_output=True, text=True, timeout=300, check=True,
    )
    report = json.loads(run.stdout.splitlines()[-1])
    assert report["status"] == "written" and report["rows"] == 35
    assert report["partitions"] == 1 and report["files"] >= 1
    assert report["input_path"] == raw and report["output_path"] == fact


def test_submitted_settings_win_over_the_profile():
    mine = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    code = (
        "from ledger_mart.session import PROFILE, build_session\n"
        "spark = build_session('fds', '2024-01-03')\n"
        "print({k: spark.conf.get(k) for k in PROFILE}, spark.sparkContext.appName)\n"
    )
    run = subprocess.run(
        [sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=300,
        env={**os.environ, "PYSPARK_SUBMIT_ARGS": f"--conf {mine}=64m pyspark-shell"}, check=True,
    )
    assert run.stdout.strip() == f"{ {**PROFILE, mine: '64m'} } fds_2024-01-03"


def test_jobs_leave_the_session_alone(spark, tmp_path):
    before = dict(spark.sparkContext.getConf().getAll())
    options = [*PROFILE, "spark.sql.sources.partitionOverwriteMode"]
    values = [spark.conf.get(o) for o in options]
    fact = str(tmp_path / "fact")
    run_job(spark, "daily", "--input", staged_ledger(spark, SF_DIR), "--output", fact,
            "--date", "2024-01-03")
    assert [spark.conf.get(o) for o in options] == values
    assert dict(spark.sparkContext.getConf().getAll()) == before


def session(master, **conf):
    """As much of a session as the choice of the scratch folder looks at."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default)),
        sparkContext=SimpleNamespace(master=master),
    )


def test_scratch_lies_in_the_shared_folder():
    cluster = session("yarn", spark_checkpoint_dir="hdfs://shared/checkpoints/")
    first, second = scratch_path(cluster, "x"), scratch_path(cluster, "x")
    assert first != second
    assert first.startswith("hdfs://shared/checkpoints/ledger-mart/x-")


def test_scratch_on_this_machine_only_in_local_mode():
    assert not Path(scratch_path(session("local[2]"), "x")).exists()
    with pytest.raises(RuntimeError):
        scratch_path(session("yarn"), "x")
