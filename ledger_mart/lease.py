"""Leases: who may write a date of a table, or all of it, at a time.

A lease is a small file beside the table, made in one step by whoever is first. Its holder touches it while
at work; not touched for the time it names, it has lapsed, and the next run takes it over. A run of one date
bars runs of the same date and of the whole table; a run of the whole table bars all others.
"""

from __future__ import annotations

import contextlib
import json
import socket
import threading
import time
import uuid
from collections.abc import Iterator, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ledger_mart.storage import (
    make_file,
    names_in,
    read_text,
    remove_empty_folder,
    remove_file,
    rename,
    touch,
    touched,
)

WHOLE = "whole-table"
LAPSE_SECONDS = 600


class LeaseHeldError(RuntimeError):
    """Another run writes the same part of the table."""


def _folder(table: str) -> str:
    return f"{table.rstrip('/')}__leases"


def holder(spark: SparkSession, table: str, part: str) -> str | None:
    """Who holds a live lease of a date, or of WHOLE."""
    path = f"{_folder(table)}/{part}"
    last = touched(spark, path)
    if last is None:
        return None
    text = read_text(spark, path)
    said = json.loads(text) if text else {}  # empty while it is being made
    if time.time() - last > said.get("lapses", LAPSE_SECONDS):
        return None
    return said.get("owner", "someone")


def held_parts(spark: SparkSession, table: str) -> list[str]:
    return [n for n in names_in(spark, _folder(table)) if "~" not in n and holder(spark, table, n)]


def _take(spark: SparkSession, table: str, part: str, text: str) -> bool:
    path = f"{_folder(table)}/{part}"
    if make_file(spark, path, text):
        return True
    if holder(spark, table, part):
        return False
    # lapsed: whoever moves it aside may make a new one; one made meanwhile is put back
    seen, aside = read_text(spark, path), f"{path}~{uuid.uuid4().hex}"
    with contextlib.suppress(Py4JJavaError, OSError):  # another run was first
        rename(spark, path, aside)
        if read_text(spark, aside) != seen:
            rename(spark, aside, path)
            return False
        remove_file(spark, aside)
    return make_file(spark, path, text)


@contextlib.contextmanager
def lease(
    spark: SparkSession,
    table: str,
    dates: Sequence[str] | None = None,
    owner: str | None = None,
    lapses: float = LAPSE_SECONDS,
) -> Iterator[None]:
    """Hold the given dates of a table, or all of it, or stop with LeaseHeldError.

    A lapsed lease is taken over. The lease is renewed while the block runs and given back at its end, also
    when it fails; a holder that dies gives it up by no longer renewing it.
    """
    owner = owner or f"{socket.gethostname()} {spark.sparkContext.applicationId} {uuid.uuid4().hex[:8]}"
    text = json.dumps({"owner": owner, "lapses": lapses})
    parts = sorted(set(dates)) if dates is not None else [WHOLE]
    mine: list[str] = []
    done = threading.Event()
    try:
        for part in parts:
            if not _take(spark, table, part, text):
                raise LeaseHeldError(f"{part} of {table} is held by {holder(spark, table, part)}")
            mine.append(part)
        # own first, then a look at the others: of two runs that bar each other at least one sees it
        others = held_parts(spark, table) if dates is None else [p for p in [WHOLE] if holder(spark, table, p)]
        barred = [p for p in others if p not in mine]
        if barred:
            raise LeaseHeldError(f"{barred[0]} of {table} is held by {holder(spark, table, barred[0])}")

        def renew() -> None:
            while not done.wait(lapses / 3):
                for part in mine:
                    with contextlib.suppress(Py4JJavaError):
                        touch(spark, f"{_folder(table)}/{part}")

        threading.Thread(target=renew, daemon=True).start()
        yield
    finally:
        done.set()
        for part in mine:
            path = f"{_folder(table)}/{part}"
            if read_text(spark, path) == text:  # else it lapsed and is another's by now
                remove_file(spark, path)
        remove_empty_folder(spark, _folder(table))
