"""Replacing a whole table without a moment in which it is not there.

The new table is written beside the old one, under a name of its own. A marker, a small file that
comes into being in one step, then says which folder holds the table, and from there on every reader of
this library has the new one whole; until then it has the old one whole. Where the store renames folders in one
step the new folder then takes the table's own name, for readers that know nothing of markers, and the marker goes.
Elsewhere the marker stays, and what it no longer names is removed when the next run begins.

A run may die anywhere: before the marker its folder is rubbish; with the marker the next run finishes what it
left. Readers that already hold the old table's files lose them, as with any replacement.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ledger_mart.storage import (
    has_atomic_rename,
    path_exists,
    read_text,
    remove_sibling,
    rename,
    require_target,
    siblings,
    write_text,
)

MARKER, NEXT, OLD = "__current", "__next-", "__old-"
Made = TypeVar("Made")


def _beside(path: str, name: str) -> str:
    return path.rstrip("/") + name


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the table now."""
    folder = read_text(spark, _beside(path, MARKER))
    return folder if folder and path_exists(spark, folder) else path


def reading(spark: SparkSession, path: str, make: Callable[[str], Made]) -> Made:
    """What ``make`` gives for the table's folder; once more if that took the table's name meanwhile."""
    folder = current(spark, path)
    try:
        return make(folder)
    except AnalysisException:
        if folder == path or path_exists(spark, folder):
            raise
        return make(path)


def settle(spark: SparkSession, path: str) -> None:
    """Give the folder that the marker names the table's own name."""
    marker = _beside(path, MARKER)
    folder = read_text(spark, marker)
    if folder is None or not has_atomic_rename(spark, path):
        return
    if folder and path_exists(spark, folder):
        if path_exists(spark, path):
            rename(spark, path.rstrip("/"), _beside(path, OLD + uuid.uuid4().hex))
        rename(spark, folder, path.rstrip("/"))
    remove_sibling(spark, path, MARKER, marker)


def recover(spark: SparkSession, path: str) -> None:
    """Finish what a dead run published, and remove what it or earlier runs left. Not while another
    run replaces the table."""
    settle(spark, path)
    kept = current(spark, path).rstrip("/").rsplit("/", 1)[-1]
    for mark in (NEXT, OLD):
        for left in siblings(spark, path, mark):
            if left.rsplit("/", 1)[-1] != kept:
                remove_sibling(spark, path, mark, left)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replace the table at ``path`` by what ``write`` writes to the folder it is given."""
    require_target(spark, path)
    recover(spark, path)
    folder = _beside(path, NEXT + uuid.uuid4().hex)
    write(folder)
    if has_atomic_rename(spark, path) and not path_exists(spark, path):
        rename(spark, folder, path.rstrip("/"))
        return
    write_text(spark, _beside(path, MARKER), folder)
    settle(spark, path)
    if current(spark, path) == path:
        recover(spark, path)
