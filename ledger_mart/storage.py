"""Metadata-only questions to the file system that holds a table.

These go through Hadoop's FileSystem, so they work on whatever store the paths
name. Nothing here opens a data file, and only booleans, counts and single paths
reach the driver's Python.
"""

from __future__ import annotations

import codecs
import contextlib
import os
import tempfile
import time
import uuid

from itertools import combinations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ledger_mart.schema import DATE, PLAIN_DATE

_spelled: dict[str, bool] = {}


def _resolve(spark: SparkSession, path: str):
    sc = spark.sparkContext
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _resolve(spark, path)
    return fs.exists(hadoop_path)


def _holds(encoding: str | None, text: str) -> bool:
    """Whether file names of this encoding can hold a text; one that Python doesn't know is taken to."""
    try:
        codecs.lookup(encoding or "ascii")
    except LookupError:
        return True
    return text.encode(encoding or "ascii", "ignore").decode(encoding or "ascii") == text


def can_spell(spark: SparkSession) -> bool:
    """Whether the JVMs of driver and executors, started in whatever locale, can name a local folder
    after DATE. Asked once per application, in a job of a task for each core."""
    app = spark.sparkContext.applicationId
    if app not in _spelled:
        tasks, name = spark.sparkContext.defaultParallelism, "sun.jnu.encoding"
        asked = spark.range(0, tasks, 1, tasks).selectExpr(f"reflect('java.lang.System', 'getProperty', '{name}') as name")
        found = {r["name"] for r in asked.distinct().collect()} | {spark.sparkContext._jvm.java.lang.System.getProperty(name)}
        _spelled[app] = all(_holds(encoding, DATE) for encoding in found)
    return _spelled[app]


def date_key(spark: SparkSession, table: str) -> str:
    """What the date folders of a table are named after: DATE, on any store that takes it.

    On a local file system it is PLAIN_DATE where the JVMs can't spell DATE, and for a table that was
    written so; a table has folders of one kind.
    """
    fs, hadoop_path = _resolve(spark, table)
    uri = fs.makeQualified(hadoop_path).toUri()
    if uri.getScheme() != "file":
        return DATE
    try:  # not through Hadoop, which leaves out names that it can't spell
        there = {name.partition("=")[0] for name in os.listdir(uri.getPath()) if "=" in name}
    except (FileNotFoundError, NotADirectoryError):
        there = set()
    if PLAIN_DATE in there:
        return PLAIN_DATE
    if can_spell(spark):
        return DATE
    if DATE in there:
        raise ValueError(f"{table} has folders named {DATE}, which needs JVMs in a UTF-8 locale")
    return PLAIN_DATE


def partition_path(spark: SparkSession, table: str, batch_date: str) -> str:
    return f"{table.rstrip('/')}/{date_key(spark, table)}={batch_date}"


def partition_count(spark: SparkSession, table: str) -> int:
    """Number of date directories under ``table``; ``_SUCCESS`` is not one.

    One directory listing. A missing table has none.
    """
    fs, hadoop_path = _resolve(spark, table)
    if not fs.exists(hadoop_path):
        return 0
    only_dates = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobFilter(f"{date_key(spark, table)}=*")
    return len(fs.listStatus(hadoop_path, only_dates))


def _parts(spark: SparkSession, path: str) -> list[str]:
    """Store and path components; components may hold glob characters."""
    fs, hadoop_path = _resolve(spark, path)
    uri = fs.makeQualified(hadoop_path).toUri()
    resolved = [p for p in uri.getPath().split("/") if p]
    if any(p.count("{") != p.count("}") for p in resolved):
        raise ValueError(f"{path}: braces around a slash can't be told apart from other paths")
    return [f"{uri.getScheme()}://{uri.getAuthority() or ''}", *resolved]


def overlap(spark: SparkSession, left: str, right: str) -> bool:
    """Whether one path is, holds or lies in the other, now or for any match of a glob.

    Component by component either may match the other as a pattern; nothing is listed,
    so a glob also covers what doesn't exist yet.
    """
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern
    pairs = zip(_parts(spark, left), _parts(spark, right))
    return all(a == b or glob(a).matches(b) or glob(b).matches(a) for a, b in pairs)


def require_apart(spark: SparkSession, *paths: str) -> None:
    """Refuse a job any two of whose paths overlap; it would read or replace what it writes."""
    for left, right in combinations(paths, 2):
        if overlap(spark, left, right):
            raise ValueError(f"{right} overlaps {left}, which the same job uses")


def require_shared(spark: SparkSession, path: str) -> None:
    """Refuse to write to a local disk from a cluster, where each executor has its own."""
    fs, hadoop_path = _resolve(spark, path)
    local = fs.makeQualified(hadoop_path).toUri().getScheme() == "file"
    if local and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{path} is a local disk, a different one for each executor")


def in_shared_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path lies in the folder that ``spark.checkpoint.dir`` names: all executors share it,
    also where it is one that is mounted on each machine and so looks like a local disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        return False
    shared = _parts(spark, named)
    return _parts(spark, path)[: len(shared)] == shared


def require_target(spark: SparkSession, path: str) -> None:
    """Refuse to write where executors would not see each other's files."""
    if not in_shared_folder(spark, path):
        require_shared(spark, path)


def has_atomic_rename(spark: SparkSession, path: str) -> bool:
    """Whether a folder of this store changes its name in one step; object stores copy file by file."""
    fs, hadoop_path = _resolve(spark, path)
    return fs.makeQualified(hadoop_path).toUri().getScheme() in ("file", "hdfs", "viewfs")


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder to a name that nothing has yet."""
    fs, old = _resolve(spark, source)
    _, new = _resolve(spark, target)
    if fs.exists(new) or not fs.rename(old, new):
        raise OSError(f"{source} could not be renamed to {target}")


def siblings(spark: SparkSession, path: str, mark: str) -> list[str]:
    """Paths beside ``path`` that have its name and then ``mark``."""
    fs, hadoop_path = _resolve(spark, path.rstrip("/"))
    folder = hadoop_path.getParent()
    if not fs.exists(folder):
        return []
    name = hadoop_path.getName() + mark
    return [f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith(name)]


def remove_sibling(spark: SparkSession, path: str, mark: str, sibling: str) -> None:
    """Delete something beside ``path`` that has its name and then ``mark``; nothing else."""
    fs, hadoop_path = _resolve(spark, sibling)
    if not hadoop_path.getName().startswith(path.rstrip("/").rsplit("/", 1)[-1] + mark):
        raise ValueError(f"{sibling} is nothing of {path}")
    fs.delete(hadoop_path, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The first line of a small file, None if there is none."""
    fs, hadoop_path = _resolve(spark, path)
    if not fs.exists(hadoop_path):
        return None
    java = spark.sparkContext._jvm.java.io
    with contextlib.closing(java.BufferedReader(java.InputStreamReader(fs.open(hadoop_path), "UTF-8"))) as reader:
        return reader.readLine() or ""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that other readers see whole or not at all."""
    fs, hadoop_path = _resolve(spark, path)
    draft = hadoop_path.suffix(f"-{uuid.uuid4().hex}")
    with contextlib.closing(fs.create(draft, False)) as out:
        out.write(bytearray(text, "utf-8"))
    if fs.exists(hadoop_path):
        fs.delete(hadoop_path, False)
    if not fs.rename(draft, hadoop_path):
        raise OSError(f"{path} could not be written")


def make_file(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file in one step, unless something of its name is there: then False."""
    fs, hadoop_path = _resolve(spark, path)
    uri = fs.makeQualified(hadoop_path).toUri()
    if uri.getScheme() == "file":  # Hadoop's local file system looks first and writes then
        while True:
            fs.mkdirs(hadoop_path.getParent())
            try:
                handle = os.open(uri.getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            except FileNotFoundError:  # the empty folder was removed meanwhile
                continue
            with os.fdopen(handle, "w") as out:
                out.write(text)
            return True
    try:
        with contextlib.closing(fs.create(hadoop_path, False)) as out:
            out.write(bytearray(text, "utf-8"))
    except Py4JJavaError:
        if fs.exists(hadoop_path):
            return False
        raise
    return True


def remove_file(spark: SparkSession, path: str) -> None:
    """Delete a file; a folder that holds anything is refused by the store."""
    fs, hadoop_path = _resolve(spark, path)
    fs.delete(hadoop_path, False)


def touch(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _resolve(spark, path)
    fs.setTimes(hadoop_path, int(time.time() * 1000), -1)


def touched(spark: SparkSession, path: str) -> float | None:
    """When the file was last written or touched, in seconds; None if there is none."""
    fs, hadoop_path = _resolve(spark, path)
    return fs.getFileStatus(hadoop_path).getModificationTime() / 1000 if fs.exists(hadoop_path) else None


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop_path = _resolve(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(hadoop_path)] if fs.exists(hadoop_path) else []


def remove_partition(spark: SparkSession, table: str, batch_date: str) -> None:
    """Delete one date of a table."""
    fs, hadoop_path = _resolve(spark, partition_path(spark, table, batch_date))
    fs.delete(hadoop_path, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _resolve(spark, path)
    fs.mkdirs(hadoop_path)


def remove_empty_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder unless something is in it, be it from another job meanwhile."""
    fs, hadoop_path = _resolve(spark, path)
    if fs.exists(hadoop_path) and len(fs.listStatus(hadoop_path)) == 0:
        with contextlib.suppress(Py4JJavaError):  # filled meanwhile: then it stays
            fs.delete(hadoop_path, False)


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table under a scratch path; any other path is refused."""
    if "/ledger-mart/" not in path:
        raise ValueError(f"{path} is no scratch path")
    fs, hadoop_path = _resolve(spark, path)
    fs.delete(hadoop_path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path for intermediate tables.

    It lies in the folder the cluster shares through ``spark.checkpoint.dir``. A
    folder of this machine is used only in local mode with that setting unset.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="ledger-mart-")
    return f"{shared.rstrip('/')}/ledger-mart/{label}-{uuid.uuid4().hex}"
