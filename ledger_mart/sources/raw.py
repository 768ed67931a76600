"""Raw ledger: directories of headered CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ledger_mart.schema import raw_schema


def read_raw(
    spark: SparkSession,
    path: str | Sequence[str],
    corrupt_column: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """All CSV files in ``path``, or with ``recursive`` also in folders below it, with the
    declared ledger schema.

    Columns bind by position and each file's header line is skipped, whatever it
    says. Text that is no long becomes NULL, short lines are padded with NULL and
    surplus fields are dropped; name a ``corrupt_column`` to keep such lines' text.
    Spark judges a line by the columns the query reads, so read them all for that.
    Plain files are split between tasks, so one huge file is no bottleneck; compressed
    ones are read whole, so let them be of moderate size.
    """
    reader = (
        spark.read.schema(raw_schema(corrupt_column))
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", recursive)
    )
    if corrupt_column:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.csv(path if isinstance(path, str) else list(path))
