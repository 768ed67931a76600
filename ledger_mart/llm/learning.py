"""What the trained operators share: bounded samples and Nyström features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledger_mart.llm.common import unit_hash


def sample_by_class(rows: DataFrame, label: str, id_column: str, most: int) -> tuple[DataFrame, dict]:
    """About ``most`` rows at most, the classes as even as they allow, and the classes' counts.

    A row is in if the hash of its id is below its class's share, so the choice depends on
    the data alone and no class is sorted or gathered.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share, left, each = {}, len(counts), most
    for value, n in sorted(counts.items(), key=lambda x: x[1]):
        taken = min(n, each // left)
        share[value], each, left = taken / n, each - taken, left - 1
    below = F.lit(False)
    for value, part in share.items():
        below = below | ((F.col(label) == F.lit(value)) & (chance(id_column) < part))
    return rows.where(below), counts


def chance(id_column: str) -> Column:
    return unit_hash(F.concat(F.lit("sample:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))


def by_chance(rows: list[Row], id_column: str) -> list[Row]:
    """In an order that doesn't depend on the partitions."""
    from hashlib import md5

    return sorted(rows, key=lambda r: md5(str(r[id_column]).encode()).digest())


def whitening(kernel: np.ndarray) -> np.ndarray:
    """K^(-1/2) of the landmarks' kernel matrix, without its null space."""
    value, vector = np.linalg.eigh(kernel.astype(np.float64))
    kept = value > 1e-8 * max(value.max(), 1e-12)
    return vector[:, kept] / np.sqrt(value[kept])
