"""Row placement before a date-partitioned write.

Written as scanned, every task makes a file for every date it meets. One shuffle of
the rows to be written bounds the number of files, and adaptive execution sizes the
writing tasks: small shuffle partitions share a task and large ones, be it one date
with a third of the table, are split over as many tasks as they need. The number of
shuffle partitions before that sizing is given here and not by the session, as dates
that share one are split together, each split then writing files of all of them.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_mart.schema import DATE, TXN_NO

SPLITS_HOT_PARTITIONS = [
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled",
]
#: Some for each date of five years; above this Spark keeps no exact sizes.
DATE_PARTITIONS = 2000
#: One date's rows go anywhere, so few will do; each scan task sends a block to each.
ROW_PARTITIONS = 200


def _rebalance(df: DataFrame, key: str, partitions: int) -> DataFrame:
    conf = df.sparkSession.conf
    off = [switch for switch in SPLITS_HOT_PARTITIONS if conf.get(switch, "true").lower() != "true"]
    if off:
        warnings.warn(
            f"{', '.join(off)} is off, so nothing would split a hot date: rows are written "
            "as scanned, a file for each scan task and date",
            stacklevel=3,
        )
        return df
    return df.hint("rebalance", partitions, F.col(key))


def gather_by_date(df: DataFrame, partitions: int = DATE_PARTITIONS) -> DataFrame:
    """For many dates: each task writes few of them."""
    return _rebalance(df, DATE, partitions)


def spread_one_date(df: DataFrame, partitions: int = ROW_PARTITIONS) -> DataFrame:
    """For a single date: tasks of even size, however the raw files held its rows."""
    return _rebalance(df, TXN_NO, partitions)
