"""The session profile of a standalone run.

Library functions take the caller's session and never change or stop it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

PROFILE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Scan tasks: an upper bound, reached only where the input is large for the
    # cores at hand. Fewer of them keep a large shuffle's blocks from being tiny.
    "spark.sql.files.maxPartitionBytes": "256m",
    # Shuffle partitions before adaptive sizing: some for each date of five years,
    # so that few dates share one, and no more than Spark keeps exact sizes of.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
    # Sizes of the writing tasks, and with them of the Parquet files: at most the
    # first, and less, down to the second, where cores would be idle.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32m",
}


def build_session(job: str, batch_date: str | None = None) -> SparkSession:
    """A session named after the job and its date, with the profile.

    Whatever ``spark-submit`` was given wins over the profile. Master, memory and
    executors are left to it altogether.
    """
    name = "_".join(filter(None, [job, batch_date]))
    spark = SparkSession.builder.appName(name).getOrCreate()
    submitted = spark.sparkContext.getConf()
    for key, value in PROFILE.items():
        if not submitted.contains(key):
            spark.conf.set(key, value)
    return spark
