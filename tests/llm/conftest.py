from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4,3]")
        .appName("llm-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ["score", "size", "rank", "copies", "text_hash", "_row", "_part", "_doc", "class", "label", "window", "_key", "ids", "taught", "target"]


@pytest.fixture
def documents(spark):
    """Documents of (id, text, lang, source) tuples or texts, with columns of clashing names."""
    def make(rows, clash=True):
        rows = [r if isinstance(r, tuple) else (i, r, "en", "a") for i, r in enumerate(rows)]
        rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
        frame = spark.createDataFrame(rows, DOCUMENTS)
        from pyspark.sql import functions as F

        return frame.select("*", *[F.lit("x").alias(c) for c in CLASHING]) if clash else frame

    return make


@pytest.fixture
def folder(tmp_path):
    """A folder of Parquet tables, as the queries read it."""
    def make(**tables):
        for name, frame in tables.items():
            frame.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
