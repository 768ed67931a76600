"""From documents to packed training sequences.

Each stage works on all rows that the one before kept. All but the last return the
columns of documents. The stages set how many bytes of rows Spark sends to Python at a time, as texts may be long
and whoever writes a stage's rows makes the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_mart.llm import language, mixing, packing, partenum, toxicity
from ledger_mart.llm.common import BATCH_BYTES, MOST_BATCH, table, written
from ledger_mart.llm.queries import tokenizer

#: A prediction below this is no better than a guess against the language.
LEAST_LANGUAGE = 0.3
#: Deviations by which a text may be less familiar than texts of the learned languages; the least predictions
#: are 1 / languages, whatever the text, so that LEAST_LANGUAGE alone rejects next to nothing.
LEAST_FAMILIAR = -5.0


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one column beside its text, so that no other column's name is in the way."""
    docs.sparkSession.conf.set(BATCH_BYTES, MOST_BATCH)
    return docs.select(F.struct("*").alias("_doc"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that score as toxic, by a model of all labels."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(_whole(docs), model, keep=["_doc"])
    return scored.where(F.col("score") < toxicity.CUT).select("_doc.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents in which no known language is recognised. What is familiar is written between the two models:
    in one stage each core would run two Python workers, and all of them stay beside the stages that follow."""
    known = language.familiarity(_whole(docs), language.learn_familiar(docs), keep=["_doc"]).where(F.col("familiarity") >= LEAST_FAMILIAR)
    known = written(known.select("_doc"), "familiar")
    found = language.predict(known.select("_doc", "_doc.text"), language.learn(docs), keep=["_doc"])
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near copies."""
    return partenum.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    return mixing.emit(docs, mixing.systematic_mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences."""
    spark.conf.set(BATCH_BYTES, MOST_BATCH)
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
