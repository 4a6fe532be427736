"""A corpus pipeline of four stages, each calling one operator of ``eventide.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm import op1_toxicity, op2_packing, op4_language, op8_simhash
from eventide.llm.common import read, written
from eventide.packaging import ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts toxic go; it learns from ``labels``."""
    labels = read(spark, sf_dir, "labels")
    model = op1_toxicity.train(*op1_toxicity.training_sample(
        docs, labels, "doc_id", "text", "toxic", op1_toxicity.TRAIN_ROWS))
    return op1_toxicity.keep_ordinary(docs, model)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or far from every learnt language go."""
    ship_package(spark)
    return op4_language.keep_known(docs, op4_language.profiles(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    ship_package(spark)
    return op8_simhash.first_of_groups(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents packed into training sequences."""
    ship_package(spark)
    return op2_packing.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("simhash_dedup", simhash_dedup), ("packing", packing)]

#: SQL cannot express the stages; ``tests/llm`` compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
