"""A corpus pipeline: language ID, toxicity, near-duplicates, packing; every stage works on what the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Documents go that are without a letter or far from every language (language ID), that score 0.5 or more (toxicity), and
that are near-duplicates of a document with a smaller id (one of each group stays). Edge cases: null or empty texts go with the
first stage, as no language is found; a null doc_id is kept by toxicity if its text is, and near-duplicates keep it only
where no document of its group has an id; rows that repeat a kept doc_id and its text are one document, of which one
stays. Extra columns come through all stages but the last. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerngrain.llm import op02, op05
from kerngrain.llm._shared import free_name, table, written
from kerngrain.llm.language_id import fit as fit_language
from kerngrain.llm.language_id import language
from kerngrain.llm.near_duplicates import near_duplicates
from kerngrain.llm.packing import pack
from kerngrain.llm.toxicity import with_toxicity


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; learns from the folds that op5 learns from."""
    model_at = spark.sparkContext.broadcast(fit_language(op05.training(docs)))
    return docs.where(~language(model_at, F.col("text"))["rejected"])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below 0.5; learns from the labels that op2 learns from."""
    found = free_name(docs, "found")
    return with_toxicity(docs, op02.training(table(spark, sf_dir, "labels")), found).where(F.col(found)["predicted"] == 0).drop(found)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: shingles of five words, a similarity of 0.8 or more."""
    row = free_name(docs, "row")
    # of the written table, so that rows keep their numbers; ids and numbers go through the operator, texts don't come back
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    best = F.min_by(row, F.struct(F.col("doc_id").cast("long").isNull(), F.col("doc_id").cast("long"), F.col(row)))
    keep = written(found.join(rows.select(row, "doc_id"), row).groupBy("group").agg(best.alias(row)).select(row), "kept")
    return rows.join(keep, row, "left_semi").drop(row)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token windows that hold the mixture of sources."""
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the models nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
