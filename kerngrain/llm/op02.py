"""Query op2: toxicity of documents; one of five folds of labels is held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import crc_fold, table
from .toxicity import score_toxicity

FOLDS, HELD_OUT = 5, 0


def training(labels: DataFrame) -> DataFrame:
    return labels.where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, training(table(spark, sf_dir, "labels")), carry=["doc_id"])
    return found.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted", "neighbours", "similarities")
