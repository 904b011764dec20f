"""Query op5: languages of documents; one of three folds is held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import crc_fold, table
from .language_id import identify

FOLDS, HELD_OUT = 3, 1


def training(docs: DataFrame) -> DataFrame:
    return docs.where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), training(docs))
    return found.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "cosine", "rejected")
