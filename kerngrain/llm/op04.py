"""Query op4: all documents packed into windows of 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._shared import table
from .packing import pack


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
