"""Query op8: the main text of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._shared import table
from .wrappers import extract


def op8_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
