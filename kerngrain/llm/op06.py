"""Query op6: licences of documents by canonical digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licences
from ._shared import table

ORACLE_SQL = licences.oracle_sql()


def op6_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))
