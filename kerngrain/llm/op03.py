"""Query op3: quality rules on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._shared import table
from .fertility import quality


def op3_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measures = [f"{m}{name}" for name in ("", "_bytes") for m in ("chars_per_token", "byte_share", "entropy")]
    return quality(docs, carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *measures, "band_group")
