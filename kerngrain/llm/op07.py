"""Query op7: documents encoded and decoded by BPE with chunk reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._shared import table
from .chunk_bpe import encode_documents


def op7_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, digests=True, carry=["doc_id"])
