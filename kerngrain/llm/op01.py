"""Query op1: pages to deduplicated WARC archives and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared_dir, table, written
from .warc import checked_revisits, read_warc, resolve_revisits, write_warc


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = pages.select(F.col("page_id").cast("long").alias("record_id"), F.col("url").cast("string").alias("target_uri"), F.col("html").cast("string").cast("binary").alias("payload"))
    path = f"{shared_dir(spark)}/warc"
    write_warc(resolve_revisits(records), path)
    headers = written(read_warc(spark, path, payloads=False), "headers")
    return checked_revisits(headers).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


#: DuckDB's SHA-1 is hexadecimal; five digits give four base32 letters.
ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest FROM d),
m AS (SELECT payload_digest, min(page_id) AS original FROM b GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to, target_uri
FROM b JOIN m USING (payload_digest)
"""
