"""Query op10: near-duplicate classes of documents."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from ._shared import table
from .near_duplicates import near_duplicates


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=Fraction(4, 5))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
tokens AS (SELECT doc_id, hash(x) AS h, len(s) AS n FROM (SELECT doc_id, s, unnest(s) AS x FROM sets)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
pair AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT pair.b, reach.c FROM reach JOIN pair ON pair.a = reach.doc_id AND reach.c < pair.b)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(reach.c) AS component_id, sets.doc_id = min(reach.c) AS kept
FROM sets JOIN reach USING (doc_id) GROUP BY sets.doc_id, s
"""
