"""Query op12: a tenth of the documents, drawn toward the texts of the benchmark."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from ._shared import table
from .resampling import BUCKETS, SEED, resample

SHARE, LEAST_WORDS = Fraction(10, 100), 20


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resample(docs, table(spark, sf_dir, "benchmark"), SHARE, LEAST_WORDS, carry=["doc_id"])
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
#: The table of crc32 is made by its rule: eight steps of shift and exclusive or.
_STEP = "lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
ORACLE_SQL = f"""
WITH crc AS (SELECT list(c ORDER BY b) AS crc FROM (SELECT b, list_reduce(range(0, 8)::BIGINT[], {_STEP}, b::BIGINT) AS c FROM range(0, 256) t(b))),
w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM w),
distinct_words AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
bytes AS (SELECT word, list_transform(range(0, CAST(octet_length(encode(word)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM distinct_words),
bucket AS (SELECT word, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc[CAST((xor(c, x) & 255) + 1 AS BIGINT)]), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN bucket USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN bucket USING (word) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0)::BIGINT FROM s) AS ns, (SELECT coalesce(sum(t), 0)::BIGINT FROM t) AS nt),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ns + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (nt + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
weights AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT w.doc_id, coalesce(n, 0) AS n_features, coalesce((total - (((total % n) + n) % n)) // n, 0)::BIGINT AS weight, CAST('0x' || substr(sha256(concat('{SEED}:', w.doc_id)), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN weights ON w.doc_id = weights.doc_id),
final AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM final WHERE n_features >= {LEAST_WORDS})
SELECT final.doc_id, n_features, weight, score, CASE WHEN rank <= {SHARE.numerator} * total // {SHARE.denominator} THEN rank END AS rank FROM final LEFT JOIN ranked ON final.doc_id = ranked.doc_id
"""
