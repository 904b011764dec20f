"""Query op11: secrets of documents, and weak parts of credentials that stand together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from .credentials import ASSIGN_LEAST, BASE, BREAK, COMPLEMENT, KINDS, REACH, find_secrets, spans_text


def op11_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _near(kind: str) -> str:
    others = f"CASE WHEN kind IN ({', '.join(map(_literal, COMPLEMENT[kind]))})"
    return f"(kind = '{kind}' AND coalesce(\"start\" - max({others} THEN \"end\" END) OVER up <= {REACH}, false) OR kind = '{kind}' AND coalesce(min({others} THEN \"start\" END) OVER down - \"end\" <= {REACH}, false))"


_ALL = {**KINDS, "break": BREAK}
_IS_BASE = "kind IN (" + ", ".join(map(_literal, BASE)) + ")"
_EACH = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS k, '{kind}' AS kind, string_split_regex(text, {_literal(p)}) AS b, regexp_extract_all(text, {_literal(p)}, 0) AS m, regexp_extract_all(text, {_literal(p)}, {2 if kind == 'assign' else 0}) AS v FROM d"
    for i, (kind, p) in enumerate(_ALL.items())
)
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS ({_EACH}),
f AS (SELECT doc_id, k, kind, unnest(range(1, len(m) + 1)) AS i, b, m, v FROM e WHERE len(m) > 0),
g AS (SELECT doc_id, k, kind, i, length(b[i]) AS before, length(m[i]) AS own, length(v[i]) AS value FROM f),
h AS (SELECT *, sum(before + own) OVER (PARTITION BY doc_id, k ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM g),
p AS (SELECT doc_id, k, kind, "end" - own AS "start", "end" FROM h WHERE kind <> 'assign' OR value >= {ASSIGN_LEAST}),
q AS (SELECT *, count(*) FILTER (kind = 'break') OVER up AS scope,
    coalesce(max(CASE WHEN {_IS_BASE} THEN "end" END) OVER up > "start" OR min(CASE WHEN {_IS_BASE} THEN "start" END) OVER down < "end", false) AS under
  FROM p WINDOW up AS (PARTITION BY doc_id ORDER BY "start" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY doc_id ORDER BY "start" RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
r AS (SELECT * FROM q WHERE kind <> 'break' AND ({_IS_BASE} OR NOT under)),
s AS (SELECT *, {' OR '.join(map(_near, COMPLEMENT))} AS near
  FROM r WINDOW up AS (PARTITION BY doc_id, scope ORDER BY "start" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY doc_id, scope ORDER BY "start" RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', "start", ':', "end"), ',' ORDER BY "start", k) FILTER ({_IS_BASE}) AS base, string_agg(concat(kind, ':', "start", ':', "end"), ',' ORDER BY "start", k) AS spans
  FROM s WHERE {_IS_BASE} OR near GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (doc_id)
"""
