"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import kerngrain.plans.stream_queries  # noqa: F401
from kerngrain.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def text(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted("|".join(text(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert rows == sorted("|".join(text(r[names.index(c)]) for c in cols) for r in found.fetchall())
