"""Every registered query against its SQL, on the smallest tables; and the contract of the entry module."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillmatch.plans import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def normal(v):
    if v is None:
        return ""
    if isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([normal(x) for x in v])
    try:
        return "nan" if math.isnan(v) else f"{round(float(v), 6) + 0.0:.6f}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(normal(r[i]) for i in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["a", "b", "token_cosine", "token_jaccard", "kgram_jaccard", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
