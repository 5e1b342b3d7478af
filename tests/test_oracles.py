"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from tidemark.plans.catalog import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def shown(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    df.collect()
    assert len(set(df.columns)) == len(df.columns)


def test_plans_push_down_and_prune(spark):
    plan = QUERIES["scope_filter"](spark, DATA)._jdf.queryExecution().toString()
    assert "EqualTo(source,src4)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan
