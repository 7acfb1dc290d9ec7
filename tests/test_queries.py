"""Every query with a SQL twin against DuckDB on the smallest tables; the others run and have rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tideline import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return v + 0.0
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    mine = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    theirs = [tuple(norm(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall()]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(mine, key=order) == sorted(theirs, key=order)


@pytest.mark.parametrize("name", ["als_recommend", "als_rmse", "page_policy", "explanation_json", "objective_compare", "intent_cohort", "artifact_checks"])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
