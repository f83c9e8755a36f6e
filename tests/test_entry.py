"""Driver contract: entry smoke, registry shape, Spark vs DuckDB oracle on sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SF001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v          # values must agree bit for bit
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "park_id", "crowd_level"]
    assert df.count() > 0


def test_registry_covers_oracle():
    from crowdspark.plans.registry import ORACLE, QUERIES
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLE)              # every query of the library itself has SQL


ALL_ORACLE = sorted(entry.oracle_sql())


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


@pytest.mark.parametrize("name", ALL_ORACLE)
def test_oracle_equal(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.sql(entry.oracle_sql()[name])
    d_cols, d_types = rel.columns, [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == dict(zip(d_cols, d_types))
    assert _rows(df.columns, s_rows) == _rows(d_cols, d_rows)
