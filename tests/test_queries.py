"""Every registered query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumensift.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, float):
            return "N" if math.isnan(x) else f"{x + 0.0:.9g}"
        return "N" if x is None else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name not in registry.SQL:
        assert got
        return
    result = duck.execute(registry.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == plain(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())


def test_contexts_of_source_list_are_bounded(spark, monkeypatch):
    given, real = [], registry.retrieve.contexts
    monkeypatch.setattr(registry.retrieve, "contexts", lambda parts: given.append(parts) or real(parts))
    registry.QUERIES["a14_source_list"](spark, DIR)
    assert max(r["count"] for r in given[0].groupBy("query_id").count().collect()) <= registry.retrieve.TOP_K


def test_filter_meets_by_equality(spark):
    plan = registry.QUERIES["f1_filter"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan
