"""Every registered query against its DuckDB twin, and the shape of its plan."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as registry
from conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
PLANS = registry.library_plans()
QUERIES = {name: run for plan in PLANS for name, run in plan.QUERIES.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    # a window without partition keys would gather a table in one task
    assert not re.search(r"windowspecdefinition\(([^,()]* (ASC|DESC) NULLS|specifiedwindowframe)", plan)
    if name not in ORACLES:
        assert rows
        return
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in rows) == expected


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert registry.entry(spark).count() == 1


def test_a_missing_library_costs_only_the_optional_queries(monkeypatch):
    real = registry.importlib.import_module

    def without(name, *args):
        if name in registry.OPTIONAL:
            raise ModuleNotFoundError("no such library")
        return real(name, *args)

    monkeypatch.setattr(registry.importlib, "import_module", without)
    with pytest.warns(UserWarning, match="left out"):
        left = registry.queries()
    assert set(left) == set(QUERIES)
