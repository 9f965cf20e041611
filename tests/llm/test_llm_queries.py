"""The registered queries against their SQL, and their columns."""

import duckdb
import pytest

from conftest import DATA
from corpusloom.llm.queries import ORACLES, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    table = {"op2": "pages", "op10": "pages", "op11": "embeddings", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    counted = "600 * count(distinct coalesce(source, ''))" if name.startswith("op12_") else "count(*)"
    total = duck.execute(f"select {counted} from {table}").fetchone()[0]
    assert len(rows) == total or name.startswith("op9_") and len(rows) >= total
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        expected = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
        assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in rows) == expected
