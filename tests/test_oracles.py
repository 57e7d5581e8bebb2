"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from newsdesk.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def canonical(rows):
    def cell(v):
        if v is None or v != v:
            return "null"
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA)
    if name not in catalogue.ORACLES:
        assert found.count() >= 0
        return
    columns = sorted(found.columns)
    wanted = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert canonical(tuple(r) for r in found.select(*columns).collect()) == canonical(wanted)


def test_plans(spark):
    """Anti and semi joins stay what they are, and nothing becomes a Cartesian product."""
    plan = lambda n: catalogue.QUERIES[n](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan("seed_missing") and "LeftSemi" in plan("seed_missing")
    assert "LeftAnti" in plan("existing_anti")
    for name in catalogue.QUERIES:
        assert "CartesianProduct" not in catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString(), name
