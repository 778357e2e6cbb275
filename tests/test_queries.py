"""Registered queries against their SQL in DuckDB, at the smallest scale."""

import glob
import os

import pytest
from conftest import SF

duckdb = pytest.importorskip("duckdb")
from lodestar.plans import queries as plans  # noqa: E402


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted([tuple(value(r[i]) for i in order) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    out = plans.QUERIES[name](spark, SF)
    want = con.execute(plans.SQL[name])
    assert rows(out.columns, out.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
