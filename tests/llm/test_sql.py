"""The operators' queries against their SQL in DuckDB, at the smallest scale."""

import glob
import os

import pytest
from conftest import SF
from test_queries import rows

duckdb = pytest.importorskip("duckdb")
from lodestar.llm import queries as plans  # noqa: E402


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    out = plans.QUERIES[name](spark, SF)
    want = con.execute(plans.SQL[name])
    assert rows(out.columns, out.collect()) == rows([d[0] for d in want.description], want.fetchall())
