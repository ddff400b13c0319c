"""Every corpus query with SQL against DuckDB on the smallest tables; the guard of the entry module."""
from __future__ import annotations

import importlib
import os
import sys

import duckdb
import pytest

from vigil.llm.queries import ORACLES, QUERIES
from vigil.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def canon(df):
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    from check_oracle import rows
    return rows(df)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert canon(QUERIES[name](spark, SF).toPandas()) == canon(con.execute(ORACLES[name]).df())


def test_registered():
    sys.path.insert(0, ROOT)
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names
