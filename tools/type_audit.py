"""Compare the column type families of every registered query with its oracle.

usage: python tools/type_audit.py [sf_dir]
"""
from __future__ import annotations

import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vigil.session import build_session  # noqa: E402
from vigil.sources.tables import TABLES  # noqa: E402


def spark_family(t: str) -> str:
    t = t.lower()
    if t in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if t in ("float", "double"):
        return "float"
    if t.startswith("decimal"):
        return "decimal"
    if t.startswith("timestamp"):
        return "timestamp"
    if t == "boolean":
        return "bool"
    if t == "string":
        return "string"
    return t.split("<")[0]


def duck_family(t: str) -> str:
    t = t.upper()
    if t in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER",
             "UBIGINT"):
        return "int" if t != "HUGEINT" else "hugeint"
    if t in ("FLOAT", "DOUBLE"):
        return "float"
    if t.startswith("DECIMAL"):
        return "decimal"
    if t.startswith("TIMESTAMP"):
        return "timestamp"
    if t == "BOOLEAN":
        return "bool"
    if t == "VARCHAR":
        return "string"
    return t.lower()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    from vigil.catalog import ORACLES, QUERIES
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, sql in ORACLES.items():
        sdf = QUERIES[name](spark, sf)
        s_types = {f.name: spark_family(f.dataType.simpleString()) for f in sdf.schema.fields}
        rel = con.sql(sql)
        d_types = {c: duck_family(str(t)) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
                if s_types.get(c) != d_types.get(c)}
        if diff:
            bad += 1
            print(f"TYPE {name}: {diff}")
    print(f"type mismatches in {bad} queries")


if __name__ == "__main__":
    main()
