"""Print the formatted physical plan of registered queries with a short summary
(scans, shuffles, broadcasts, sorts, Python stages) for plan review.

usage: python tools/plans.py [sf_dir] name [name …]
"""
from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vigil.session import build_session  # noqa: E402


def summary(plan: str) -> dict:
    return {
        "parquet_scans": plan.count("Scan parquet"),
        "shuffles": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")
        + plan.count("Exchange SinglePartition"),
        "single_partition": plan.count("SinglePartition"),
        "broadcasts": plan.count("BroadcastExchange"),
        "sorts": plan.count("Sort ["),
        "python_stages": plan.count("MapInPandas") + plan.count("FlatMapGroupsInPandas")
        + plan.count("FlatMapCoGroupsInPandas"),
    }


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from vigil.catalog import QUERIES
    spark = build_session()
    for name in names:
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"=== {name}: {summary(plan)}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
