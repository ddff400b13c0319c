"""Cut lineage by writing an intermediate table to the shared checkpoint folder.

Two-pass operators (prefix sums over blocks, exact ranks) read their input
twice.  When that input is itself expensive (trace reconstruction), it is
written once as parquet under ``spark.checkpoint.dir`` — the shared folder the
cluster names — and read back, which also restores column pruning and
predicate pushdown for the later passes.  The folder is only created here when
the session has none (local runs and tests).  ``session.remove_intermediate``
deletes what an application has written, when its results have been saved.
"""
from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import remove, tables_dir

_held = threading.local()


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_held, "paths", None) is not None:
        _held.paths.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread materializes inside are removed at the end: for a step that has written its results by then."""
    outer, _held.paths = getattr(_held, "paths", None), []
    try:
        yield
    finally:
        paths, _held.paths = _held.paths, outer
        remove(spark, *paths)


def few_files(df: DataFrame, name: str, per_core: int = 4) -> DataFrame:
    """`materialize` by at most `per_core` tasks for each core, in as many files.

    For a small table, or the end of a step whose tasks cost more than their rows: each
    one that writes costs a file and often a Python worker's start, however little it holds.
    """
    return materialize(df.coalesce(per_core * df.sparkSession.sparkContext.defaultParallelism), name)
