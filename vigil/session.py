"""Spark session helpers.

Everything in the library takes an existing ``SparkSession``; this module only
builds one for tests, the bench and the command line, and resolves the shared
checkpoint folder.
"""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "vigil") -> SparkSession:
    master = master or os.environ.get("VIGIL_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VIGIL_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``.

    A folder already registered on the context counts where the setting is unset.
    Without either, a local run gets a scratch folder of its own, registered on the
    context (the setting itself can't be changed at runtime); a cluster run fails,
    since executors could not read what others wrote to a local folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="vigil-ckpt-"))
    return named or context.getCheckpointDir()


def tables_dir(spark: SparkSession) -> str:
    """Folder of the intermediate tables of this application."""
    return f"{checkpoint_dir(spark).rstrip('/')}/vigil-tables/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete folders of the shared storage, whatever file system it is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query inside are removed when it ends, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove_intermediate(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no result is read from them."""
    remove(spark, tables_dir(spark))
