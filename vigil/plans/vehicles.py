"""Reference-shaped tables derived from the driver tables.

The monitored system works on transactions, spans, traces, logs, metrics and a
pod inventory.  These views derive those shapes from the driver's parquet
tables with plain column expressions, so every query's work grows with the
input.  The identical derivations exist as SQL in ``plans/oracle.py``.

* ``v_txn``    ← events
* ``v_span``   ← lineitem (one order = one trace)
* ``v_trace``  ← v_span (trace reconstruction + features)
* ``v_log``    ← documents (redacted)
* ``v_metric`` ← events
* ``v_pod``    ← supplier; ``v_node`` is the fixed three-node pool
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import pick, ts_from_2024_ms, ts_plus_ms
from ..functions.constants import (FAILURE_REASONS, K8S_NODES, METHOD_PROVIDER, SERVICES,
                                   TXN_GATEWAYS, TXN_METHODS, TXN_TYPES)
from ..functions.redaction import redact
from ..sources.tables import table


def v_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    eid = F.col("event_id")
    status = (F.when(F.col("event_type") == "error", "FAILED")
              .when(F.col("event_type") == "signup", "PENDING").otherwise("SUCCESS"))
    return ev.select(
        eid.alias("seq"),
        F.concat(F.lit("TXN"), eid.cast("string")).alias("txn_id"),
        F.concat(F.lit("ORD"), F.floor(eid / 2).cast("string")).alias("order_id"),
        pick(TXN_TYPES, eid).alias("txn_type"),
        pick(TXN_METHODS, eid).alias("method"),
        pick(METHOD_PROVIDER, eid).alias("provider"),
        pick(TXN_GATEWAYS, F.col("user_id")).alias("gateway"),
        F.floor(F.col("value")).cast("double").alias("amount"),
        F.when(eid % 10 < 8, "INR").otherwise("USD").alias("currency"),
        status.alias("status"),
        (F.col("value") * 40.0).alias("latency_ms"),
        F.when(status == "FAILED", pick(FAILURE_REASONS, eid)).alias("failure_reason"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        ts_from_2024_ms(eid * 200).alias("ts"),
        F.when(eid % 4 == 0, "live").otherwise("sim").alias("source"),
    )


def v_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate")
    # (orderkey, linenumber) is not unique: number spans by the full tuple
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    rn = F.row_number().over(w)
    s = li.withColumn("rn", rn)
    return s.select(
        F.col("l_orderkey").alias("trace_seq"),
        F.col("l_orderkey").cast("string").alias("trace_id"),
        F.col("rn"),
        F.concat(F.lit("s"), F.col("rn").cast("string")).alias("span_id"),
        F.when(F.col("l_linenumber") == 1, F.lit(""))
         .otherwise(F.concat(F.lit("s"), F.floor(F.col("l_linenumber") / 2).cast("string")))
         .alias("parent_span_id"),
        pick(SERVICES, F.col("l_suppkey")).alias("service"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("name"),
        (F.col("l_extendedprice") / 40.0).alias("duration_ms"),
        ts_plus_ms(F.col("l_shipdate"), F.col("rn") * 10).alias("start_time"),
        F.when((F.col("l_returnflag") == "R") & (F.col("rn") % 5 == 0), 2).otherwise(0)
         .cast("int").alias("status_code"),
    )


def v_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    sev = (F.when(F.col("lang") == "en", "INFO").when(F.col("lang") == "fr", "WARN")
           .when(F.col("lang") == "de", "ERROR").otherwise("DEBUG"))
    return d.select(
        F.col("doc_id").alias("seq"),
        (F.col("doc_id") % 1000).cast("string").alias("trace_id"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("span_id"),
        F.col("source").alias("service_name"),
        redact(F.col("text")).alias("body"),
        sev.alias("severity"),
        ts_from_2024_ms(F.col("doc_id") * 100).alias("ts"),
    )


def v_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    mt = (F.when(F.col("event_type") == "error", "redaction_count")
          .when(F.col("event_type").isin("click", "view"), "p99_latency")
          .otherwise("throughput"))
    return ev.select(
        F.col("event_id").alias("seq"),
        pick(SERVICES, F.col("user_id")).alias("service"),
        mt.alias("metric_type"),
        F.col("value"),
        F.col("ts"),
    )


def v_node(spark: SparkSession) -> DataFrame:
    """The fixed node pool: a three-row dimension (always broadcast)."""
    return spark.createDataFrame(
        K8S_NODES, "name string, zone string, cpu_capacity_m int, mem_capacity_mi int")


def v_pod(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    k = F.col("s_suppkey")
    status = (F.when(k % 20 == 0, "CrashLoopBackOff").when(k % 20 == 1, "OOMKilled")
              .when(k % 20 == 2, "Pending").otherwise("Running"))
    node_names = [n[0] for n in K8S_NODES]
    return s.select(
        F.concat(pick(SERVICES, F.col("s_nationkey")), F.lit("-pod-"), k.cast("string")).alias("name"),
        pick(SERVICES, F.col("s_nationkey")).alias("deployment"),
        pick(node_names, k).alias("node"),
        status.alias("status"),
        (k % 4).cast("int").alias("restarts"),
        (F.lit(60.0) + F.abs(F.col("s_acctbal")) / 50.0).alias("cpu_m"),
        (F.lit(180.0) + F.abs(F.col("s_acctbal")) / 10.0).alias("mem_mi"),
        ts_from_2024_ms(k * 60000).alias("started_at"),
    )


def v_trace(spark: SparkSession, sf_dir: str, materialized: bool = False) -> DataFrame:
    """One row per trace (A1 + A3 + A4 + A5 + J2), no window; arrival order trace_seq.

    Operators that read it in several passes (rule detectors, models) write it
    once to the shared checkpoint folder first (``plans.materialize``).
    """
    from ..operators.traces import build_traces
    from .materialize import materialize
    t = build_traces(v_span(spark, sf_dir), "trace_id", carry=("trace_seq",))
    return materialize(t, "v_trace") if materialized else t
