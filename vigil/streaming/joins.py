"""J1 as a stream: logs joined with anomalous traces on the trace id inside a time bound.

Both sides carry a watermark and the join condition bounds how far a log may lie from its
trace, so Spark drops a buffered log or trace once the other side's watermark has passed
the bound.  Logs of normal traces never leave the join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import LOG_BUFFER_MAX_PER_TRACE
from .batches import Step


def correlate_logs_stream(logs: DataFrame, verdicts: DataFrame, before_s: int = 300, after_s: int = 300,
                          log_delay_s: int = 60, trace_delay_s: int = 60) -> DataFrame:
    """Logs (seq, trace_id, ts, ...) of anomalous traces (trace_id, start_time, is_anomaly).

    A log belongs to a trace with its id that starts at most ``after_s`` before it and at most
    ``before_s`` behind it.  Logs without a trace id and traces without a verdict match nothing.
    """
    left = (logs.filter(F.coalesce("trace_id", F.lit("")) != "")
            .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{log_delay_s} seconds"))
    right = (verdicts.filter("is_anomaly")
             .select(F.col("trace_id").alias("_trace"), F.col("start_time").cast("timestamp").alias("trace_start"))
             .withWatermark("trace_start", f"{trace_delay_s} seconds"))
    near = ((F.col("trace_id") == F.col("_trace"))
            & (F.col("ts") >= F.col("trace_start") - F.expr(f"INTERVAL {before_s} SECONDS"))
            & (F.col("ts") <= F.col("trace_start") + F.expr(f"INTERVAL {after_s} SECONDS")))
    return left.join(right, near).drop("_trace")


def first_logs_step(per_trace: int = LOG_BUFFER_MAX_PER_TRACE, after_s: int = 300, lateness_s: int = 60) -> Step:
    """At most ``per_trace`` logs of a trace, in arrival order (micro-batch, then ts and seq).

    Carries how many logs each trace has had, as long as more may come: until the newest log
    is more than ``after_s`` and the lateness behind the trace's start.
    """
    def step(batch, carried):
        had = carried.get("had")
        w = Window.partitionBy("trace_id", "trace_start").orderBy("ts", "seq")
        ranked = batch.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_trace)
        if had is not None:
            ranked = (ranked.join(had, ["trace_id", "trace_start"], "left")
                      .withColumn("rank", F.col("rank") + F.coalesce("had", F.lit(0)).cast("int")).drop("had"))
        out = ranked.filter(F.col("rank") <= per_trace)
        now = batch.groupBy("trace_id", "trace_start").agg(F.count(F.lit(1)).alias("had"), F.max("ts").alias("seen"))
        if had is not None:
            now = (now.unionByName(had.withColumn("seen", F.col("trace_start")))
                   .groupBy("trace_id", "trace_start").agg(F.sum("had").alias("had"), F.max("seen").alias("seen")))
        newest = now.agg(F.max("seen")).scalar()
        open_ = F.col("trace_start") + F.expr(f"INTERVAL {after_s + lateness_s} SECONDS") >= newest
        return out, {"had": now.filter(open_).drop("seen")}
    return step
