"""Watermarked Structured Streaming aggregates and the sinks.

Event-time windows carry a watermark and go, in ``update`` mode, into a keyed-replace
table (S8, ``streaming.keyed``).  Detectors are in ``streaming.batches``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import passing_shuffles, remove
from .keyed import keyed_table, write_keyed

# ---- windows, totals, sinks (R1, R2, R7, R8, S7, S8, S11) ----------------------------

def trace_windows_stream(span_stream: DataFrame, window_s: int = 10, watermark: str = "1 minute") -> DataFrame:
    """R1 + R2: event-time tumbling windows per trace (late rows are dropped by the
    watermark and counted in the query progress)."""
    s = span_stream.withColumn("start_time", F.col("start_time").cast("timestamp")).withWatermark(
        "start_time", watermark)
    return s.groupBy(F.window("start_time", f"{window_s} seconds").alias("window"), "trace_id").agg(
        F.count(F.lit(1)).alias("span_count"), F.max("duration_ms").alias("duration_ms"),
        F.max((F.col("duration_ms") > 500).cast("int")).alias("_slow"), F.min("start_time").alias("start_time"))


def watermark_report(query) -> list[dict]:
    """R2: per micro-batch, the watermark in force and the batch's event-time
    range; a batch whose maximum event time is below its watermark arrived
    entirely late.  Spark may drop such rows (append-mode windows do; update
    mode can still apply them) and reports ``numRowsDroppedByWatermark`` where
    its stateful operator counts them."""
    out = []
    for prog in query.recentProgress:
        et = prog.eventTime or {}
        dropped = sum(int(op.numRowsDroppedByWatermark or 0) for op in prog.stateOperators)
        out.append({"batch": prog.batchId, "rows": prog.numInputRows, "watermark": et.get("watermark"),
                    "min": et.get("min"), "max": et.get("max"), "reported_dropped": dropped,
                    "late": bool(et.get("max") and et.get("watermark") and et["max"] < et["watermark"])})
    return out


def payment_throughput_stream(txn_stream: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """Payments per sliding 60 s window, sliding every 10 s."""
    t = txn_stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return t.groupBy(F.window("ts", "60 seconds", "10 seconds").alias("window")).agg(
        F.count(F.lit(1)).alias("payments"))


def txn_totals_stream(txn_stream: DataFrame) -> DataFrame:
    """Running counters (update mode)."""
    s = F.col("status")
    return txn_stream.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(s == "SUCCESS", 1).otherwise(0)).cast("long").alias("success"),
        F.sum(F.when(s == "FAILED", 1).otherwise(0)).cast("long").alias("failed"),
        F.sum(F.when(s == "PENDING", 1).otherwise(0)).cast("long").alias("pending"),
        F.sum(F.when((s == "SUCCESS") & (F.col("currency") == "INR"), F.col("amount")).otherwise(0.0))
        .alias("volume"))


def write_append(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append sink (parquet) with an exactly-once checkpoint."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def to_console(df: DataFrame, output_mode: str = "append"):
    """Console sink of closed windows."""
    return df.writeStream.format("console").outputMode(output_mode).option("truncate", False).start()


#: Folders of a finished replay that no result is read from.
WORKING = ("all", "in", "landed", "state", "_checkpoint")


def deliveries(df: DataFrame, order_col: str, folder: str, chunks: int) -> list[DataFrame]:
    """``df`` as ``chunks`` tables of equal spans of ``order_col`` (times or whole numbers), written once."""
    spark = df.sparkSession
    is_ts = isinstance(df.schema[order_col].dataType, (T.TimestampType, T.TimestampNTZType))
    key = F.unix_micros(F.col(order_col).cast("timestamp")) if is_ts else F.col(order_col)
    # the view is computed once; a delivery reads its own folder
    with passing_shuffles(spark):
        df.withColumn("_key", key).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    lo, hi = raw.agg(F.min("_key"), F.max("_key")).first()
    if lo is None:
        return [raw.select(*df.columns)]
    width = (float(hi) - float(lo) + 1.0) / chunks
    chunk = F.least(F.lit(chunks - 1), F.floor((F.col("_key") - F.lit(float(lo))) / F.lit(width))).cast("int")
    chunk = F.coalesce(chunk, F.lit(0))
    return [raw.filter(chunk == i).select(*df.columns) for i in range(chunks)]


def replay(df: DataFrame, order_col: str, folder: str, start: Callable, chunks: int = 4,
           result: Callable[[], DataFrame] | None = None, working: tuple[str, ...] = WORKING) -> DataFrame:
    """Feed ``df`` to a stream as ``chunks`` deliveries in ``order_col`` order; returns what it wrote.

    Each delivery is appended to the landing folder ``folder``/in by all tasks and the query is
    started anew from its checkpoint, so one micro-batch holds one delivery and every
    delivery after the first is a restart (S2).  ``start`` takes the stream and returns the
    started query, which writes to ``folder``/out (or where ``result`` reads).  An empty table is
    one empty delivery.  At the end everything but the result is removed.
    """
    spark = df.sparkSession
    for landed in deliveries(df, order_col, f"{folder}/all", chunks):
        landed.write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(df.schema).parquet(f"{folder}/in")).awaitTermination()
    remove(spark, *[f"{folder}/{w}" for w in working])
    return result() if result else spark.read.parquet(f"{folder}/out")


def replay_all(inputs: dict[str, tuple[DataFrame, str]], folder: str, start: Callable, chunks: int = 4,
               result: Callable[[], DataFrame] | None = None) -> DataFrame:
    """``replay`` of several tables on one clock: {name: (table, time column)}; ``start`` takes the streams by name."""
    spark = next(iter(inputs.values()))[0].sparkSession
    clocks = None
    for name, (df, ts) in inputs.items():
        times = df.select(F.lit(name).alias("name"), F.col(ts).cast("timestamp").alias("ts"))
        clocks = times if clocks is None else clocks.unionByName(times)
    lo, hi = clocks.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    bounds = [lo + (hi - lo + 1) * i // chunks for i in range(1, chunks)] if lo is not None else []
    for name, (df, ts) in inputs.items():
        df.write.mode("overwrite").parquet(f"{folder}/all/{name}")
    for i in range(len(bounds) + 1):
        for name, (df, ts) in inputs.items():
            rows, at = spark.read.schema(df.schema).parquet(f"{folder}/all/{name}"), F.unix_micros(F.col(ts).cast("timestamp"))
            if i:
                rows = rows.filter(at >= bounds[i - 1])
            if i < len(bounds):
                rows = rows.filter(at < bounds[i])
            rows.write.mode("append").parquet(f"{folder}/in/{name}")
        streams = {n: spark.readStream.schema(df.schema).parquet(f"{folder}/in/{n}") for n, (df, _) in inputs.items()}
        start(streams).awaitTermination()
    remove(spark, *[f"{folder}/{w}" for w in WORKING])
    return result() if result else spark.read.parquet(f"{folder}/out")


def to_table(build: Callable[[DataFrame], DataFrame], folder: str) -> Callable:
    """``start`` for :func:`replay`: the stream that ``build`` makes, appended under ``folder``."""
    return lambda stream: write_append(build(stream), f"{folder}/out", f"{folder}/_checkpoint")


def replay_keyed(df: DataFrame, order_col: str, folder: str, build: Callable[[DataFrame], DataFrame],
                 key: list[str], derive=None, chunks: int = 4) -> DataFrame:
    """``replay`` into a keyed table; returns its rows, one per key."""
    made = {}

    def start(stream):
        built = build(stream)
        made["table"] = keyed_table(built, key, f"{folder}/out", derive=derive)
        return write_keyed(built, key, f"{folder}/out", f"{folder}/_checkpoint", derive=derive)

    return replay(df, order_col, folder, start, chunks, result=lambda: made["table"].read().drop("_version"))
