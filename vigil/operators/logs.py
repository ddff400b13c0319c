"""Log operators: redaction flag, redaction counter, PII density, correlation.

P1, P2, W3, W4, W5 (PII cooldown), M14, J1, J10.  Logs are keyed by service;
arrival order is (ts, seq).  Sliding 60 s frames are differences of exact
positions in a range-partitioned order, and the redaction counter is a prefix sum over
(service, block) totals, so no service is ever a single task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import known, rnd
from ..functions.constants import (LOG_BUFFER_MAX_PER_TRACE, PII_COOLDOWN_S, PII_MIN_LOGS,
                                   PII_THRESHOLD, PII_WINDOW_S)
from ..functions.redaction import is_redacted, redact
from ..plans.ordered import greedy_cooldown, running_count, sliding_count, top_n_per_key

US = 1_000_000
COARSE_SEQ = 5_000_000


def redact_logs(logs: DataFrame, body: str = "body") -> DataFrame:
    """P1 + P2: redact the body and flag rows that carry a redaction token."""
    return logs.withColumn(body, redact(F.col(body))).withColumn("is_redacted", is_redacted(F.col(body)))


def redaction_counter(logs: DataFrame, key: str = "service_name") -> DataFrame:
    """Running redaction count per service, one metric row per redacted log."""
    d = logs.withColumn("is_redacted", is_redacted(F.col("body"))) if "is_redacted" not in logs.columns else logs
    c = running_count(known(d, key), key, "seq", F.col("is_redacted"), F.floor(F.col("seq") / COARSE_SEQ), "running")
    return c.filter(F.col("is_redacted")).select(
        F.col(key).alias("service"), F.lit("redaction_count").alias("metric_type"),
        F.col("running").cast("double").alias("value"), F.col("ts").alias("timestamp"), "seq")


def pii_density(logs: DataFrame, key: str = "service_name", threshold: float = PII_THRESHOLD,
                window_s: int = PII_WINDOW_S, min_logs: int = PII_MIN_LOGS) -> DataFrame:
    """Per log, the redaction ratio of the service's logs with age ≤ 60 s
    (including this one); candidate when ≥ 5 logs and ratio > threshold.

    Both counts are differences of exact positions in a range-partitioned
    order of (service, ts, seq), so one busy service is spread over many tasks.
    """
    d = logs.withColumn("is_redacted", is_redacted(F.col("body"))) if "is_redacted" not in logs.columns else logs
    d = sliding_count(known(d, key), [key], "ts", "seq", window_s * US, "window_log_count", flag="is_redacted",
                      flag_out="redacted_count")
    ratio = F.col("redacted_count") / F.col("window_log_count")
    return (d.withColumn("redaction_ratio", ratio)
            .filter((F.col("window_log_count") >= min_logs) & (ratio > threshold)))


def pii_alerts(logs: DataFrame, key: str = "service_name", threshold: float = PII_THRESHOLD,
               cooldown_s: float = PII_COOLDOWN_S) -> DataFrame:
    """W4 + W5 + M14: PII density alerts after the 60 s per-service cooldown."""
    c = pii_density(logs, key, threshold)
    fired = greedy_cooldown(c, key, "ts", "seq", cooldown_s).filter(F.col("fired"))
    tid = F.when(F.coalesce(F.col("trace_id"), F.lit("")) != "", F.col("trace_id")).otherwise(
        F.concat(F.lit("pii-"), F.col(key), F.lit("-"),
                 F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / US).cast("string")))
    return fired.select(
        F.col(key).alias("service"), F.lit("security.pii_density").alias("route"),
        rnd(F.col("redaction_ratio"), 6).alias("anomaly_score"), F.lit(True).alias("is_anomaly"),
        F.lit(0.0).alias("duration_ms"), tid.alias("trace_id"), F.col("ts").alias("timestamp"),
        F.lit("pii_redaction_density").alias("reason"),
        F.lit("PII Redaction Density").alias("anomaly_type"),
        rnd(F.col("redaction_ratio"), 6).alias("redaction_ratio"),
        "window_log_count", "redacted_count", "seq")


def correlate_logs(logs: DataFrame, anomalous: DataFrame, per_trace: int = LOG_BUFFER_MAX_PER_TRACE) -> DataFrame:
    """Logs of anomalous traces only, the first 50 per trace in arrival order."""
    keys = anomalous.select("trace_id").distinct()
    j = logs.filter(F.coalesce(F.col("trace_id"), F.lit("")) != "").join(keys, "trace_id", "left_semi")
    return top_n_per_key(j, ["trace_id"], [F.col("ts"), F.col("seq")], per_trace, split_col="seq")


def incident_logs(logs: DataFrame, incidents: DataFrame, n: int = 25, cut: int = 240) -> DataFrame:
    """Newest 25 logs of each incident's trace, body cut at 240 characters."""
    keys = incidents.select("trace_id").distinct()
    j = logs.join(keys, "trace_id", "left_semi")
    t = top_n_per_key(j, ["trace_id"], [F.desc("ts"), F.desc("seq")], n, split_col="seq")
    return t.select("trace_id", "rank", "seq", "severity", "service_name",
                    F.substring("body", 1, cut).alias("body"))
