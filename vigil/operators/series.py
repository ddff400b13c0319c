"""Metric time-series operators.

Series are keyed by (service, metric_type).  "Last N" and "latest" picks use
aggregates (``max_by``) or the split top-N kernel instead of a window over a
whole series, so a hot series is never one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import rnd
from ..plans.ordered import top_n_per_key

KEY = ["service", "metric_type"]


def mode_metric_type(mode: str) -> str:
    """Dashboard mode → metric type."""
    return "redaction_count" if mode == "redaction" else "p99_latency"


def series_for_mode(metrics: DataFrame, mode: str) -> DataFrame:
    return metrics.filter(F.col("metric_type") == mode_metric_type(mode))


def latest(metrics: DataFrame) -> DataFrame:
    """Latest value per series (by ts, then seq)."""
    return metrics.groupBy(*KEY).agg(
        F.max_by("value", F.struct("ts", "seq")).alias("value"),
        F.max("ts").alias("ts"))


def trend(metrics: DataFrame) -> DataFrame:
    """Last value minus the previous one per series (null when one point)."""
    last = metrics.groupBy(*KEY).agg(F.max(F.struct("ts", "seq")).alias("_last"),
                                     F.max_by("value", F.struct("ts", "seq")).alias("last_value"))
    prev = (metrics.join(last, KEY)
            .filter(F.struct("ts", "seq") < F.col("_last"))
            .groupBy(*KEY).agg(F.max_by("value", F.struct("ts", "seq")).alias("prev_value")))
    j = last.join(prev, KEY, "left")
    return j.select(*KEY, "last_value", "prev_value",
                    rnd(F.col("last_value") - F.col("prev_value"), 6).alias("trend"))


def last_n(metrics: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` points of each series, returned oldest first (pos 1..n)."""
    t = top_n_per_key(metrics, KEY, [F.desc("ts"), F.desc("seq")], n, split_col="seq")
    cnt = t.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_c"))
    return t.join(cnt, KEY).select(*KEY, "ts", "seq", "value",
                                   (F.col("_c") - F.col("rank") + 1).alias("pos"))


def align_two(metrics: DataFrame, a: str, b: str, metric_type: str = "p99_latency",
              last: int = 30) -> DataFrame:
    """Two services' series aligned on the clock label (HH:mm:ss), last 30 labels."""
    m = metrics.filter((F.col("metric_type") == metric_type) & F.col("service").isin(a, b))
    lab = F.date_format("ts", "HH:mm:ss")
    g = m.groupBy(lab.alias("time")).pivot("service", [a, b]).agg(
        F.max_by("value", F.struct("ts", "seq")))
    return g.orderBy(F.desc("time")).limit(last)


def concat_series(metrics: DataFrame, services: list[str], metric_type: str) -> DataFrame:
    """Series of several services concatenated and sorted by time."""
    parts = [metrics.filter((F.col("service") == s) & (F.col("metric_type") == metric_type))
             for s in services]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("ts", "seq")


def redaction_total(metrics: DataFrame, services: list[str]) -> DataFrame:
    """Latest redaction counter of each given service, summed."""
    m = metrics.filter((F.col("metric_type") == "redaction_count") & F.col("service").isin(*services))
    return latest(m).agg(rnd(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("redactions"))


def throughput_total(metrics: DataFrame) -> DataFrame:
    """Summed throughput over the loaded series."""
    return metrics.filter(F.col("metric_type") == "throughput").agg(
        rnd(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("throughput"))


def latency_state(metrics: DataFrame, critical_ms: float = 500.0) -> DataFrame:
    """Last p99 per service > 500 → Critical, else Healthy."""
    lp = latest(metrics.filter(F.col("metric_type") == "p99_latency"))
    return lp.select("service", F.col("value").alias("last_p99"),
                     F.when(F.col("value") > critical_ms, "Critical").otherwise("Healthy").alias("state"))


def pct_band(pct, danger: float = 80.0):
    """P15 bar bands: ≥ danger red, ≥ 0.75·danger amber, else green."""
    return (F.when(pct >= danger, "red").when(pct >= danger * 0.75, "amber").otherwise("green"))
