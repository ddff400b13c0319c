"""Payment KPIs over a transactions DataFrame.

All of these are one hash aggregation each (partial aggregation on the map
side, one shuffle on a low-cardinality key); scalar references such as "the
largest count" or "now" are scalar subqueries (``DataFrame.scalar()``), never
cross joins.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import rnd

from ..functions.common import epoch_s, safe_div
from ..functions.constants import GATEWAY_REGISTRY
from ..plans.ordered import exact_pick




def _cnt(cond):
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def _inr_volume():
    return F.sum(F.when((F.col("status") == "SUCCESS") & (F.col("currency") == "INR"), F.col("amount"))
                 .otherwise(0.0))


def txn_totals(txn: DataFrame) -> DataFrame:
    """A11 / S9 txn counters: totals, INR volume of SUCCESS, success rate %."""
    a = txn.agg(F.count(F.lit(1)).alias("total"), _cnt(F.col("status") == "SUCCESS").alias("success"),
                _cnt(F.col("status") == "FAILED").alias("failed"), _cnt(F.col("status") == "PENDING").alias("pending"),
                _inr_volume().alias("volume"))
    return a.select(
        F.col("total"), F.coalesce("success", F.lit(0)).alias("success"),
        F.coalesce("failed", F.lit(0)).alias("failed"),
        F.coalesce("pending", F.lit(0)).alias("pending"),
        rnd(F.coalesce("volume", F.lit(0.0)), 2).alias("volume_inr"),
        rnd(safe_div(F.col("success") * 100.0, F.col("total")), 2).alias("success_rate"))


def method_breakdown(txn: DataFrame) -> DataFrame:
    """Per method count/success/volume, ok % with bands, bar share of the max."""
    g = txn.groupBy("method").agg(F.count(F.lit(1)).alias("count"),
                                  _cnt(F.col("status") == "SUCCESS").alias("success"),
                                  rnd(_inr_volume(), 2).alias("volume"))
    # the largest count is a scalar over the (method-sized) aggregate
    mx = g.select(F.greatest(F.max("count"), F.lit(1)).alias("m")).scalar()
    ok = safe_div(F.col("success") * 100.0, F.col("count"))
    return g.select(
        "method", "count", "success", "volume",
        rnd(ok, 1).alias("ok_pct"),
        F.when(ok >= 90, "good").when(ok >= 75, "fair").otherwise("poor").alias("ok_band"),
        rnd(F.col("count") * 100.0 / mx, 1).alias("bar_pct"))


def type_breakdown(txn: DataFrame) -> DataFrame:
    """A13."""
    return txn.groupBy("txn_type").agg(F.count(F.lit(1)).alias("count"))


def top_failure_reasons(txn: DataFrame, k: int = 6) -> DataFrame:
    """FAILED with a reason, top k by count (name breaks ties)."""
    return (txn.filter((F.col("status") == "FAILED") & F.col("failure_reason").isNotNull())
            .groupBy("failure_reason").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "failure_reason").limit(k))


def gateway_breakdown(txn: DataFrame) -> DataFrame:
    """A15."""
    return txn.groupBy("gateway").agg(
        F.count(F.lit(1)).alias("count"), _cnt(F.col("status") == "FAILED").alias("failed"),
        _cnt(F.col("status") == "SUCCESS").alias("success"), _cnt(F.col("status") == "PENDING").alias("pending"),
        rnd(_inr_volume(), 2).alias("volume"))


def gateway_activity(txn: DataFrame) -> DataFrame:
    """+ last event and live count."""
    return txn.groupBy("gateway").agg(
        F.count(F.lit(1)).alias("count"), _cnt(F.col("status") == "SUCCESS").alias("success"),
        _cnt(F.col("status") == "FAILED").alias("failed"), rnd(_inr_volume(), 2).alias("volume"),
        F.max("ts").alias("last_event"), _cnt(F.col("source") == "live").alias("live_count"))


def avg_success_latency(txn: DataFrame) -> DataFrame:
    """Average latency of SUCCESS rows, 1 decimal, 0 when none."""
    a = txn.filter(F.col("status") == "SUCCESS").agg(F.avg("latency_ms").alias("a"))
    return a.select(rnd(F.coalesce(F.col("a"), F.lit(0.0)), 1).alias("avg_latency_ms"))


def gateway_kpis(txn: DataFrame, fail_flag_pct: float = 15.0) -> DataFrame:
    """Gateway-scoped KPI row and failure % (flagged above 15)."""
    g = gateway_breakdown(txn)
    fail = safe_div(F.col("failed") * 100.0, F.col("count"))
    return g.select(
        "gateway", F.col("count").alias("total"), "success", "failed", "volume",
        rnd(safe_div(F.col("success") * 100.0, F.col("count")), 2).alias("success_rate"),
        rnd(fail, 1).alias("fail_pct"), (fail > fail_flag_pct).alias("fail_flag"))


def registry(spark: SparkSession) -> DataFrame:
    """The fixed gateway registry (9 rows, broadcast in joins)."""
    return spark.createDataFrame(
        GATEWAY_REGISTRY,
        "name string, region string, method string, path string, scheme string, secret_key string")


def integrations(spark: SparkSession, txn: DataFrame, now=None,
                 configured: tuple[str, ...] = (), live_window_s: float = 300.0) -> DataFrame:
    """Registry LEFT JOIN gateway activity; live = live rows and last event < 300 s old.

    ``now`` defaults to the newest transaction time (a scalar subquery).
    """
    act = gateway_activity(txn)
    now_c = F.lit(now) if now is not None else txn.agg(F.max("ts")).scalar()
    j = F.broadcast(registry(spark)).join(act, F.col("name") == F.col("gateway"), "left")
    secs = epoch_s(now_c) - epoch_s(F.col("last_event"))
    cnt = F.coalesce(F.col("count"), F.lit(0)).cast("long")
    suc = F.coalesce(F.col("success"), F.lit(0)).cast("long")
    return j.select(
        "name", "region", "method", "path", "scheme",
        F.col("secret_key").isin(list(configured)).alias("configured"),
        ((F.coalesce(F.col("live_count"), F.lit(0)) > 0) & secs.isNotNull()
         & (secs < live_window_s)).alias("live"),
        cnt.alias("txn_count"), suc.alias("success"),
        rnd(safe_div(suc * 100.0, cnt), 1).alias("success_rate"),
        rnd(F.coalesce(F.col("volume"), F.lit(0.0)), 2).alias("volume_inr"),
        F.col("last_event"),
        rnd(secs).cast("long").alias("secs_since_event"),
    )


def integrations_rollup(integ: DataFrame) -> DataFrame:
    """Live / configured gateway counts and total transactions."""
    return integ.agg(_cnt(F.col("live")).alias("live_count"),
                     _cnt(F.col("configured")).alias("configured_count"),
                     F.sum("txn_count").cast("long").alias("total_txns"))


def load_summary(txn: DataFrame, col: str = "latency_ms") -> DataFrame:
    """Avg, p50 = l[n//2], p95/p99 = l[int(n*p)] (clipped to n-1), min, max.

    Exact rank picks without a global sort (``exact_pick``).
    """
    vals = txn.select(F.col(col).alias("v")).filter(F.col("v").isNotNull())
    n = vals.agg(F.count(F.lit(1))).scalar()
    picks = exact_pick(vals, "v", {
        "p50": F.floor(n / 2),
        "p95": F.least(F.floor(n * F.lit(0.95)), n - 1),
        "p99": F.least(F.floor(n * F.lit(0.99)), n - 1)})
    base = vals.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("v"), 6).alias("avg"),
                    F.min("v").alias("min"), F.max("v").alias("max"))
    return base.select("n", "avg", picks["p50"].alias("p50"), picks["p95"].alias("p95"),
                       picks["p99"].alias("p99"), "min", "max")


def type_share(txn: DataFrame, duration_s: float | None = None) -> DataFrame:
    """Count and share % per type; effective rate = n / max(duration, 0.1)."""
    total = txn.agg(F.count(F.lit(1))).scalar()
    if duration_s is None:
        span = txn.agg((epoch_s(F.max("ts")) - epoch_s(F.min("ts")))).scalar()
    else:
        span = F.lit(float(duration_s))
    g = txn.groupBy("txn_type").agg(F.count(F.lit(1)).alias("count"))
    return g.select("txn_type", "count",
                    rnd(F.col("count") * 100.0 / total, 2).alias("share_pct"),
                    rnd(F.col("count") / F.greatest(span, F.lit(0.1)), 6).alias("rate_per_s"))


def real_only(txn: DataFrame) -> DataFrame:
    """Once the first live row is seen, later simulated rows are suppressed."""
    first_live = txn.filter(F.col("source") == "live").agg(F.min("ts")).scalar()
    return txn.filter((F.col("source") == "live") | first_live.isNull() | (F.col("ts") < first_live))


def live_status(txn: DataFrame) -> DataFrame:
    """First / last live event, live count, last live gateway."""
    live = txn.filter(F.col("source") == "live")
    return live.agg(F.min("ts").alias("since"), F.max("ts").alias("last_live"),
                    F.count(F.lit(1)).alias("real_payment_count"),
                    F.max_by("gateway", F.struct("ts", "seq")).alias("last_gateway"))


def txn_lookup(txn: DataFrame, key: str) -> DataFrame:
    """Newest transaction whose txn_id or order_id equals ``key`` (case-insensitive)."""
    k = key.lower()
    return (txn.filter((F.lower("txn_id") == k) | (F.lower("order_id") == k))
            .orderBy(F.desc("seq")).limit(1))


def filter_eq(df: DataFrame, wildcards=("All", "All Services"), **eq) -> DataFrame:
    """Optional equality filters; ``None`` or a wildcard means no filter."""
    for c, v in eq.items():
        if v is None or v in wildcards:
            continue
        df = df.filter(F.col(c) == F.lit(v))
    return df


def newest_page(df: DataFrame, limit: int = 50, cap: int = 200, order: str = "seq") -> DataFrame:
    """Newest-first page (TakeOrderedAndProject)."""
    return df.orderBy(F.desc(order)).limit(min(limit, cap))


def token_search(df: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Every whitespace token of the query is a substring of the
    space-stripped, lower-cased concatenation of the searchable fields."""
    toks = [t for t in query.lower().split() if t]
    hay = F.regexp_replace(F.lower(F.concat_ws("", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                                       for c in fields])), r"\s+", "")
    cond = F.lit(True)
    for t in toks:
        cond = cond & hay.contains(t)
    return df.filter(cond)


def kpi_deltas(txn: DataFrame, key: str = "gateway", last: int = 60) -> DataFrame:
    """Per key, the change of the running success / failed / volume counters
    from the previous point, floored at 0 (the key's first point is 0); the
    last ``last`` points.

    A running counter's step is the row's own contribution, so only the newest
    ``last + 1`` rows of each key are needed (split top-N kernel, no window over
    a whole key).
    """
    from ..plans.ordered import top_n_per_key
    inr = (F.col("status") == "SUCCESS") & (F.col("currency") == "INR")
    d = txn.select(key, "ts", "seq",
                   F.when(F.col("status") == "SUCCESS", 1).otherwise(0).alias("_s"),
                   F.when(F.col("status") == "FAILED", 1).otherwise(0).alias("_f"),
                   F.when(inr, F.col("amount")).otherwise(0.0).alias("_v"))
    t = top_n_per_key(d, [key], [F.desc("ts"), F.desc("seq")], last + 1, split_col="seq")
    w = Window.partitionBy(key).orderBy("ts", "seq")          # ≤ last + 1 rows per key
    has_prev = F.lag("seq", 1).over(w).isNotNull()
    out = t.select(key, "ts", "seq", "rank",
                   F.when(has_prev, F.greatest(F.lit(0), F.col("_s"))).otherwise(0).alias("s"),
                   F.when(has_prev, F.greatest(F.lit(0), F.col("_f"))).otherwise(0).alias("f"),
                   F.when(has_prev, F.greatest(F.lit(0.0), F.col("_v"))).otherwise(0.0).alias("v"))
    return out.filter(F.col("rank") <= last).select(
        key, "ts", "seq", F.col("s").cast("long").alias("success_delta"),
        F.col("f").cast("long").alias("failed_delta"), rnd(F.col("v"), 2).alias("volume_delta"))


def unread_count(df: DataFrame, since, cap: int = 99) -> DataFrame:
    """Rows newer than the last-read time, capped at 99."""
    return df.agg(F.least(F.sum(F.when(F.col("ts") > F.lit(since), 1).otherwise(0)),
                          F.lit(cap)).cast("long").alias("unread"))
