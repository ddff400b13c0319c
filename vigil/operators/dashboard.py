"""Alert and payment views behind the dashboard (P10, P12–P14, P16, P18, P19,
P21, P23, J5, U1, U3, W17, S10).

Alerts carry flat flag columns (see ``payments_detect.ALERT_COLS``); every
operator here is a projection, filter, equi-join or aggregation.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import rnd
from ..functions.constants import SEVERITY_CRITICAL, SEVERITY_WARNING
from ..plans.ordered import top_n_per_key

# FIXED VALUES: payment incident types shown on the integrations page.
PAYMENT_ANOMALY_TYPES = ["Payment Failure Spike", "Fraud Velocity", "Duplicate Charge", "Gateway Timeout"]


def with_alert_id(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("alert_id", F.concat_ws(":", "reason", F.col("seq").cast("string")))


def severity(score: Column) -> Column:
    """≥ 0.8 Critical, ≥ 0.5 Warning, else Low Risk."""
    return (F.when(score >= SEVERITY_CRITICAL, "Critical").when(score >= SEVERITY_WARNING, "Warning")
            .otherwise("Low Risk"))


def model_band(pct: Column) -> Column:
    """P14 model bar: > 70 high, > 40 mid, else low."""
    return F.when(pct > 70, "high").when(pct > 40, "mid").otherwise("low")


def js_round(x: Column) -> Column:
    """Math.round: half rounds toward +∞."""
    return F.floor(x + F.lit(0.5))


def rule_pills(alerts: DataFrame) -> DataFrame:
    """One row per active rule flag with its label and detail text."""
    r = F.col("reason")
    pills = F.array(
        F.when(r == "payment_failure_spike", F.struct(
            F.lit("Failure Spike").alias("label"),
            F.when(F.col("failure_rate") > 0, F.concat(js_round(F.col("failure_rate") * 100).cast("long")
                                                          .cast("string"), F.lit("%"))).alias("detail"))),
        F.when(r == "gateway_timeout", F.struct(F.lit("Gateway Timeout").alias("label"),
                                                F.col("gateway").alias("detail"))),
        F.when(r == "fraud_velocity", F.struct(
            F.lit("Fraud Velocity").alias("label"),
            F.when(F.col("txn_per_min") > 0, F.concat(F.col("txn_per_min").cast("string"), F.lit("/min")))
            .alias("detail"))),
        F.when(r == "duplicate_charge", F.struct(
            F.lit("Duplicate Charge").alias("label"),
            F.when(F.col("dup_txn_id").isNotNull(), F.concat(F.lit("#"), F.substring("dup_txn_id", 1, 10)))
            .alias("detail"))))
    return alerts.select("alert_id", F.explode(F.array_compact(pills)).alias("p")).select(
        "alert_id", F.col("p.label").alias("label"), F.col("p.detail").alias("detail"))


def alerts_for_payment(alerts: DataFrame, key: str, n: int = 20) -> DataFrame:
    """P10: alerts whose flags reference the payment id (or whose trace id equals it), newest 20."""
    names = [c for c in ("txn_id", "dup_txn_id", "order_id", "trace_id") if c in alerts.columns]
    m = alerts.filter(F.array_contains(F.array_compact(F.array(*names)), F.lit(key)))
    return m.orderBy(F.desc("ts"), F.desc("alert_id")).limit(n)


def payment_lookup(txn: DataFrame, alerts: DataFrame, ids: list[str], n: int = 20) -> DataFrame:
    """J5 by id: for each payment or order id asked for (in any case), the newest payment that
    it names, ``found`` = there is one, and the alerts that mention the id or that payment
    (the newest ``n`` of either, without repeats).  An id that names nothing gives found =
    false and no alerts."""
    asked = txn.sparkSession.createDataFrame([(i,) for i in ids], "lookup string").withColumn("_k", F.lower("lookup"))
    wanted = [i.lower() for i in ids]
    own = F.array_distinct(F.array(F.lower("txn_id"), F.lower("order_id")))
    named = (txn.filter(F.lower("txn_id").isin(wanted) | F.lower("order_id").isin(wanted))
             .select("seq", "txn_id", "order_id", F.explode(own).alias("_k"))
             .groupBy("_k").agg(F.max_by(F.struct("txn_id", "order_id"), "seq").alias("_p")))
    hit = asked.join(named, "_k", "left")
    names = hit.select("lookup", F.explode(F.array_distinct(F.array_compact(
        F.array("_k", F.lower(F.col("_p.txn_id")))))).alias("_k"))
    said = [F.lower(c) for c in ("txn_id", "dup_txn_id", "order_id", "trace_id") if c in alerts.columns]
    refs = alerts.select("alert_id", "ts", F.explode(F.array_distinct(F.array_compact(F.array(*said)))).alias("_k"))
    newest = top_n_per_key(names.join(refs, "_k"), ["lookup", "_k"], [F.desc("ts"), F.desc("alert_id")], n)
    g = newest.select("lookup", "alert_id").distinct().groupBy("lookup").agg(      # at most 2 n of an id
        F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list("alert_id")).alias("_ids"))
    return hit.join(g, "lookup", "left").select(
        "lookup", F.col("_p").isNotNull().alias("found"), "_p.txn_id", "_p.order_id",
        F.coalesce("_n", F.lit(0)).alias("n_anomalies"),
        F.concat_ws(",", F.coalesce("_ids", F.array().cast("array<string>"))).alias("alert_ids"))


def flag_pills(alerts: DataFrame) -> DataFrame:
    """P19 for trace, PII and pod alerts: one row per active flag with its label and detail.

    A flag is its detail column, null where it is off: ``n_plus_1_count``,
    ``latency_variance``, ``dangling_span``, ``redaction_ratio``, ``k8s_restarts``."""
    def pill(column, label, detail):
        shown = detail if column == "dangling_span" else F.when(F.col(column) > 0, detail)
        return F.when(F.col(column).isNotNull(), F.struct(F.lit(label).alias("label"), shown.alias("detail")))

    pills = F.array(
        pill("n_plus_1_count", "N+1 Queries", F.concat(F.lit("×"), F.col("n_plus_1_count").cast("string"))),
        pill("latency_variance", "Bimodal Latency",
             F.concat(F.lit("σ²≈"), F.format_number(js_round(F.col("latency_variance")), 0))),
        pill("dangling_span", "Dangling Parent",
             F.when(F.col("dangling_span") != "", F.concat(F.lit("@"), F.col("dangling_span")))),
        pill("redaction_ratio", "PII Density",
             F.concat(js_round(F.col("redaction_ratio") * 100).cast("string"), F.lit("%"))),
        pill("k8s_restarts", "K8s Pod", F.concat(F.col("k8s_restarts").cast("string"), F.lit(" restarts"))))
    return alerts.select("alert_id", F.explode(F.array_compact(pills)).alias("p")).select(
        "alert_id", F.col("p.label").alias("label"), F.col("p.detail").alias("detail"))


def payment_anomalies(txn: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every payment with the anomalies that reference it (as the trigger or as
    the original of a duplicate); ``found`` is true for every listed payment."""
    a1 = alerts.select(F.col("txn_id").alias("_t"), "alert_id", "anomaly_type")
    a2 = alerts.filter(F.col("dup_txn_id").isNotNull()).select(
        F.col("dup_txn_id").alias("_t"), "alert_id", "anomaly_type")
    refs = a1.unionByName(a2).dropDuplicates(["_t", "alert_id"])
    g = refs.groupBy("_t").agg(F.count(F.lit(1)).alias("n_anomalies"),
                               F.array_sort(F.collect_list("anomaly_type")).alias("_types"))
    j = txn.select("txn_id", "order_id", "status", "gateway").join(g, F.col("txn_id") == F.col("_t"), "left")
    return j.select("txn_id", "order_id", "status", "gateway",
                    F.coalesce("n_anomalies", F.lit(0)).alias("n_anomalies"),
                    F.concat_ws(",", F.coalesce("_types", F.array().cast("array<string>"))).alias("anomaly_types"),
                    F.lit(True).alias("found"))


def union_dedupe(*lists: DataFrame) -> DataFrame:
    """Alert lists unioned and de-duplicated by id."""
    out = lists[0]
    for d in lists[1:]:
        out = out.unionByName(d)
    return out.dropDuplicates(["alert_id"])


def feed_dedupe(alerts: DataFrame, cap: int = 50) -> DataFrame:
    """De-duplicate by id (else trace_id-timestamp), keep the newest, cap 50."""
    tid = F.col("trace_id") if "trace_id" in alerts.columns else F.lit(None).cast("string")
    fid = F.coalesce(F.col("alert_id"), F.concat_ws("-", tid, F.col("ts").cast("string")))
    d = alerts.withColumn("feed_id", fid)
    newest = top_n_per_key(d, ["feed_id"], [F.desc("ts")], 1, split_col="seq").drop("rank")
    return newest.orderBy(F.desc("ts"), F.desc("feed_id")).limit(cap)


def gateway_choices(txn: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct gateways of both lists, sorted, with "All" first."""
    g = txn.select("gateway").union(registry.select(F.col("name").alias("gateway"))).distinct()
    allrow = g.sparkSession.createDataFrame([("All",)], "gateway string")
    out = allrow.union(g)
    return out.withColumn("sort_key", F.when(F.col("gateway") == "All", F.lit("")).otherwise(
        F.col("gateway"))).orderBy("sort_key").drop("sort_key")


def retain_by_id(df: DataFrame, n: int, id_col: str = "seq") -> DataFrame:
    """S10 id rule: keep rows with id ≥ max(id) − n (so n + 1 rows when ids are dense)."""
    mx = df.agg(F.max(id_col)).scalar()
    return df.filter(F.col(id_col) >= mx - F.lit(n))


def retain_newest(df: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """S10 newest-N rule (traces): exactly the n newest rows."""
    return df.orderBy(F.desc(order)).limit(n)


def compact_inr(v: Column) -> Column:
    """₹x.xx Cr (≥ 1e7), ₹x.xx L (≥ 1e5), else ₹ with Indian digit grouping."""
    whole = rnd(v).cast("long").cast("string")
    n = F.length(whole)
    head = F.when(n > 3, F.substring(whole, 1, n - 3)).otherwise(F.lit(""))
    tail = F.when(n > 3, F.substring(whole, -3, 3)).otherwise(whole)
    grouped_head = F.reverse(F.regexp_replace(F.regexp_replace(F.reverse(head), r"([0-9]{2})", "$1,"),
                                              ",$", ""))
    grouped = F.when(n > 3, F.concat(grouped_head, F.lit(","), tail)).otherwise(tail)
    return (F.when(v >= 1e7, F.concat(F.lit("₹"), F.format_string("%.2f", v / 1e7), F.lit(" Cr")))
            .when(v >= 1e5, F.concat(F.lit("₹"), F.format_string("%.2f", v / 1e5), F.lit(" L")))
            .otherwise(F.concat(F.lit("₹"), grouped)))


def clamp01(x: Column) -> Column:
    """Clamp to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def percent(x: Column, n: int = 1) -> Column:
    """X as a percentage rounded to n places."""
    return rnd(x * 100.0, n)


def payment_timeline(txn: DataFrame) -> DataFrame:
    """Four lifecycle steps at −1200 / −900 / −400 / 0 ms with labels by status."""
    failed = F.col("status") == "FAILED"
    pending = F.col("status") == "PENDING"
    t0 = F.unix_micros(F.col("ts").cast("timestamp"))

    def step(i, label, sub, off_ms, done, bad):
        return F.struct(F.lit(i).alias("step"), label.alias("label"), sub.alias("sub"),
                        F.timestamp_micros(t0 - off_ms * 1000).alias("at"), done.alias("done"),
                        bad.alias("bad"))
    steps = F.array(
        step(1, F.lit("Payment initiated"), F.lit(None).cast("string"), 1200, F.lit(True), F.lit(False)),
        step(2, F.lit("Sent to gateway"), F.col("gateway"), 900, F.lit(True), F.lit(False)),
        step(3, F.when(failed, "Authorization declined").otherwise("Authorized by bank"),
             F.when(failed, F.col("failure_reason")).otherwise(F.col("provider")), 400, F.lit(True), failed),
        step(4, F.when(failed, "Payment failed").when(pending, "Awaiting settlement")
             .otherwise("Captured / settled"), F.lit(None).cast("string"), 0, ~failed & ~pending, failed))
    return txn.select("txn_id", F.explode(steps).alias("s")).select("txn_id", "s.*")


def gateway_cards(integ: DataFrame) -> DataFrame:
    """Live / ready / available, and the "Ns ago" / "Nm ago" text."""
    s = F.col("secs_since_event")
    return integ.select(
        "name",
        F.when(F.col("live"), "live").when(F.col("configured"), "ready").otherwise("available").alias("status"),
        F.when(s.isNull(), F.lit(None).cast("string"))
         .when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
         .otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m ago"))).alias("ago"))


def incidents_view(alerts: DataFrame, anomalies_only: bool = True, payment_only: bool = False,
                   first: int | None = None) -> DataFrame:
    """Anomalies-only toggle, payment-incident IN filter, first N newest."""
    d = alerts
    if anomalies_only and "is_anomaly" in d.columns:
        d = d.filter(F.col("is_anomaly"))
    if payment_only:
        d = d.filter(F.col("anomaly_type").isin(*PAYMENT_ANOMALY_TYPES))
    if first:
        d = d.orderBy(F.desc("ts"), F.desc("alert_id")).limit(first)
    return d


def json_roundtrip(alerts: DataFrame, scores: Column | None = None) -> DataFrame:
    """JSON text columns decoded with an empty default (arrays → [], maps → {});
    ``scores`` is the map of model scores, null for an alert that has none."""
    scores = scores if scores is not None else F.lit(None).cast("map<string,double>")
    enc = alerts.select("alert_id", F.to_json(F.array("reason")).alias("reasons_json"),
                        F.to_json(scores).alias("ml_scores_json"))
    return enc.select(
        "alert_id",
        F.coalesce(F.from_json("reasons_json", "array<string>"), F.array().cast("array<string>")).alias("reasons"),
        F.coalesce(F.from_json("ml_scores_json", "map<string,double>"),
                   F.create_map().cast("map<string,double>")).alias("ml_scores"))
