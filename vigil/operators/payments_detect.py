"""Rolling payment detectors.

Arrival order is the transaction sequence ``seq`` (ties in ``ts`` broken by
``seq``).  Every rolling frame is evaluated inside (key, block) partitions built
by ``plans.ordered`` so that a single hot gateway or user never becomes one
task, and the result is exact:

* failure spike — last 12 txns of the gateway → ``rowsBetween(-11, 0)`` in
  row blocks with an 11-row overlap;
* velocity — user's txns in the last 60 s: a difference of two exact
  positions in a range-partitioned order (``sliding_count``);
* duplicate charge — oldest earlier charge of the same user and amount within
  120 s: in each dyadic node of the amounts less than 0.01 away, the charge at
  the window's lower position (``first_in_window``);
* gateway timeout — a row predicate.

Candidates then pass the 45 s per-(type, target) cooldown (greedy, first
fires), which only moves candidate rows.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import known, rnd

from ..functions.constants import PAY_TUNING as T
from ..plans.materialize import materialize
from ..plans.ordered import first_in_window, greedy_cooldown, key_rank, range_rank, row_blocks, sliding_count

# block sizes: a window partition never holds more than this many own rows
BLOCK_ROWS = 200_000
COARSE_SEQ = 5_000_000
US = 1_000_000


def _keyed_rows_frame(txn: DataFrame, key: str, overlap: int, aggs: dict,
                      block_rows: int | None = None, coarse_seq: int | None = None) -> DataFrame:
    """Evaluate ``aggs`` over ``rowsBetween(-overlap, 0)`` per ``key`` in arrival order."""
    br = block_rows or BLOCK_ROWS
    cs = coarse_seq or COARSE_SEQ
    ranked = key_rank(txn, [key], "seq", F.floor(F.col("seq") / cs))
    blocks = row_blocks(ranked, "krank", br, overlap)
    w = Window.partitionBy(key, "blk").orderBy("krank").rowsBetween(-overlap, 0)
    out = blocks.select("*", *[fn(w).alias(name) for name, fn in aggs.items()])
    return out.filter(~F.col("ghost")).drop("blk", "ghost", "krank")


def failure_spike_candidates(txn: DataFrame, **kw) -> DataFrame:
    """Last 12 of the gateway, ≥3 of them, failed share ≥ 0.5."""
    n = T["fail_window"]
    txn = known(txn, "gateway")
    fr = _keyed_rows_frame(txn, "gateway", n - 1, {
        "_n": lambda w: F.count(F.lit(1)).over(w),
        "_f": lambda w: F.sum(F.when(F.col("status") == "FAILED", 1).otherwise(0)).over(w),
    }, **kw)
    rate = F.col("_f") / F.col("_n")
    return (fr.filter((F.col("_n") >= T["fail_min"]) & (rate >= T["fail_rate"]))
            .withColumn("failure_rate", rnd(rate, 2))
            .withColumn("score", F.least(F.lit(0.99), rate + 0.4))
            .withColumn("target", F.col("gateway")).drop("_n", "_f"))


def velocity_candidates(txn: DataFrame, memory: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """user's txns within 60 s including the current one, ≥ 5; ``memory`` bounds the count.

    The count is a difference of two exact positions in a range-partitioned
    order (``sliding_count``), so even one user with a third of all rows is
    spread over many tasks.
    """
    win = T["velocity_window_s"]
    fr = sliding_count(known(txn, "user"), ["user"], "ts", "seq", win * US, "_n",
                       hot_rows=hot_rows)
    per_min = F.col("_n") if memory is None else F.least(F.lit(memory), F.col("_n"))
    return (fr.withColumn("txn_per_min", per_min.cast("long"))
            .filter(F.col("txn_per_min") >= T["velocity_per_min"])
            .withColumn("score", F.least(F.lit(0.99), 0.7 + F.col("txn_per_min") / 100.0))
            .withColumn("target", F.col("user")).drop("_n"))


DUP_APART = 0.01


def _places(x: np.ndarray) -> np.ndarray:
    """The place of each finite double among all doubles, as whole numbers."""
    bits = x.view(np.int64)
    return np.where(bits >= 0, bits, np.iinfo(np.int64).min - bits)


def _doubles(places: np.ndarray) -> np.ndarray:
    return np.where(places >= 0, places, np.iinfo(np.int64).min - places).view(np.float64)


def _close_range(batches):
    """The least and the greatest double less than DUP_APART from each amount, as doubles subtract."""
    for pdf in batches:
        a = pdf["amount"].to_numpy(dtype=float).copy()
        for out, sign in (("_least", -1.0), ("_greatest", 1.0)):
            near, far = _places(a), _places(a + sign * np.maximum(1.1 * DUP_APART, 1e-15 * a))
            for _ in range(64):                        # bisection; far and near end up neighbours
                mid = near + (far - near) // 2
                close = np.abs(a - _doubles(mid)) < DUP_APART
                near, far = np.where(close, mid, near), np.where(close, far, mid)
            pdf[out] = _doubles(near)
        yield pdf


def _amount_nodes(charges: DataFrame) -> DataFrame:
    """user, amount, its position and the dyadic nodes (level, node) that make up the close amounts.

    All distinct (user, amount) stand in one range-partitioned order.  The amounts less than
    0.01 away are a stretch of positions, which splits into at most two nodes a level.
    """
    amounts = materialize(charges.select("user", "amount").distinct()
                          .mapInPandas(_close_range, "user string, amount double, _least double, _greatest double"),
                          "dup-amounts")
    ends = [amounts.select("user", "amount", F.col(value).alias("_v"), F.lit(kind).alias("_kind"), F.lit(int(kind == 1)).alias("_own"))
            for value, kind in (("_least", 0), ("amount", 1), ("_greatest", 2))]
    ranked = range_rank(ends[0].unionByName(ends[1]).unionByName(ends[2]), ["user", "_v", "_kind", "amount"], flags=["_own"])
    at = ranked.groupBy("user", "amount").agg(*[
        F.max(F.when(F.col("_kind") == k, F.col("_fpos__own"))).alias(n) for k, n in ((0, "_lo"), (1, "_p"), (2, "_hi"))])

    def up(s, k):
        left, right = s["l"] % 2 == 1, s["r"] % 2 == 1
        some = s["l"] < s["r"]
        new = F.filter(F.array(F.when(some & left, s["l"]), F.when(some & right & (s["r"] - 1 >= s["l"] + left.cast("long")), s["r"] - 1)),
                       lambda x: x.isNotNull())
        return F.struct(F.floor((s["l"] + left.cast("long")) / 2).alias("l"), F.floor((s["r"] - right.cast("long")) / 2).alias("r"),
                        F.concat(s["nodes"], F.transform(new, lambda x: F.struct(k.alias("level"), x.alias("node")))).alias("nodes"))

    none = F.array().cast("array<struct<level:int,node:bigint>>")
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("_hi") - F.col("_lo"))).cast("int"))
    nodes = F.aggregate(levels, F.struct(F.col("_lo").alias("l"), F.col("_hi").alias("r"), none.alias("nodes")), up, lambda s: s["nodes"])
    return at.select("user", "amount", "_p", nodes.alias("_nodes"))


def duplicate_candidates(txn: DataFrame) -> DataFrame:
    """Non-FAILED charge with amount > 0 and an earlier such charge of the same
    user, less than 0.01 apart, at most 120 s before; the oldest match is reported.

    A charge stands in one dyadic node per level of its amount's position and looks up the
    few nodes that make up the amounts close to its own (``_amount_nodes``), so neither
    charges nor amounts are paired: rows grow with charges times the logarithm of the number
    of amounts in a cent.  In each node the oldest match is the charge at the window's lower
    position in a range-partitioned order of (node, ts, seq).  Whole cents need one level.
    """
    win = T["dup_window_s"]
    ch = known(txn, "user").filter((F.col("status") != "FAILED") & (F.col("amount") > 0) & (F.col("amount") < float("inf")))
    slim = ch.select("user", F.col("amount").cast("double").alias("amount"), "ts", "seq", "txn_id")
    nodes = materialize(_amount_nodes(slim), "dup-nodes")
    placed = slim.join(nodes, ["user", "amount"])
    top = nodes.agg(F.coalesce(F.max(F.array_max(F.transform("_nodes", lambda n: n["level"]))), F.lit(0))).scalar()
    stands = (placed.withColumn("_level", F.explode(F.sequence(F.lit(0), top)))
              .withColumn("_node", F.expr("shiftright(_p, _level)")))
    asks = placed.withColumn("_n", F.explode("_nodes")).select(
        "ts", "seq", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    first = first_in_window(stands, asks, ["_level", "_node"], "ts", "seq", win * US, F.col("txn_id"))
    oldest = first.groupBy("seq").agg(F.min(F.struct("_at", "_first")).getField("_first").alias("dup_txn_id"))
    return (ch.join(oldest, "seq")
            .withColumn("score", F.lit(0.9))
            .withColumn("target", F.concat_ws(":", "user", F.col("amount").cast("string"))))


def timeout_candidates(txn: DataFrame) -> DataFrame:
    """Latency ≥ 8000 ms."""
    return (known(txn, "gateway").filter(F.col("latency_ms") >= T["latency_ms"])
            .withColumn("score", F.least(F.lit(0.95), 0.6 + F.col("latency_ms") / 40000.0))
            .withColumn("target", F.col("gateway")))


ALERT_COLS = ["anomaly_type", "reason", "service", "route", "anomaly_score", "duration_ms",
              "txn_id", "order_id", "gateway", "ts", "seq", "failure_rate", "txn_per_min",
              "account", "dup_txn_id"]


def _shape(c: DataFrame, atype: str, reason: str, service: str, route) -> DataFrame:
    def opt(name, typ):
        return F.col(name) if name in c.columns else F.lit(None).cast(typ)
    return c.select(
        F.lit(atype).alias("anomaly_type"), F.lit(reason).alias("reason"),
        F.lit(service).alias("service"), route.alias("route"),
        rnd(F.col("score"), 4).alias("anomaly_score"),
        (F.col("latency_ms") if reason == "gateway_timeout" else F.lit(0.0)).alias("duration_ms"),
        "txn_id", "order_id", "gateway", "ts", "seq",
        opt("failure_rate", "double").alias("failure_rate"),
        opt("txn_per_min", "long").alias("txn_per_min"),
        (F.col("user") if reason == "fraud_velocity" else F.lit(None).cast("string")).alias("account"),
        opt("dup_txn_id", "string").alias("dup_txn_id"),
        F.concat(F.lit(reason + ":"), F.col("target")).alias("cooldown_key"))


def payment_alert_candidates(txn: DataFrame, **kw) -> DataFrame:
    """All four detectors' candidates, before the cooldown."""
    txn = known(txn, "gateway", "user")
    gw_route = F.concat(F.lit("payments.gateway/"), F.col("gateway"))
    parts = [
        _shape(failure_spike_candidates(txn, **kw), "Payment Failure Spike",
               "payment_failure_spike", "payment-service", gw_route),
        _shape(velocity_candidates(txn), "Fraud Velocity", "fraud_velocity", "fraud-service",
               F.lit("payments.fraud/velocity")),
        _shape(duplicate_candidates(txn), "Duplicate Charge", "duplicate_charge",
               "payment-service", F.lit("payments.idempotency/violation")),
        _shape(timeout_candidates(txn), "Gateway Timeout", "gateway_timeout",
               "payment-service", gw_route),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def payment_alerts(txn: DataFrame, cooldown_s: float | None = None, **kw) -> DataFrame:
    """M15 (+W5): fired payment alerts, one row each, flat flag columns."""
    cd = T["refire_cooldown_s"] if cooldown_s is None else cooldown_s
    c = payment_alert_candidates(txn, **kw)
    fired = greedy_cooldown(c, "cooldown_key", "ts", "seq", cd)
    return fired.filter(F.col("fired")).select(*ALERT_COLS)


def rule_flags(alerts: DataFrame) -> DataFrame:
    """M12 for payment alerts: the shared flag struct with payment keys set."""
    r = F.col("reason")
    return alerts.withColumn("rule_flags", F.struct(
        F.lit(False).alias("n_plus_1"), F.lit(0).alias("n_plus_1_count"),
        F.lit(False).alias("bimodal_latency"), F.lit(0.0).alias("latency_variance"),
        F.lit(False).alias("dependency_break"), F.lit(None).cast("string").alias("dangling_span"),
        F.lit(False).alias("pii_density"), F.lit(0.0).alias("redaction_ratio"),
        F.col("txn_id"), F.col("order_id"), F.col("gateway"),
        (r == "payment_failure_spike").alias("payment_failure"), F.col("failure_rate"),
        (r == "fraud_velocity").alias("fraud_velocity"), F.col("txn_per_min"), F.col("account"),
        (r == "duplicate_charge").alias("duplicate_charge"), F.col("dup_txn_id"),
        (r == "gateway_timeout").alias("gateway_timeout")))


def payment_counters(txn: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each live payment +1 total on payment-service; each alert +1 anomalous."""
    a = txn.filter(F.col("source") == "live").select(
        F.lit("payment-service").alias("service"), F.lit(1).alias("t"), F.lit(0).alias("a"))
    b = alerts.select(F.col("service"), F.lit(0).alias("t"), F.lit(1).alias("a"))
    return a.unionByName(b).groupBy("service").agg(
        F.sum("t").cast("long").alias("total"), F.sum("a").cast("long").alias("anomalous"))


def payment_throughput(txn: DataFrame, memory: int | None = None) -> DataFrame:
    """Payments in the last 60 s, per payment (at most ``memory``, if given); the
    global order is range-partitioned (``sliding_count``), never one task."""
    win = T["throughput_window_s"]
    fr = sliding_count(txn, [], "ts", "seq", win * US, "_n")
    count = F.col("_n") if memory is None else F.least(F.lit(memory), F.col("_n"))
    return fr.select("seq", "ts", count.cast("long").alias("throughput"))


def _p99_fold(key: str, memory: int):
    import bisect

    def fold(batches):
        cur = None
        window: list = []
        srt: list = []
        for pdf in batches:
            if pdf.empty:
                continue
            ks, bs, xs, gh = (pdf[key].tolist(), pdf["blk"].tolist(), pdf["latency_ms"].tolist(),
                              pdf["ghost"].tolist())
            out = []
            for i in range(len(pdf)):
                g = (ks[i], bs[i])
                if g != cur:
                    cur, window, srt = g, [], []
                x = xs[i]
                window.append(x)
                bisect.insort(srt, x)
                if len(window) > memory:
                    old = window.pop(0)
                    del srt[bisect.bisect_left(srt, old)]
                n = len(srt)
                out.append(srt[min(n - 1, int(0.99 * (n - 1)))])
            res = pdf.assign(_p=out)
            yield res[~res["ghost"]]
    return fold


def rolling_p99(txn: DataFrame, key: str = "gateway", keep: tuple[str, ...] = (), **kw) -> DataFrame:
    """p99 of the last 300 latencies, index min(n-1, int(0.99*(n-1))), per key.

    A sliding sorted window (bisect) folded over the key's rows in arrival
    order inside (key, block) partitions; each block is warmed up by the
    previous block's last 299 rows, so the frame is exact.
    """
    from pyspark.sql import types as Ty
    m = T["p99_memory"]
    br = kw.get("block_rows") or BLOCK_ROWS
    cs = kw.get("coarse_seq") or COARSE_SEQ
    ranked = key_rank(known(txn.select(key, "seq", "ts", "latency_ms", *keep), key), [key], "seq", F.floor(F.col("seq") / cs))
    blocks = row_blocks(ranked, "krank", br, m - 1)
    schema = Ty.StructType(blocks.schema.fields + [Ty.StructField("_p", Ty.DoubleType())])
    d = (blocks.repartition(key, "blk").sortWithinPartitions(key, "blk", "krank")
         .mapInPandas(_p99_fold(key, m), schema))
    return d.select(key, "seq", "ts", *keep, rnd(F.col("_p"), 2).alias("p99_latency"))
