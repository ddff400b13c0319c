from __future__ import annotations

import random

from helpers import TXN_SCHEMA, loop_payment_alerts, txn_rows

from vigil.operators import payments_detect as PD


def _alerts(spark, rows, **kw):
    df = spark.createDataFrame(rows, TXN_SCHEMA)
    return sorted((r["reason"], r["seq"]) for r in PD.payment_alerts(df, **kw).collect())


def test_failure_spike_fires_at_third(spark):
    rows = txn_rows([(1, 0, "u1", "G", "FAILED", 10, 100), (2, 1, "u2", "G", "SUCCESS", 11, 100),
                     (3, 2, "u3", "G", "FAILED", 12, 100)])
    assert _alerts(spark, rows) == [("payment_failure_spike", 3)]


def test_velocity_fires_at_fifth(spark):
    rows = txn_rows([(i, i * 10, "u1", f"G{i}", "SUCCESS", 10 + i, 100) for i in range(1, 6)])
    assert _alerts(spark, rows) == [("fraud_velocity", 5)]


def test_duplicate_window_edge(spark):
    fires = txn_rows([(1, 0, "u1", "A", "SUCCESS", 50, 1), (2, 120, "u1", "B", "SUCCESS", 50, 1)])
    assert _alerts(spark, fires) == [("duplicate_charge", 2)]
    quiet = txn_rows([(1, 0, "u1", "A", "SUCCESS", 50, 1), (2, 121, "u1", "B", "SUCCESS", 50, 1)])
    assert _alerts(spark, quiet) == []


def test_cooldown_sequence(spark):
    secs = [0, 44, 45, 89, 90]
    rows = txn_rows([(i + 1, s, f"u{i}", "G", "SUCCESS", 10 + i, 9000) for i, s in enumerate(secs)])
    got = [seq for reason, seq in _alerts(spark, rows) if reason == "gateway_timeout"]
    assert got == [1, 3, 5]


def test_random_stream_matches_loop_and_blocks(spark):
    rnd = random.Random(7)
    specs, t = [], 0.0
    for seq in range(1, 1201):
        t += rnd.choice([0.5, 1, 2, 5, 20])
        specs.append((seq, t, f"u{rnd.randint(0, 6)}", rnd.choice(["A", "B", "C"]),
                      rnd.choice(["SUCCESS", "FAILED", "FAILED", "PENDING"]), rnd.choice([0, 10, 20, 30]),
                      rnd.choice([100, 9000])))
    rows = txn_rows(specs)
    want = loop_payment_alerts(rows)
    assert _alerts(spark, rows) == want
    # tiny row blocks force the overlap path; the result must not change
    assert _alerts(spark, rows, block_rows=16, coarse_seq=100) == want


def test_rolling_p99_matches_loop_across_blocks(spark):
    rnd = random.Random(2)
    specs = [(i, i * 0.5, "u", rnd.choice("AB"), "SUCCESS", 10, rnd.randint(1, 10000)) for i in range(1, 900)]
    rows = txn_rows(specs)
    df = spark.createDataFrame(rows, TXN_SCHEMA)
    got = {r["seq"]: r["p99_latency"] for r in PD.rolling_p99(df, block_rows=350, coarse_seq=200).collect()}
    want = {}
    for gw in "AB":
        lat = [r for r in rows if r["gateway"] == gw]
        for i, r in enumerate(lat):
            w = sorted(x["latency_ms"] for x in lat[max(0, i - 299): i + 1])
            want[r["seq"]] = round(w[min(len(w) - 1, int(0.99 * (len(w) - 1)))], 2)
    assert got == want


def test_null_keys_keep_their_alerts(spark):
    """Rows without a user or gateway are detected under the key 'unknown'."""
    from vigil.operators import payments_detect as PD
    specs = [(i, 3 * i, None, None, "FAILED" if i % 2 else "SUCCESS", 10 + i, 9000 if i == 3 else 10) for i in range(10)]
    txn = spark.createDataFrame(txn_rows(specs), TXN_SCHEMA)
    named = [(*s[:2], "unknown", "unknown", *s[4:]) for s in specs]
    got = sorted((r.reason, r.seq) for r in PD.payment_alerts(txn).select("service", "reason", "seq").collect())
    assert got == loop_payment_alerts(txn_rows(named)) and {"fraud_velocity", "payment_failure_spike"} <= {x for x, _ in got}
    assert PD.rolling_p99(txn).count() == len(specs)


def test_duplicates_across_a_cent_boundary(spark):
    rows = txn_rows([(1, 0, "u", "A", "SUCCESS", 10.004, 1), (2, 30, "u", "A", "SUCCESS", 10.006, 1),
                     (3, 60, "u", "A", "SUCCESS", 10.0155, 1), (4, 90, "u", "A", "SUCCESS", 10.02, 1),
                     (5, 300, "u", "A", "SUCCESS", 10.004, 1)])
    df = spark.createDataFrame(rows, TXN_SCHEMA)
    got = {r["seq"]: r["dup_txn_id"] for r in PD.duplicate_candidates(df).collect()}
    ids = {r["seq"]: r["txn_id"] for r in df.collect()}
    assert got == {2: ids[1], 3: ids[2], 4: ids[3]}


def test_duplicates_among_close_amounts_match_loop(spark):
    """Amounts around the 0.01 limit, exact repeats, and very many within one cent."""
    rnd = random.Random(31)
    specs, t = [], 0.0
    for seq in range(1, 1401):
        t += rnd.choice([0.0, 1.0, 7.0, 60.0])
        amount = rnd.choice([20.0, 20.01, 20.005, 19.99, 20.01 - 1e-9, 5.0 + rnd.random() * 0.03, 0.0, 0.005, 1e9, 1e9 + 0.005])
        specs.append((seq, t, rnd.choice("aab"), "G", rnd.choice(["SUCCESS", "PENDING", "FAILED"]), amount, 1))
    rows = txn_rows(specs)
    want, seen = {}, []
    for r in rows:
        if r["status"] != "FAILED" and r["amount"] > 0:
            close = [s for s in seen if s["user"] == r["user"] and abs(s["amount"] - r["amount"]) < 0.01
                     and (r["ts"] - s["ts"]).total_seconds() <= 120]
            if close:
                want[r["seq"]] = close[0]["txn_id"]
            seen.append(r)
    got = {r["seq"]: r["dup_txn_id"] for r in PD.duplicate_candidates(spark.createDataFrame(rows, TXN_SCHEMA)).collect()}
    assert got == want and len(want) > 200
    assert PD.duplicate_candidates(spark.createDataFrame([], TXN_SCHEMA)).collect() == []
