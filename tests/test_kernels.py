from __future__ import annotations

import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.plans.ordered import exact_pick, greedy_cooldown, top_n_per_key


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), min_size=1, max_size=40))
def test_cooldown_never_fires_closer_than_limit(spark, pts):
    t0 = datetime(2024, 1, 1)
    rows = [(f"k{k}", t0 + timedelta(seconds=s), i) for i, (k, s) in enumerate(pts)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq long")
    fired = greedy_cooldown(df, "k", "ts", "seq", 45).filter("fired").collect()
    by = {}
    for r in fired:
        by.setdefault(r["k"], []).append(r["ts"])
    for ts in by.values():
        ts.sort()
        assert all((b - a).total_seconds() >= 45 for a, b in zip(ts, ts[1:]))
    # the first candidate of every key fires
    assert set(by) == {f"k{k}" for k, _ in pts}


def test_exact_pick_matches_sort(spark):
    rnd = random.Random(5)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.5]) * rnd.randint(1, 500) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    n = len(vals)
    want = sorted(vals)
    picks = exact_pick(df, "v", {"a": F.lit(0), "b": F.lit(n // 2), "c": F.lit(int(n * 0.99)), "d": F.lit(n - 1)},
                       buckets=16)
    got = spark.range(1).select(*[c.alias(k) for k, c in picks.items()]).first()
    assert (got["a"], got["b"], got["c"], got["d"]) == (want[0], want[n // 2], want[int(n * 0.99)], want[-1])


def test_top_n_per_key(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), i, rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, seq long, v double")
    got = {(r["k"], r["seq"]) for r in top_n_per_key(df, ["k"], [F.desc("v")], 7).collect()}
    want = set()
    for k in "ab":
        best = sorted([r for r in rows if r[0] == k], key=lambda r: -r[2])[:7]
        want |= {(r[0], r[1]) for r in best}
    assert got == want


def test_partition_count_does_not_change_alerts(spark):
    from helpers import TXN_SCHEMA, txn_rows
    from vigil.operators import payments_detect as PD
    rnd = random.Random(11)
    specs, t = [], 0.0
    for seq in range(1, 300):
        t += rnd.choice([1, 3, 10])
        specs.append((seq, t, f"u{rnd.randint(0, 3)}", rnd.choice("AB"), rnd.choice(["SUCCESS", "FAILED"]),
                      rnd.choice([10, 20]), rnd.choice([1, 9000])))
    df = spark.createDataFrame(txn_rows(specs), TXN_SCHEMA)
    a = sorted(tuple(r) for r in PD.payment_alerts(df).select("reason", "seq").collect())
    b = sorted(tuple(r) for r in PD.payment_alerts(df.repartition(7)).select("reason", "seq").collect())
    assert a == b


def loop_cooldown(rows, cooldown):
    """(key, seq) fired, of (key, time, seq) rows."""
    last, fired = {}, set()
    for k, ts, seq in sorted(rows):
        if k not in last or (ts - last[k]).total_seconds() >= cooldown:
            last[k] = ts
            fired.add((k, seq))
    return fired


def test_cooldown_blocks_match_loop(spark):
    """Blocks of 7 candidates of a hot key, dense, with bursts of one second and long gaps."""
    rnd = random.Random(21)
    t0 = datetime(2024, 1, 1)
    rows, t = [], 0.0
    for i in range(900):
        t += rnd.choice([0.0, 0.0, 0.0, 1.0, 3.0, 20.0, 44.0, 45.0, 46.0]) if i % 100 else 500.0
        rows.append((rnd.choice(["hot", "hot", "hot", "cold", "tiny" if i % 50 == 0 else "hot"]), t0 + timedelta(seconds=t), i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq long").withColumn("other", F.lit("x"))
    for size in (1, 7, 200_000):
        out = greedy_cooldown(df, "k", "ts", "seq", 45, block_rows=size)
        assert out.columns == ["k", "ts", "seq", "other", "fired"] and out.count() == len(rows)
        assert {(r["k"], r["seq"]) for r in out.filter("fired").collect()} == loop_cooldown(rows, 45)


def test_sliding_count_hot_key_with_ties(spark):
    from vigil.plans.ordered import sliding_count
    rnd = random.Random(17)
    t0 = datetime(2024, 1, 1)
    rows, t = [], 0.0
    for i in range(1500):
        t += rnd.choice([0.0, 0.0, 0.5, 3.0, 30.0])
        rows.append((rnd.choice(["hot"] * 8 + ["b"]), t0 + timedelta(seconds=t), i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq long")
    got = {r["seq"]: r["n"] for r in sliding_count(df, ["k"], "ts", "seq", 60_000_000, "n").collect()}
    want = {}
    for k, ts, s in rows:
        want[s] = sum(1 for k2, ts2, s2 in rows
                      if k2 == k and (ts2, s2) <= (ts, s) and (ts - ts2).total_seconds() <= 60)
    assert got == want


def test_sliding_cold_equals_hot_and_first_in_window(spark):
    from vigil.plans.ordered import first_in_window, sliding_count
    rnd = random.Random(23)
    t0 = datetime(2024, 1, 1)
    rows, t = [], 0.0
    for i in range(800):
        t += rnd.choice([0.0, 1.0, 10.0, 70.0])
        rows.append((rnd.choice(["a", "a", "b", "c"]), t0 + timedelta(seconds=t), i, f"v{i}", i % 3 == 0))
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq long, val string, f boolean")
    w = 60_000_000
    cold = {(r["seq"], r["n"], r["m"]) for r in sliding_count(df, ["k"], "ts", "seq", w, "n", "f", "m").collect()}
    hot = {(r["seq"], r["n"], r["m"]) for r in
           sliding_count(df, ["k"], "ts", "seq", w, "n", "f", "m", hot_rows=10).collect()}
    assert cold == hot
    first = first_in_window(df, df, ["k"], "ts", "seq", w, F.col("val"))
    got = {r["seq"]: r["_first"] for r in first.collect()}
    want = {}
    for k, ts, s, v, _ in rows:
        older = [(ts2, s2, v2) for k2, ts2, s2, v2, _ in rows
                 if k2 == k and (ts2, s2) < (ts, s) and (ts - ts2).total_seconds() <= 60]
        if older:
            want[s] = min(older)[2]
    assert got == want


def test_exact_pick_with_a_hot_value(spark):
    rnd = random.Random(29)
    vals = [7.0] * 1200 + [rnd.uniform(0, 20) for _ in range(2400)]
    rnd.shuffle(vals)
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    n = len(vals)
    want = sorted(vals)
    idx = {"a": 0, "b": n // 3, "c": n // 2, "d": int(n * 0.95), "e": n - 1}
    picks = exact_pick(df, "v", {k: F.lit(i) for k, i in idx.items()}, buckets=32)
    got = spark.range(1).select(*[c.alias(k) for k, c in picks.items()]).first()
    assert {k: got[k] for k in idx} == {k: want[i] for k, i in idx.items()}


def test_range_rank_shuffles_rows_once(spark, monkeypatch):
    """Running counts of flags are taken where the rows stand; positions match a loop, nulls count as no flag."""
    from vigil.plans import materialize as M
    from vigil.plans.ordered import range_rank
    rnd = random.Random(5)
    rows = [(rnd.randrange(50), i, rnd.choice([0, 1, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "v long, s long, f int")
    plans, write = [], M.materialize

    def kept(d, name):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        return write(d, name)

    monkeypatch.setattr(M, "materialize", kept)
    got = {r["s"]: (r["_pos"], r["_fpos_f"]) for r in range_rank(df, ["v", "s"], flags=["f"]).collect()}
    want, flagged = {}, 0
    for i, (_, s, f) in enumerate(sorted(rows, key=lambda r: r[:2])):
        want[s] = (i, flagged)
        flagged += f or 0
    assert got == want
    assert len(plans) == 1 and plans[0].count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plans[0]
