from __future__ import annotations

import random

from helpers import loop_bimodal, loop_n_plus_1
from pyspark.sql import functions as F

from vigil.operators import traces as TR

SCHEMA = "trace_id string, trace_seq long, primary_service string, span_count long, duration_ms double"


def _df(spark, counts, durs, svc="svc"):
    rows = [(str(i), i, svc, int(c), float(d)) for i, (c, d) in enumerate(zip(counts, durs))]
    return spark.createDataFrame(rows, SCHEMA)


def test_n_plus_1_scenario(spark):
    rnd = random.Random(1)
    counts = [rnd.randint(3, 5) for _ in range(10)] + [25]
    got = [r["trace_seq"] for r in TR.n_plus_1(_df(spark, counts, [1.0] * 11)).filter("n_plus_1").collect()]
    assert got == [10]
    counts9 = counts[1:]
    assert TR.n_plus_1(_df(spark, counts9, [1.0] * 10)).filter("n_plus_1").count() == 0


def test_bimodal_scenario(spark):
    durs = ([100.0, 100.0, 100.0, 2000.0] * 10)[:40]
    got = sorted(r["trace_seq"] for r in TR.bimodal(_df(spark, [1] * 40, durs)).filter("bimodal_latency").collect())
    assert got == list(range(11, 40, 4))
    assert got == loop_bimodal(durs)


def test_rolling_detectors_match_loop_across_blocks(spark):
    rnd = random.Random(3)
    counts = [rnd.choice([2, 3, 4, 5, 30]) for _ in range(600)]
    durs = [rnd.choice([50.0, 120.0, 3000.0]) for _ in range(600)]
    df = _df(spark, counts, durs)
    n1 = sorted(r["trace_seq"] for r in TR.n_plus_1(df, coarse=37).filter("n_plus_1").collect())
    assert n1 == loop_n_plus_1(counts)
    bm = sorted(r["trace_seq"] for r in TR.bimodal(df, block_rows=250, coarse=50)
                .filter("bimodal_latency").collect())
    assert bm == loop_bimodal(durs)


def _variances(durs):
    want, m, v = [], 0.0, 0.0
    for i, x in enumerate(durs):
        want.append(v)
        m, v = (x, 0.0) if i == 0 else (m + 0.2 * (x - m), 0.2 * ((x - m) * (x - m)) + 0.8 * v)
    return want, m, v


def test_variance_after_an_outlier_is_that_of_the_unbroken_fold(spark):
    for outlier, at, size in ((1e9, 30, 50), (1e150, 100, 37), (1e150, 74, 37), (1e200, 40, 61)):
        durs = [100.0 + i % 7 for i in range(at)] + [outlier] + [100.0 + i % 5 for i in range(499 - at)]
        want, _, _ = _variances(durs)
        rows = TR.bimodal(_df(spark, [1] * 500, durs), block_rows=size, coarse=70).orderBy("trace_seq").collect()
        assert len(rows) == 500
        for r, w in zip(rows, want):
            assert r["latency_variance"] == w or abs(r["latency_variance"] - w) <= 1e-6 + 1e-9 * w


def test_ewma_state_is_two_numbers(spark):
    rnd = random.Random(12)
    durs = [rnd.choice([50.0, 120.0, 3000.0]) for _ in range(300)]
    df = _df(spark, [1] * 300, durs)
    _, mean, var = _variances(durs)
    first = TR.ewma_state(df.filter("trace_seq < 117"), block_rows=25, coarse=40)
    r = TR.ewma_state(df.filter("trace_seq >= 117"), block_rows=25, coarse=40, before=first).first()
    assert r["n"] == 300 and abs(r["m"] - mean) <= 1e-9 * mean and abs(r["v"] - var) <= 1e-9 * var
    assert first.columns == ["primary_service", "n", "m", "v"]
    later = TR.bimodal(df.filter("trace_seq >= 117"), block_rows=25, coarse=40, before=first)
    assert sorted(x["trace_seq"] for x in later.filter("bimodal_latency").collect()) == [
        i for i in loop_bimodal(durs) if i >= 117]


def test_build_traces_dangling_and_primary(spark):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    rows = [("t1", "a", "", "api-gateway", "root", 10.0, t0, 0),
            ("t1", "b", "a", "db", "query db", 30.0, t0 + timedelta(milliseconds=1), 2),
            ("t1", "c", "zz", "api-gateway", "orphan", 25.0, t0 + timedelta(milliseconds=2), 0),
            ("t2", "x", None, "svc", "only", 5.0, t0, 0)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, service string, "
                                     "name string, duration_ms double, start_time timestamp, status_code int")
    out = {r["trace_id"]: r for r in TR.build_traces(df).collect()}
    assert out["t1"]["dangling_span"] == "orphan"
    assert out["t1"]["primary_service"] == "api-gateway"   # 35 > 30
    assert out["t1"]["span_count"] == 3
    assert abs(out["t1"]["error_rate"] - 1 / 3) < 1e-12
    assert out["t2"]["dangling_span"] is None


def test_partial_merge_is_independent_of_window_size(spark):
    from datetime import datetime, timedelta
    rnd = random.Random(8)
    t0 = datetime(2024, 1, 1)
    rows = []
    for t in range(40):
        for s in range(rnd.randint(1, 6)):
            rows.append((f"t{t}", f"s{s}", "" if s == 0 else f"s{s - 1}", rnd.choice(["a", "b"]), "op",
                         rnd.uniform(1, 900), t0 + timedelta(seconds=rnd.uniform(0, 60)), 0))
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, service string, "
                                     "name string, duration_ms double, start_time timestamp, status_code int")
    cols = ["trace_id", "duration_ms", "span_count", "has_anomaly", "start_time"]
    merged = [sorted(tuple(r) for r in TR.merge_partial_traces(TR.build_traces(df, window_s=w)).select(*cols)
                     .collect()) for w in (5, 10, 30)]
    whole = sorted(tuple(r) for r in TR.build_traces(df).select(*cols).collect())
    assert merged[0] == merged[1] == merged[2] == whole


def _spans(spark, n=400):
    from datetime import datetime, timedelta
    rnd = random.Random(8)
    t0 = datetime(2024, 1, 1)
    rows = [(rnd.choice([None, "hot", "hot", *[f"t{k}" for k in range(40)]]), rnd.choice([None, "s0", *[f"s{k}" for k in range(90)]]),
             rnd.choice([None, "", *[f"s{k}" for k in range(120)]]), rnd.choice([None, "a", "b"]), rnd.choice([None, "n", "m"]),
             rnd.choice([None, 2.5, 800.0]), rnd.choice([None, t0 + timedelta(seconds=rnd.randint(0, 90))]), rnd.choice([0, 1, 2]))
            for _ in range(n)]
    return rows, spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, service string, name string, "
                                             "duration_ms double, start_time timestamp, status_code int")


def test_traces_of_odd_spans_match_loop(spark):
    """Null keys, ids, times and services, repeated span ids, and a trace longer than its list."""
    rows, df = _spans(spark)
    got = {r["trace_id"]: r for r in TR.build_traces(df).collect()}
    assert set(got) == {r[0] for r in rows} - {None}
    low = lambda x: (x is not None, x)  # noqa: E731  nulls first
    for trace, r in got.items():
        own = [x for x in rows if x[0] == trace]
        ids = {x[1] for x in own}
        dangling = sorted((low(x[6]), low(x[1]), low(x[4])) for x in own if x[2] and x[2] not in ids)
        first = sorted((low(x[6]), low(x[1]), low(x[4])) for x in own)
        assert r["span_count"] == len(own) and len(r["spans"]) == min(20, len(own))
        assert r["dangling_span"] == (dangling[0][2][1] if dangling else None)
        assert [(s["start_time"], s["span_id"]) for s in r["spans"]] == [(a[1], b[1]) for a, b, _ in first[:20]]
        assert r["route"] == first[0][2][1]


def test_traces_are_built_in_one_pass(spark):
    """Spans dealt by the trace are shuffled once and joined with nothing; what is not read is not listed."""
    _, df = _spans(spark)
    dealt = df.repartition(8, "trace_id")
    plan = lambda t: t._jdf.queryExecution().executedPlan().toString()
    whole = plan(TR.build_traces(dealt))
    assert whole.count("Exchange") == 1 and "Join" not in whole
    assert "collect_list(CASE" not in plan(TR.build_traces(dealt).select("trace_id", "duration_ms"))


def test_bimodal_query_passes_slim_rows_to_python(spark, monkeypatch):
    from vigil.plans import catalog_traces as CT
    from vigil.plans.registry import QUERIES
    _, df = _spans(spark)
    traces = TR.build_traces(df.withColumn("trace_seq", F.xxhash64("trace_id")), carry=("trace_seq",))
    monkeypatch.setattr(CT, "v_trace", lambda s, d: traces)
    plan = QUERIES["trace_bimodal"](spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "spans" not in plan


def test_stream_deals_spans_by_trace_once(spark, monkeypatch):
    from vigil.streaming import batches as SB
    _, df = _spans(spark)
    seen = {}

    def build(spans, window_s):
        seen["spans"], seen["plan"] = spans, TR.build_traces(spans, window_s=window_s)._jdf.queryExecution().executedPlan().toString()
        raise StopIteration

    monkeypatch.setattr(SB, "TR", type("T", (), {"build_traces": staticmethod(build)}))
    try:
        SB.trace_alerts_step()(df, {})
    except StopIteration:
        pass
    assert seen["plan"].count("Exchange hashpartitioning(trace_id") == seen["plan"].count("Exchange") == 1


def test_scored_evidence_builds_traces_once(monkeypatch):
    from vigil.plans import catalog_dashboard as CD
    from vigil.plans import materialize as M
    calls = []
    any_ = lambda *a, **k: None
    monkeypatch.setattr(CD, "v_trace", lambda *a, **k: calls.append(a) or "traces")
    monkeypatch.setattr(M, "materialize", any_)
    for module, name in ((CD, "v_span"), (CD, "v_log"), (CD.TR, "rule_verdicts"), (CD.EV, "evidence_pack"), (CD.LG, "incident_logs"),
                         (CD.EN, "ensemble_scores"), (CD.EN, "soft_vote")):
        monkeypatch.setattr(module, name, any_)
    monkeypatch.setattr(CD.TR, "trace_alerts", lambda *a: type("A", (), {"select": any_})())
    monkeypatch.setattr(CD, "F", type("C", (), {"col": staticmethod(lambda c: type("D", (), {"alias": any_})())}))
    CD._pack(None, "", scored=True)
    assert len(calls) == 1
