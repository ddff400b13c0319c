"""Batch = stream: a replayed file stream gives the batch result."""
from __future__ import annotations

import json
import os
import random
import tempfile
from datetime import datetime, timedelta

from helpers import TXN_SCHEMA, loop_payment_alerts, txn_rows
from pyspark.sql import functions as F

from vigil.plans import catalog_streaming as CS
from vigil.session import tables_dir
from vigil.sources import otlp as OT
from vigil.streaming import batches as SB
from vigil.streaming import joins as SJ
from vigil.streaming import stateful as ST
from vigil.streaming.keyed import KeyedTable, keyed_table, write_keyed

T0 = datetime(2024, 1, 1)


def test_stream_payment_alerts_equal_batch(spark):
    rnd = random.Random(13)
    specs, t = [], 0.0
    for seq in range(1, 400):
        t += rnd.choice([0.5, 2, 10, 30])
        specs.append((seq, t, f"u{rnd.randint(0, 4)}", rnd.choice("AB"), rnd.choice(["SUCCESS", "FAILED"]),
                      rnd.choice([10, 20]), rnd.choice([100, 9000])))
    rows = txn_rows(specs)
    df = spark.createDataFrame(rows, TXN_SCHEMA)
    folder = tempfile.mkdtemp(prefix="vigil-stream-test-")
    start = lambda src: SB.start_fold(src, SB.payment_alerts_step(), ["rows", "fires"], folder)
    out = ST.replay(df, "seq", folder, start, chunks=3)
    got = sorted((r["reason"], r["seq"]) for r in out.collect())
    assert got == loop_payment_alerts(rows)


def test_stream_trace_state_equal_loop(spark):
    from helpers import loop_bimodal, loop_n_plus_1
    rnd = random.Random(5)
    counts = [rnd.choice([2, 3, 4, 30]) for _ in range(300)]
    durs = [rnd.choice([50.0, 120.0, 3000.0]) for _ in range(300)]
    rows = [(str(i), i, "svc", c, d) for i, (c, d) in enumerate(zip(counts, durs))]
    df = spark.createDataFrame(rows, "trace_id string, trace_seq long, primary_service string, "
                                     "span_count long, duration_ms double")
    folder = tempfile.mkdtemp(prefix="vigil-stream-test-")
    start = lambda src: SB.start_fold(src, SB.trace_detectors_step, SB.TRACE_TABLES, folder)
    out = ST.replay(df, "trace_seq", folder, start, chunks=3).collect()
    assert sorted(r["trace_seq"] for r in out if r["n_plus_1"]) == loop_n_plus_1(counts)
    assert sorted(r["trace_seq"] for r in out if r["bimodal_latency"]) == loop_bimodal(durs)


def test_late_batches_are_reported(spark):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    on_time = [("t1", t0 + timedelta(seconds=1000 + i), 10.0) for i in range(20)]
    late = [("t2", t0 + timedelta(seconds=i), 10.0) for i in range(5)]
    folder = tempfile.mkdtemp(prefix="vigil-stream-test-")
    schema = "trace_id string, start_time timestamp, duration_ms double"
    spark.createDataFrame(on_time, schema).coalesce(1).write.parquet(folder + "/in")
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    windows = ST.trace_windows_stream(src)
    q = write_keyed(windows, ["window", "trace_id"], folder + "/out", folder + "/ck")
    q.awaitTermination()
    report = ST.watermark_report(q)
    assert [b["late"] for b in report] == [False, True]          # the second batch was behind
    # Spark only promises that rows behind the watermark *may* be dropped
    assert "t1" in {r["trace_id"] for r in keyed_table(windows, ["window", "trace_id"], folder + "/out").read().collect()}


def test_keyed_table_holds_one_row_of_a_key(spark):
    rnd = random.Random(6)
    schema = spark.createDataFrame([], "k string, value long, _version long").schema
    table = KeyedTable(spark, tempfile.mkdtemp(prefix="vigil-keyed-"), ["k"], "_version", schema, buckets=4)
    want: dict = {}
    for b in range(4):
        rows = [(rnd.choice([None, *"abcdefgh"[:b + 2]]), rnd.randint(0, 99), i) for i in range(rnd.choice([0, 1, 9]))]
        batch = spark.createDataFrame(rows, schema)
        for _ in range(2):                               # a batch that runs again changes nothing
            table.merge(batch, b)
            want |= {k: v for k, v, _ in rows}
            got = [(r["k"], r["value"]) for r in table.read().collect()]
            assert len(got) == len(set(k for k, _ in got)) and dict(got) == want
    held = [f for f in os.listdir(table.folder + "/manifest") if f.isdigit()]
    assert len(held) <= 3
    versions = [os.path.join(d, x) for d, sub, _ in os.walk(table.folder) for x in sub if x.startswith("bucket=")]
    assert len(versions) <= 3 * 4                         # not one for each batch and bucket


def _verdicts(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, start_time timestamp, is_anomaly boolean")


def test_log_correlation_stream(spark):
    rnd = random.Random(4)
    at = lambda s: T0 + timedelta(seconds=s)
    logs = [(i, rnd.choice(["bad", "bad", "late", "fine", "none", "", None]), at(i), "svc") for i in range(400)]
    traces = [("bad", at(100), True), ("late", at(350), True), ("fine", at(100), False), ("odd", at(3), True)]
    folder = tempfile.mkdtemp(prefix="vigil-stream-test-")
    inputs = {"logs": (spark.createDataFrame(logs, "seq long, trace_id string, ts timestamp, service string"), "ts"),
              "verdicts": (_verdicts(spark, traces), "start_time")}
    step = SJ.first_logs_step(per_trace=40, after_s=150)
    start = lambda src: SB.start_fold(
        SJ.correlate_logs_stream(src["logs"], src["verdicts"], before_s=60, after_s=150), step, ["had"], folder)
    got = {}
    for r in ST.replay_all(inputs, folder, start, chunks=5).collect():
        got.setdefault(r["trace_id"], []).append((r["rank"], r["seq"]))
    want = {}
    for name, start_s in (("bad", 100), ("late", 350)):
        near = [i for i, t, _, _ in logs if t == name and start_s - 60 <= i <= start_s + 150][:40]
        want[name] = list(enumerate(near, 1))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_log_correlation_state_ends_by_watermark(spark):
    folder = tempfile.mkdtemp(prefix="vigil-stream-test-")
    at = lambda s: T0 + timedelta(seconds=s)
    log_schema = "seq long, trace_id string, ts timestamp"
    held = []
    for k in range(4):                                   # an hour further each time
        rows = [(100 * k + i, f"t{i}", at(3600 * k + i)) for i in range(50)]
        spark.createDataFrame(rows, log_schema).coalesce(1).write.mode("append").parquet(folder + "/logs")
        _verdicts(spark, [(f"t{k}", at(3600 * k + 1), True)]).coalesce(1).write.mode("append").parquet(folder + "/traces")
        q = SB.start_fold(SJ.correlate_logs_stream(
            spark.readStream.schema(log_schema).parquet(folder + "/logs"),
            spark.readStream.schema("trace_id string, start_time timestamp, is_anomaly boolean").parquet(folder + "/traces")),
            SJ.first_logs_step(), ["had"], folder)
        q.awaitTermination()
        held.append(q.lastProgress.stateOperators[0].numRowsTotal)
    assert max(held[1:]) <= 102                          # never more than the last hour's and this one's rows
    assert sorted(r["trace_id"] for r in spark.read.parquet(folder + "/out").collect()) == ["t0", "t1", "t2", "t3"]


def _message(trace, span, parent, service, start_s, ms):
    ns = int((datetime.timestamp(T0) + start_s) * 1e9)
    value = {"key": "service.name", "value": {"stringValue": service}}
    one = {"traceId": trace, "spanId": span, "parentSpanId": parent, "name": "op", "startTimeUnixNano": str(ns),
           "endTimeUnixNano": str(ns + int(ms * 1e6)), "status": {}}
    return json.dumps({"resourceSpans": [{"resource": {"attributes": [value]}, "scopeSpans": [{"spans": [one]}]}]})


def test_message_stream_to_alerts_and_dead_letters(spark):
    folder = tempfile.mkdtemp(prefix="vigil-stream-test-")
    parts = [[_message("t1", "a", "", "svc", 1, 5), _message("t1", "b", "gone", "svc", 2, 5), "not json", "", "[1]"],
             [_message("t2", "a", "", "svc", 200, 5), _message("t3", "a", "lost", "svc", 3, 5), "   ", "{broken"],
             [_message("t4", "a", "", "svc", 900, 5), _message("t5", "a", "gone", "svc", 5, 5), '{"resourceMetrics": []}', "7"]]
    for lines in parts:
        spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("append").text(folder + "/in")
        stream = OT.decode_messages(OT.telemetry_stream(spark, folder + "/in")).drop("payload")
        SB.start_fold(stream, SB.telemetry_step(), SB.TELEMETRY_TABLES, folder).awaitTermination()
    alerts = spark.read.parquet(folder + "/out/alerts").collect()
    assert sorted((r["kind"], r["trace_id"], r["reasons"]) for r in alerts) == [
        ("trace", "t1", "dangling_parent"), ("trace", "t3", "dangling_parent")]
    dead = spark.read.parquet(folder + "/out/dead").groupBy("reason").agg(F.sum("messages").alias("n")).collect()
    assert {r["reason"]: r["n"] for r in dead} == {"not JSON": 2, "empty": 2, "not an object": 2}
    balance = [r.asDict() for r in spark.read.parquet(folder + "/out/balance").orderBy("batch").collect()]
    assert [(r["spans_in"], r["closed"], r["late"], r["timeless"], r["open"]) for r in balance] == [
        (2, 0, 0, 0, 2), (2, 3, 0, 0, 1), (2, 1, 1, 0, 1)]


def test_folders_stay_bounded_and_restart(spark):
    rows = [(i, T0 + timedelta(seconds=i), "live" if i > 70 and i % 2 else "sim") for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, source string")
    folder = tempfile.mkdtemp(prefix="vigil-stream-test-")
    seen = []

    def start(stream):
        seen.append({f: len([x for x in os.listdir(f"{folder}/{f}") if not x.startswith(".")])
                     for f in ("landed", "state") if os.path.isdir(f"{folder}/{f}")})
        return SB.start_fold(stream, SB.real_only_step, ["latch"], folder)

    out = ST.replay(df, "seq", folder, start, chunks=8)
    assert sorted(r["seq"] for r in out.collect()) == [i for i, ts, s in rows if s == "live" or i < 71]
    assert all(n <= 2 for held in seen for n in held.values()) and len(seen) == 8
    assert not [f for f in ST.WORKING if os.path.exists(f"{folder}/{f}")]


def test_streams_on_empty_tables(spark):
    folder = tempfile.mkdtemp(prefix="vigil-stream-test-")
    df = spark.createDataFrame([], TXN_SCHEMA)
    start = lambda src: SB.start_fold(src, SB.payment_alerts_step(), ["rows", "fires"], folder)
    assert ST.replay(df, "seq", folder, start).collect() == []
    traces = spark.createDataFrame([], "trace_id string, trace_seq long, primary_service string, span_count long, duration_ms double")
    other = tempfile.mkdtemp(prefix="vigil-stream-test-")
    start = lambda src: SB.start_fold(src, SB.trace_detectors_step, SB.TRACE_TABLES, other)
    assert ST.replay(traces, "trace_seq", other, start).collect() == []


def test_keyed_table_computes_a_batch_once(spark):
    """A stream's batch runs its stateful plan whenever it is read; null keys and repeats keep one row."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = spark.createDataFrame([], "k string, v long, _version long").schema
    table = KeyedTable(spark, tempfile.mkdtemp(prefix="vigil-keyed-"), ["k"], "_version", schema, buckets=4)
    for b, rows in enumerate([[("a", 1, 0), ("b", 2, 0), (None, 3, 0)], [("a", 9, 1), ("a", 8, 0), (None, 7, 1), ("c", 4, 1)]]):
        seen.value = 0
        table.merge(spark.createDataFrame(rows, schema).mapInArrow(counted, schema), b)
        assert seen.value == len(rows)
    assert sorted((r["k"] or "", r["v"]) for r in table.read().collect()) == [("", 7), ("a", 9), ("b", 2), ("c", 4)]


def test_a_micro_batch_flattens_spans_and_builds_traces_once(spark, monkeypatch):
    """Neither the passes over the spans nor the sampling of the ranked order compute them again."""
    seen = {n: spark.sparkContext.accumulator(0) for n in ("spans", "traces")}

    def counted(name, real):
        def run(*args, **kw):
            df = real(*args, **kw)

            def count(batches):
                for b in batches:
                    seen[name].add(b.num_rows)
                    yield b
            return df.mapInArrow(count, df.schema)
        return run

    monkeypatch.setattr(SB.OT, "flatten_spans", counted("spans", SB.OT.flatten_spans))
    monkeypatch.setattr(SB.TR, "build_traces", counted("traces", SB.TR.build_traces))
    span = ('{"traceId":"t%d","spanId":"s","parentSpanId":"gone","name":"n","startTimeUnixNano":"%d","endTimeUnixNano":"%d"}')
    ns = [(1_700_000_000 + 7 * i) * 1_000_000_000 for i in range(40)]
    lines = ['{"resourceSpans":[{"scopeSpans":[{"spans":[%s]}]}]}' % (span % (i, t, t + 5_000_000)) for i, t in enumerate(ns)]
    batch = OT.decode_messages(spark.createDataFrame([(x,) for x in lines], "payload string")
                               .withColumn("ingest_ts", F.current_timestamp())).drop("payload")
    out, carry = SB.telemetry_step()(batch, {})
    alerts, balance = out["alerts"].collect(), out["balance"].first()
    for t in carry.values():
        t.collect()
    assert seen["spans"].value == 40 and balance["closed"] + balance["open"] == 40
    assert seen["traces"].value == balance["closed"] == len(alerts) > 20


def _span_lines(n):
    span = '{"traceId":"t%d","spanId":"s","parentSpanId":"gone","name":"n","startTimeUnixNano":"%d","endTimeUnixNano":"%d"}'
    ns = [(1_700_000_000 + 20 * i) * 1_000_000_000 for i in range(n)]
    return ['{"resourceSpans":[{"scopeSpans":[{"spans":[%s]}]}]}' % (span % (i, t, t + 5_000_000)) for i, t in enumerate(ns)]


def test_a_micro_batch_leaves_results_and_state_only(spark):
    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    tables = tables_dir(spark)
    folder = tempfile.mkdtemp(prefix="vigil-stream-test-")
    spark.createDataFrame([(x,) for x in _span_lines(40)], "line string").write.text(folder + "/in")
    held, had = set(os.listdir(tables)) if os.path.isdir(tables) else set(), shuffled()
    stream = OT.decode_messages(OT.telemetry_stream(spark, folder + "/in")).drop("payload")
    SB.start_fold(stream, SB.telemetry_step(), SB.TELEMETRY_TABLES, folder).awaitTermination()
    assert not shuffled() - had
    assert set(os.listdir(tables)) <= held
    assert spark.read.parquet(folder + "/out/alerts").count() == 36    # the last 60 s wait
    assert not os.listdir(folder + "/landed") and os.listdir(folder + "/state") == ["0"]


def test_landed_lines_are_compressed_and_go_with_their_delivery(spark, monkeypatch):
    lines = [(x, T0 + timedelta(seconds=i)) for i, x in enumerate(_span_lines(40))] + [("no JSON", T0)]
    monkeypatch.setattr(CS, "v_otlp_lines", lambda s, d: spark.createDataFrame(lines, "line string, at timestamp"))
    seen, real = [], SB.start_fold

    def start(stream, step, tables, folder):
        seen.append({x for x in os.listdir(folder + "/in") if x.startswith("part-")})
        return real(stream, step, tables, folder)

    monkeypatch.setattr(SB, "start_fold", start)
    alerts = CS._telemetry(spark, None, "alerts")
    assert sorted(int(r["trace_id"][1:]) for r in alerts.collect()) == list(range(36))
    assert len(seen) == 4 and all(x.endswith(".txt.gz") for names in seen for x in names)
    assert sum(map(len, seen)) == len(set().union(*seen))              # a delivery finds no lines of those before
