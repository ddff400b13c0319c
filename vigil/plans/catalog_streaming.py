"""Registered streaming queries.

Each one lands its input (a view over the driver tables) as ordered deliveries, runs
the Structured Streaming query with ``availableNow`` after each of them, restarted from
its checkpoint, into a table in the checkpoint folder and returns that table, so the
oracle of the batch twin checks stream = batch.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.common import EPOCH_2024_US
from ..operators import payments_detect as PD
from ..operators import traces as TR
from ..session import checkpoint_dir
from ..sources import otlp as OT
from ..sources import webhooks as WH
from ..streaming import batches as SB
from ..streaming import joins as SJ
from ..streaming import stateful as ST
from . import catalog_ingest  # noqa: F401  (its webhook SQL is read below)
from .catalog_logs import _PII, PII_QUERY_THRESHOLD
from .catalog_payments import _CAND_SQL
from .catalog_traces import _ATYPE, _W1
from .oracle import with_views
from .registry import ORACLES, register
from .vehicles import v_log, v_span, v_trace, v_txn
from .vehicles_ingest import HOOK_INGEST_KEY, HOOK_SECRETS, v_hook, v_live_span, v_otlp_lines


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/vigil-streams/{name}-{uuid.uuid4().hex}"


def _stream_pay(s, d):
    f = _folder(s, "pay")
    start = lambda src: SB.start_fold(src, SB.payment_alerts_step(), ["rows", "fires"], f)
    return ST.replay(v_txn(s, d), "seq", f, start).select(*PD.ALERT_COLS)


register("stream_pay_alerts", _stream_pay, with_views(["v_txn"], "SELECT * FROM alerts", _CAND_SQL))


def _stream_redactions(s, d):
    f = _folder(s, "redactions")
    start = lambda src: SB.start_fold(src, SB.redaction_counter_step, ["totals"], f)
    return ST.replay(v_log(s, d), "seq", f, start).select("service", "seq", "value")


def _stream_pii(s, d):
    f = _folder(s, "pii")
    step = SB.pii_alerts_step(PII_QUERY_THRESHOLD)
    start = lambda src: SB.start_fold(src, step, ["rows", "fires"], f)
    return ST.replay(v_log(s, d), "seq", f, start).select("service", "seq", "ratio", "window_log_count", "redacted_count")


register("stream_redaction_counter", _stream_redactions, with_views(["v_log"], """
SELECT service, seq, CAST(running AS DOUBLE) AS value FROM (
  SELECT service_name AS service, seq, f,
         sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY service_name ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM (SELECT *, (contains(body, '[REDACTED_EMAIL]') OR contains(body, '[REDACTED_AUTHOR]')
                   OR contains(body, '[REDACTED_CC]')) AS f FROM v_log)) WHERE f"""))

register("stream_pii_alerts", _stream_pii, with_views(["v_log"], """
SELECT service_name AS service, seq, round(redaction_ratio, 6) AS ratio, window_log_count,
       CAST(redacted_count AS BIGINT) AS redacted_count
FROM pc JOIN pfired USING (service_name, seq)""", _PII))


def _stream_traces(s, d):
    f = _folder(s, "traces")
    traces = v_trace(s, d).select("trace_id", "trace_seq", "primary_service", "span_count", "duration_ms")
    start = lambda src: SB.start_fold(src, SB.trace_detectors_step, SB.TRACE_TABLES, f)
    return ST.replay(traces, "trace_seq", f, start)


register("stream_trace_detectors", lambda s, d: _stream_traces(s, d).filter(
    F.col("n_plus_1") | F.col("bimodal_latency")).select(
    "trace_id", "primary_service", "n_plus_1", "bimodal_latency",
    F.when(F.col("bimodal_latency"), F.col("latency_variance")).alias("latency_variance")),
    with_views(["v_trace"], """
SELECT trace_id, primary_service, n_plus_1, bimodal_latency,
       CASE WHEN bimodal_latency THEN latency_variance END AS latency_variance
FROM verd WHERE n_plus_1 OR bimodal_latency""", _W1))


def _stream_trace_alerts(s, d):
    f = _folder(s, "trace-alerts")
    start = lambda src: SB.start_fold(src, SB.trace_alerts_step(), SB.ALERT_TABLES, f)
    return ST.replay(v_live_span(s, d).drop("trace_seq", "rn"), "start_time", f, start, result=lambda: s.read.parquet(f"{f}/out/alerts")).select(
        "window_start", "trace_id", "service", "route", "anomaly_type", F.concat_ws(",", "reasons").alias("reasons"),
        F.size("spans").alias("n_spans"), F.col("rule_flags.dangling_span").alias("dangling_span"))


_LIVE_TRACES = f"""
lv AS (SELECT *, time_bucket(INTERVAL 10 SECOND, start_time) AS w FROM (
         SELECT * REPLACE (make_timestamp({EPOCH_2024_US} + trace_seq * 200000 + rn * 10000) AS start_time) FROM v_span)),
cl AS (SELECT * FROM lv WHERE w + INTERVAL 10 SECOND <= (SELECT max(start_time) FROM lv) - INTERVAL 60 SECOND),
ps AS (SELECT w, trace_id, service AS primary_service FROM (
         SELECT w, trace_id, service, row_number() OVER (PARTITION BY w, trace_id
                  ORDER BY sum(duration_ms) DESC, min(start_time)) AS k
         FROM cl GROUP BY w, trace_id, service) WHERE k = 1),
dg AS (SELECT c.w, c.trace_id, arg_min(c.name, c.start_time) AS dangling_span FROM cl c
       WHERE coalesce(c.parent_span_id, '') <> '' AND NOT EXISTS (
         SELECT 1 FROM cl p WHERE p.w = c.w AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id)
       GROUP BY c.w, c.trace_id),
v_trace AS (
  SELECT row_number() OVER (ORDER BY w, trace_id) - 1 AS trace_seq, w, trace_id, max(duration_ms) AS duration_ms,
         count(*) AS span_count, arg_min(name, start_time) AS route, any_value(primary_service) AS primary_service,
         any_value(dangling_span) AS dangling_span
  FROM cl JOIN ps USING (w, trace_id) LEFT JOIN dg USING (w, trace_id) GROUP BY w, trace_id),"""

register("stream_trace_alerts", _stream_trace_alerts, with_views(["v_span"], f"""
SELECT w AS window_start, trace_id, primary_service AS service, route, {_ATYPE} AS anomaly_type,
       array_to_string(reasons, ',') AS reasons, CAST(least(span_count, 20) AS INTEGER) AS n_spans, dangling_span
FROM rv WHERE len(reasons) > 0""", _LIVE_TRACES + _W1))


def _stream_late(s, d):
    f = _folder(s, "late")
    t = v_txn(s, d).select("seq", "txn_id", "ts")        # one payment in 50 comes ten minutes late
    t = t.withColumn("ts", F.when(F.col("seq") % 50 == 0, F.col("ts") - F.expr("INTERVAL 10 MINUTES")).otherwise(F.col("ts")))
    start = lambda src: SB.start_fold(src, SB.late_rows_step(120), ["clock"], f)
    return ST.replay(t, "seq", f, start).drop("batch")


register("stream_late_rows", _stream_late, with_views(["v_txn"], """
SELECT seq, txn_id, ts FROM c JOIN m USING (chunk) WHERE ts < newest - INTERVAL 120 SECOND""", """
c AS (SELECT seq, txn_id, ts - CASE WHEN seq % 50 = 0 THEN INTERVAL 10 MINUTE ELSE INTERVAL 0 MINUTE END AS ts,
             least(3, floor((seq - lo) / ((CAST(hi AS DOUBLE) - lo + 1.0) / 4))) AS chunk
      FROM v_txn, (SELECT min(seq) AS lo, max(seq) AS hi FROM v_txn)),
m AS (SELECT chunk, max(max(ts)) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
      FROM c GROUP BY chunk)"""))


def _stream_webhooks(s, d):
    f = _folder(s, "webhooks")
    v_hook(s, d).write.json(f"{f}/in")                   # deliveries land as JSON lines
    hooks = WH.read_webhooks(s, f"{f}/in", streaming=True)
    ST.write_append(WH.normalize_webhooks(hooks, HOOK_SECRETS, HOOK_INGEST_KEY), f"{f}/out",
                    f"{f}/_checkpoint").awaitTermination()
    return s.read.parquet(f"{f}/out")


register("stream_webhooks", _stream_webhooks, ORACLES["webhook_normalised"])


def _stream_windows(s, d):
    t = ST.replay_keyed(v_span(s, d).select("trace_id", "start_time", "duration_ms"), "start_time", _folder(s, "windows"),
                        ST.trace_windows_stream, ["window_start", "trace_id"],
                        derive=lambda w: w.withColumn("window_start", F.col("window.start")).drop("window"))
    return t.select("window_start", "trace_id", "span_count", "duration_ms", (F.col("_slow") > 0).alias("has_anomaly"),
                    "start_time")


register("stream_trace_windows", _stream_windows, with_views(["v_span"], """
SELECT time_bucket(INTERVAL 10 SECOND, start_time) AS window_start, trace_id, count(*) AS span_count,
       max(duration_ms) AS duration_ms, bool_or(duration_ms > 500) AS has_anomaly, min(start_time) AS start_time
FROM v_span GROUP BY ALL"""))


def _stream_totals(s, d):
    t = ST.replay_keyed(v_txn(s, d), "seq", _folder(s, "totals"), ST.txn_totals_stream, ["_one"],
                        derive=lambda w: w.withColumn("_one", F.lit(1)))
    return t.select("total", "success", "failed", "pending", F.round("volume", 2).alias("volume_inr"))


register("stream_txn_totals", _stream_totals, with_views(["v_txn"], """
SELECT count(*) AS total, CAST(sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS success,
       CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
       CAST(sum(CASE WHEN status = 'PENDING' THEN 1 ELSE 0 END) AS BIGINT) AS pending,
       round(sum(CASE WHEN status = 'SUCCESS' AND currency = 'INR' THEN amount ELSE 0.0 END), 2) AS volume_inr
FROM v_txn"""))


def _stream_tp(s, d):
    t = ST.replay_keyed(v_txn(s, d).select("seq", "ts"), "seq", _folder(s, "throughput"), ST.payment_throughput_stream,
                        ["window_start"], derive=lambda w: w.withColumn("window_start", F.col("window.start")).drop("window"))
    return t.select("window_start", "payments")


register("stream_payment_throughput", _stream_tp, with_views(["v_txn"], """
SELECT window_start, count(*) AS payments FROM (
  SELECT time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL (k * 10) SECOND AS window_start
  FROM v_txn, range(0, 6) AS r(k)) GROUP BY window_start"""))


def _stream_p99(s, d):
    f = _folder(s, "p99")
    start = lambda src: SB.start_fold(src, SB.rolling_p99_step, ["tail"], f)
    return ST.replay(v_txn(s, d).select("seq", "ts", "gateway", "latency_ms"), "seq", f, start).drop("batch")


register("stream_rolling_p99", _stream_p99, with_views(["v_txn"], """
SELECT gateway, seq, ts,
       round(list_sort(l)[least(len(l) - 1, CAST(floor(0.99 * (len(l) - 1)) AS INTEGER)) + 1], 2) AS p99_latency
FROM (SELECT gateway, seq, ts, list(latency_ms) OVER (PARTITION BY gateway ORDER BY seq
        ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) AS l FROM v_txn)"""))


# ---- the message stream (S1 + S3): text lines → decoded messages → spans and logs → alerts --------

def _telemetry(s, d, table):
    """The table ``table`` of the telemetry stream over all lines, landed as text in time order.

    Lines land compressed, and those of a delivery are removed when its batch is committed: in JSON
    the spans are some twenty times as large as in the tables.
    """
    f = _folder(s, "telemetry")
    lines = ST.deliveries(v_otlp_lines(s, d), "at", f"{f}/all", 4)
    for i, part in enumerate(lines):
        part.select("line").write.mode("append").option("compression", "gzip").text(f"{f}/in")
        stream = OT.decode_messages(OT.telemetry_stream(s, f"{f}/in")).drop("payload")
        SB.start_fold(stream, SB.telemetry_step(PII_QUERY_THRESHOLD), SB.TELEMETRY_TABLES, f).awaitTermination()
        SB.remove(s, f"{f}/in")
    SB.remove(s, *[f"{f}/{w}" for w in ST.WORKING])
    return s.read.parquet(f"{f}/out/{table}")


#: Spans as they come out of OTLP messages: durations are whole nanoseconds.
_OTLP_TRACES = _LIVE_TRACES.replace(
    "SELECT * REPLACE (", "SELECT * REPLACE (floor(duration_ms * 1000000 + 0.5) / 1000000 AS duration_ms, ")

_OTLP_LOGS = f"""
v_log AS (SELECT * REPLACE (CASE WHEN seq % 11 = 0 THEN '' ELSE trace_id END AS trace_id) FROM raw_log),"""

register("stream_otlp_alerts", lambda s, d: _telemetry(s, d, "alerts").drop("batch"),
         with_views(["v_span", "v_log"], f"""
SELECT 'trace' AS kind, primary_service AS service, trace_id, w AS at, {_ATYPE} AS anomaly_type,
       array_to_string(reasons, ',') AS reasons, CAST(NULL AS DOUBLE) AS ratio
FROM rv WHERE len(reasons) > 0
UNION ALL
SELECT 'log', service_name, trace_id, ts, 'PII Redaction Density', 'pii_redaction_density', round(redaction_ratio, 6)
FROM pc JOIN pfired USING (service_name, seq)""", _OTLP_LOGS + _OTLP_TRACES + _W1 + "," + _PII)
         .replace("v_log AS (", "raw_log AS (", 1))

register("stream_otlp_dead_letters",
         lambda s, d: _telemetry(s, d, "dead").groupBy("reason").agg(F.sum("messages").alias("messages")), """
SELECT CASE WHEN line = '' THEN 'empty' WHEN NOT json_valid(line) THEN 'not JSON' ELSE 'not an object' END AS reason,
       CAST(count(*) AS BIGINT) AS messages
FROM (SELECT trim(CASE doc_id % 3 WHEN 0 THEN replace(replace(text, chr(10), ' '), chr(13), ' ')
                       WHEN 1 THEN '' ELSE '[' || doc_id || ']' END) AS line FROM documents)
GROUP BY 1""")


def _stream_balance(s, d):
    """Spans of which one in 50 comes ten minutes late and one in 70 names no start."""
    f = _folder(s, "balance")
    k = F.col("trace_seq") * 7 + F.col("rn")
    t = v_live_span(s, d).withColumn("arrived", F.col("start_time")).withColumn(
        "start_time", F.when(k % 70 == 0, F.lit(None).cast("timestamp"))
        .when(k % 50 == 0, F.col("start_time") - F.expr("INTERVAL 10 MINUTES")).otherwise(F.col("start_time")))
    start = lambda src: SB.start_fold(src.drop("arrived"), SB.trace_alerts_step(), SB.ALERT_TABLES, f)
    out = ST.replay(t.drop("trace_seq", "rn"), "arrived", f, start, result=lambda: s.read.parquet(f"{f}/out/balance"))
    return out.agg(*[F.sum(c).alias(c) for c in ("spans_in", "closed", "late", "timeless")],
                   F.max_by("open", "batch").alias("open"))


register("stream_span_balance", _stream_balance, with_views(["v_span"], """
SELECT count(*) AS spans_in,
       count(*) FILTER (t IS NOT NULL AND NOT late AND e <= (SELECT max(t) FROM a) - INTERVAL 60 SECOND) AS closed,
       count(*) FILTER (t IS NOT NULL AND late) AS late, count(*) FILTER (t IS NULL) AS timeless,
       count(*) FILTER (t IS NOT NULL AND NOT late AND e > (SELECT max(t) FROM a) - INTERVAL 60 SECOND) AS open
FROM (SELECT a.*, coalesce(e <= newest - INTERVAL 60 SECOND, false) AS late FROM a JOIN m USING (chunk))""", f"""
b AS (SELECT make_timestamp({EPOCH_2024_US} + trace_seq * 200000 + rn * 10000) AS arrived, trace_seq * 7 + rn AS k FROM v_span),
t AS (SELECT *, CASE WHEN k % 70 = 0 THEN NULL WHEN k % 50 = 0 THEN arrived - INTERVAL 10 MINUTE ELSE arrived END AS t FROM b),
a AS (SELECT t, time_bucket(INTERVAL 10 SECOND, t) + INTERVAL 10 SECOND AS e,
             least(3, floor((epoch_us(arrived) - lo) / ((CAST(hi AS DOUBLE) - lo + 1.0) / 4))) AS chunk
      FROM t, (SELECT min(epoch_us(arrived)) AS lo, max(epoch_us(arrived)) AS hi FROM t)),
m AS (SELECT chunk, max(max(t)) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
      FROM a GROUP BY chunk)"""))


# ---- J1 as a stream-stream join ------------------------------------------------------------------

LOG_TRACES = 16
JOIN_S = 600


def _live_logs(s, d):
    """Logs of ``LOG_TRACES`` traces; some of these have no anomaly or no verdict at all."""
    return v_log(s, d).select("seq", (F.col("seq") % LOG_TRACES + 1).cast("string").alias("trace_id"), "service_name",
                              "severity", "ts")


def _verdict_rows(s, d):
    """Verdicts of all traces, over the first 100 s of the logs' clock."""
    at = F.timestamp_micros(F.lit(EPOCH_2024_US) + F.col("trace_seq") * 7919 % 1000 * 100_000)
    return TR.rule_verdicts(v_trace(s, d)).select("trace_id", at.alias("start_time"), "is_anomaly")


def _stream_logs(s, d):
    f = _folder(s, "log-correlation")
    step = SJ.first_logs_step(after_s=JOIN_S)
    inputs = {"logs": (_live_logs(s, d), "ts"), "verdicts": (_verdict_rows(s, d), "start_time")}
    start = lambda src: SB.start_fold(
        SJ.correlate_logs_stream(src["logs"], src["verdicts"], JOIN_S, JOIN_S), step, ["had"], f)
    return ST.replay_all(inputs, f, start).select("trace_id", "seq", "rank", "service_name", "severity")


register("stream_log_correlation", _stream_logs, with_views(["v_log", "v_trace"], f"""
SELECT trace_id, seq, CAST(rank AS INTEGER) AS rank, service_name, severity FROM (
  SELECT t.trace_id, l.seq, l.service_name, l.severity,
         row_number() OVER (PARTITION BY t.trace_id ORDER BY l.ts, l.seq) AS rank
  FROM v_log l JOIN rv t ON t.trace_id = CAST(l.seq % {LOG_TRACES} + 1 AS VARCHAR) AND len(reasons) > 0
       AND l.ts BETWEEN make_timestamp({EPOCH_2024_US} + trace_seq * 7919 % 1000 * 100000) - INTERVAL {JOIN_S} SECOND
                    AND make_timestamp({EPOCH_2024_US} + trace_seq * 7919 % 1000 * 100000) + INTERVAL {JOIN_S} SECOND)
WHERE rank <= 50""", _W1))


# ---- N14 as a stream -------------------------------------------------------------------------------

def _stream_real_only(s, d):
    """Live payments begin a third of the way in."""
    f = _folder(s, "real-only")
    t = v_txn(s, d).withColumn("source", F.when((F.col("source") == "live") & (F.col("seq") * 3 > _last_seq(s, d)), "live").otherwise("sim"))
    start = lambda src: SB.start_fold(src, SB.real_only_step, ["latch"], f)
    return ST.replay(t, "ts", f, start).select("seq", "txn_id", "source", "ts")


def _last_seq(s, d):
    return v_txn(s, d).agg(F.max("seq")).scalar()


register("stream_real_only", _stream_real_only, with_views(["v_txn"], """
SELECT seq, txn_id, source, ts FROM t
WHERE source = 'live' OR coalesce(ts < (SELECT min(ts) FROM t WHERE source = 'live'), true)""", """
t AS (SELECT seq, txn_id, ts, CASE WHEN source = 'live' AND seq * 3 > (SELECT max(seq) FROM v_txn) THEN 'live' ELSE 'sim' END AS source
      FROM v_txn)"""))
