"""Registered ingest queries (OTLP sources) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import otlp as OT
from .materialize import materialize
from .oracle import with_views
from .registry import register
from .vehicles_ingest import INGEST_TS, v_otlp

register("otlp_spans", lambda s, d: OT.flatten_spans(OT.parse_messages(v_otlp(s, d))),
         with_views(["v_span"], """
SELECT trace_id, span_id,
       CASE WHEN parent_span_id = '' AND rn % 2 = 0 THEN NULL ELSE parent_span_id END AS parent_span_id,
       service AS service_name, name AS span_name,
       CASE WHEN rn % 3 = 0 THEN '/r/' || name ELSE name END AS route,
       CAST(round(duration_ms * 1e6) AS BIGINT) / 1e6 AS duration_ms,
       start_time, status_code
FROM v_span"""))

register("otlp_logs", lambda s, d: OT.flatten_logs(OT.parse_messages(v_otlp(s, d))), with_views(["v_log"], f"""
SELECT CASE WHEN seq % 11 = 0 THEN '' ELSE trace_id END AS trace_id, span_id, service_name, body,
       CASE WHEN seq % 7 = 0 THEN 'INFO' ELSE severity END AS severity,
       CASE WHEN seq % 50 = 0 THEN TIMESTAMP '{INGEST_TS}' ELSE ts END AS timestamp
FROM v_log"""))


def _routing(s, d):
    raw = v_otlp(s, d)
    msgs = materialize(OT.parse_messages(raw).select("msg", "ingest_ts"), "otlp_messages")  # decoded once for all kinds
    spans, logs = OT.flatten_spans(msgs), OT.flatten_logs(msgs)
    parts = [raw.select(F.lit("messages").alias("kind")), msgs.select(F.lit("valid").alias("kind")),
             spans.select(F.lit("span_rows").alias("kind")), logs.select(F.lit("log_rows").alias("kind")),
             msgs.filter(F.col("msg.resourceMetrics").isNotNull()).select(F.lit("metric_messages").alias("kind"))]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


register("otlp_signal_routing", _routing, with_views(["v_span", "v_log"], """
SELECT * FROM (VALUES
  ('messages', (SELECT count(*) FROM (SELECT DISTINCT trace_id, service FROM v_span))
               + (SELECT count(*) FROM v_log) + (SELECT count(*) FROM events)
               + (SELECT count(*) FROM documents)),
  ('valid', (SELECT count(*) FROM (SELECT DISTINCT trace_id, service FROM v_span))
            + (SELECT count(*) FROM v_log) + (SELECT count(*) FROM events)),
  ('span_rows', (SELECT count(*) FROM v_span)),
  ('log_rows', (SELECT count(*) FROM v_log)),
  ('metric_messages', (SELECT count(*) FROM events))
) AS t(kind, n)"""))

# ---- webhooks -------------------------------------------------------------------------

from ..operators import payments_kpi as K  # noqa: E402
from ..sources import webhooks as WH  # noqa: E402
from .vehicles_ingest import HOOK_INGEST_KEY, HOOK_SECRETS, v_hook  # noqa: E402


def _norm(s, d):
    return WH.normalize_webhooks(v_hook(s, d), HOOK_SECRETS, HOOK_INGEST_KEY)


_HOOK = """
h AS (SELECT *, seq % 8 AS e, seq % 13 = 0 AS bad, seq % 9 = 0 AS unknown FROM v_txn),
hn AS (
  SELECT seq,
    ['razorpay', 'stripe', 'phonepe', 'cashfree', 'payu', 'gateway/ccavenue', 'gateway/juspay', 'ingest'][e + 1] AS endpoint,
    CASE WHEN e = 6 THEN 'no_secret' WHEN bad THEN 'bad_signature'
         WHEN e IN (0, 1) AND unknown THEN 'ignored' ELSE 'ok' END AS outcome,
    CASE WHEN e = 0 AND txn_type = 'REFUND' THEN 'rf' || txn_id ELSE txn_id END AS txn_id,
    order_id,
    CASE WHEN e = 0 THEN (CASE WHEN txn_type = 'REFUND' THEN 'REFUND' ELSE 'PURCHASE' END)
         WHEN e = 1 THEN (CASE WHEN txn_type = 'REFUND' AND status = 'SUCCESS' THEN 'REFUND' ELSE 'PURCHASE' END)
         WHEN e IN (2, 3, 4) THEN 'PURCHASE' ELSE txn_type END AS txn_type,
    CASE WHEN e = 0 THEN (CASE WHEN method = 'DEBIT_CARD' THEN 'CREDIT_CARD' ELSE method END)
         WHEN e = 1 THEN (CASE WHEN method IN ('UPI', 'NET_BANKING', 'WALLET') THEN method ELSE 'CREDIT_CARD' END)
         WHEN e = 2 THEN 'UPI'
         WHEN e = 3 THEN (CASE WHEN method IN ('UPI', 'CREDIT_CARD', 'NET_BANKING', 'WALLET') THEN method ELSE 'UPI' END)
         WHEN e = 4 THEN (CASE WHEN method IN ('UPI', 'CREDIT_CARD', 'DEBIT_CARD', 'NET_BANKING', 'WALLET') THEN method
                               ELSE 'CREDIT_CARD' END)
         ELSE method END AS method,
    CASE WHEN e = 0 THEN (CASE WHEN method = 'UPI' THEN 'okaxis' ELSE 'Razorpay' END)
         WHEN e = 1 THEN 'Stripe' WHEN e = 2 THEN 'PhonePe' WHEN e = 3 THEN 'Cashfree' WHEN e = 4 THEN 'PayU'
         ELSE provider END AS provider,
    CASE WHEN e = 0 THEN 'Razorpay' WHEN e = 1 THEN 'Stripe' WHEN e = 2 THEN 'PhonePe' WHEN e = 3 THEN 'Cashfree'
         WHEN e = 4 THEN 'PayU' WHEN e = 5 AND seq % 2 = 0 THEN 'Ccavenue' ELSE gateway END AS gateway,
    amount,
    CASE WHEN e IN (2, 4) THEN 'INR' ELSE currency END AS currency,
    CASE WHEN e = 0 AND txn_type = 'REFUND' THEN (CASE WHEN status = 'FAILED' THEN 'FAILED' ELSE 'SUCCESS' END)
         WHEN e = 1 AND txn_type = 'REFUND' AND status = 'SUCCESS' THEN 'SUCCESS'
         ELSE status END AS status,
    CASE WHEN e = 0 THEN round(greatest(0.0, floor(latency_ms / 1000) * 1000.0), 1)
         WHEN e IN (1, 2, 3, 4) THEN 0.0 ELSE latency_ms END AS latency_ms,
    CASE WHEN e = 2 THEN (CASE WHEN status = 'SUCCESS' THEN NULL ELSE status END)
         WHEN e IN (3, 4) THEN (CASE WHEN status = 'FAILED' THEN failure_reason END)
         ELSE failure_reason END AS failure_reason,
    CASE WHEN e IN (0, 1, 4) THEN substring("user", 1, 5) || '***'
         WHEN e = 2 THEN '98765***' WHEN e = 3 THEN 'customer***' ELSE "user" END AS "user",
    ts
  FROM h)"""

register("webhook_normalised", _norm, with_views(["v_txn"], """
SELECT seq, endpoint, outcome,
       CASE WHEN outcome = 'ok' THEN txn_id END AS txn_id, CASE WHEN outcome = 'ok' THEN order_id END AS order_id,
       CASE WHEN outcome = 'ok' THEN txn_type END AS txn_type, CASE WHEN outcome = 'ok' THEN method END AS method,
       CASE WHEN outcome = 'ok' THEN provider END AS provider, CASE WHEN outcome = 'ok' THEN gateway END AS gateway,
       CASE WHEN outcome = 'ok' THEN amount END AS amount, CASE WHEN outcome = 'ok' THEN currency END AS currency,
       CASE WHEN outcome = 'ok' THEN status END AS status, CASE WHEN outcome = 'ok' THEN latency_ms END AS latency_ms,
       CASE WHEN outcome = 'ok' THEN failure_reason END AS failure_reason,
       CASE WHEN outcome = 'ok' THEN "user" END AS "user",
       CASE WHEN outcome = 'ok' THEN ts END AS ts, CASE WHEN outcome = 'ok' THEN 'live' END AS source
FROM hn""", _HOOK))

register("webhook_outcomes", lambda s, d: _norm(s, d).groupBy("endpoint", "outcome").agg(
    F.count(F.lit(1)).alias("n")), with_views(["v_txn"], """
SELECT endpoint, outcome, count(*) AS n FROM hn GROUP BY ALL""", _HOOK))

register("webhook_quarantine", lambda s, d: _norm(s, d).filter(F.col("outcome") == "bad_signature").select(
    "seq", "endpoint"), with_views(["v_txn"], """
SELECT seq, endpoint FROM hn WHERE outcome = 'bad_signature'""", _HOOK))

register("webhook_live_kpis", lambda s, d: K.txn_totals(_norm(s, d).filter(F.col("outcome") == "ok")), with_views(["v_txn"], """
SELECT count(*) AS total,
       CAST(coalesce(sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END), 0) AS BIGINT) AS success,
       CAST(coalesce(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END), 0) AS BIGINT) AS failed,
       CAST(coalesce(sum(CASE WHEN status = 'PENDING' THEN 1 ELSE 0 END), 0) AS BIGINT) AS pending,
       round(coalesce(sum(CASE WHEN status = 'SUCCESS' AND currency = 'INR' THEN amount ELSE 0.0 END), 0.0), 2) AS volume_inr,
       round(CASE WHEN count(*) > 0 THEN sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) * 100.0 / count(*)
                  ELSE 0.0 END, 2) AS success_rate
FROM hn WHERE outcome = 'ok'""", _HOOK))

# ---- live lifecycle: webhook → verify → normalise → rolling detectors → alerts ----------

from ..operators import payments_detect as PD  # noqa: E402
from .catalog_payments import _CAND_SQL  # noqa: E402


def _webhook_alerts(s, d):
    # the ingest step stores accepted payments (the transactions table) once
    live = materialize(_norm(s, d).filter(F.col("outcome") == "ok"), "live_transactions")
    return PD.payment_alerts(live)


_LIVE = _HOOK + """,
v_live AS (SELECT seq, txn_id, order_id, txn_type, method, provider, gateway, amount, currency, status,
                  latency_ms, failure_reason, "user", ts, 'live' AS source FROM hn WHERE outcome = 'ok'),
""" + _CAND_SQL.replace("FROM v_txn", "FROM v_live")

register("webhook_alerts", _webhook_alerts, with_views(["v_txn"], "SELECT * FROM alerts", _LIVE))
