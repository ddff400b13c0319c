"""Registered alert / dashboard / evidence queries (Spark) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import DETECTOR_TEXTS, FIXES, ROOT_CAUSES
from ..models import ensemble as EN
from ..operators import cluster as CL
from ..operators import dashboard as DB
from ..operators import evidence as EV
from ..operators import logs as LG
from ..operators import payments_detect as PD
from ..operators import payments_kpi as K
from ..operators import traces as TR
from .catalog_logs import _PII, PII_QUERY_THRESHOLD
from .catalog_models import _ARRIVED_COLD, _MOMENTS
from .catalog_payments import _CAND_SQL, _REG_SQL
from .catalog_traces import _ATYPE, _W1
from .oracle import with_views
from .registry import register
from .vehicles import v_log, v_pod, v_span, v_trace, v_txn

_ALERTS = _CAND_SQL + """,
al AS (SELECT *, reason || ':' || seq AS alert_id FROM alerts)"""


def _rec(views, body, extra=_ALERTS):
    return with_views(views, body, extra).replace("WITH ", "WITH RECURSIVE ", 1)


def _al(s, d):
    return DB.with_alert_id(PD.payment_alerts(v_txn(s, d)))


register("alert_severity", lambda s, d: _al(s, d).select(
    "alert_id", "anomaly_score", DB.severity(F.col("anomaly_score")).alias("severity"),
    DB.model_band(F.col("anomaly_score") * 100).alias("model_band")),
    _rec(["v_txn"], """
SELECT alert_id, anomaly_score,
       CASE WHEN anomaly_score >= 0.8 THEN 'Critical' WHEN anomaly_score >= 0.5 THEN 'Warning' ELSE 'Low Risk' END AS severity,
       CASE WHEN anomaly_score * 100 > 70 THEN 'high' WHEN anomaly_score * 100 > 40 THEN 'mid' ELSE 'low' END AS model_band
FROM al"""))

register("alert_rule_pills", lambda s, d: DB.rule_pills(_al(s, d)), _rec(["v_txn"], """
SELECT alert_id, label, detail FROM (
  SELECT alert_id, 'Failure Spike' AS label,
         CASE WHEN failure_rate > 0 THEN CAST(CAST(floor(failure_rate * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS detail
  FROM al WHERE reason = 'payment_failure_spike'
  UNION ALL SELECT alert_id, 'Gateway Timeout', gateway FROM al WHERE reason = 'gateway_timeout'
  UNION ALL SELECT alert_id, 'Fraud Velocity', CASE WHEN txn_per_min > 0 THEN CAST(txn_per_min AS VARCHAR) || '/min' END
            FROM al WHERE reason = 'fraud_velocity'
  UNION ALL SELECT alert_id, 'Duplicate Charge', CASE WHEN dup_txn_id IS NOT NULL THEN '#' || substring(dup_txn_id, 1, 10) END
            FROM al WHERE reason = 'duplicate_charge')"""))

register("alerts_for_payment", lambda s, d: DB.alerts_for_payment(_al(s, d), "TXN2397").select(
    "alert_id", "anomaly_type", "txn_id", "dup_txn_id"), _rec(["v_txn"], """
SELECT alert_id, anomaly_type, txn_id, dup_txn_id FROM al
WHERE txn_id = 'TXN2397' OR dup_txn_id = 'TXN2397' OR order_id = 'TXN2397'
ORDER BY ts DESC, alert_id DESC LIMIT 20"""))


def _all_alerts(s, d):
    """Payment alerts and trace alerts in one list."""
    trace = TR.trace_alerts(TR.rule_verdicts(v_trace(s, d))).select(
        F.concat(F.lit("trace:"), "trace_id").alias("alert_id"), "trace_id", "anomaly_type", F.col("timestamp").alias("ts"))
    return _al(s, d).unionByName(trace, allowMissingColumns=True)


_ALL_ALERTS = _W1.strip() + ",\n" + _ALERTS

register("alerts_for_trace_id", lambda s, d: DB.alerts_for_payment(_all_alerts(s, d), "23").select(
    "alert_id", "anomaly_type", "trace_id"), _rec(["v_txn", "v_trace"], f"""
SELECT 'trace:' || trace_id AS alert_id, {_ATYPE} AS anomaly_type, trace_id
FROM rv WHERE len(reasons) > 0 AND trace_id = '23'""", _ALL_ALERTS))

_ASKED = ["TXN2397", "ord1198", "Txn75", "TXN-none"]

register("payment_lookup", lambda s, d: DB.payment_lookup(v_txn(s, d), _al(s, d), _ASKED), _rec(["v_txn"], """
SELECT k.lookup, t.txn_id IS NOT NULL AS found, t.txn_id, t.order_id, count(h.alert_id) AS n_anomalies,
       coalesce(string_agg(h.alert_id, ',' ORDER BY h.alert_id), '') AS alert_ids
FROM k LEFT JOIN t USING (lookup) LEFT JOIN h USING (lookup) GROUP BY k.lookup, t.txn_id, t.order_id""", _ALERTS + f""",
k AS (SELECT unnest({_ASKED}) AS lookup),
t AS (SELECT k.lookup, arg_max(x.txn_id, x.seq) AS txn_id, arg_max(x.order_id, x.seq) AS order_id
      FROM k JOIN v_txn x ON lower(x.txn_id) = lower(k.lookup) OR lower(x.order_id) = lower(k.lookup) GROUP BY 1),
nm AS (SELECT lookup, lower(lookup) AS name FROM k UNION SELECT lookup, lower(txn_id) FROM t),
h AS (SELECT DISTINCT lookup, alert_id FROM (
        SELECT nm.lookup, al.alert_id, row_number() OVER (PARTITION BY nm.lookup, nm.name
                 ORDER BY al.ts DESC, al.alert_id DESC) AS r
        FROM nm JOIN al ON nm.name IN (lower(al.txn_id), lower(al.dup_txn_id), lower(al.order_id))) WHERE r <= 20)"""))


def _flagged(s, d):
    """Active flags of trace, PII and pod alerts as columns."""
    t = TR.trace_alerts(TR.rule_verdicts(v_trace(s, d)))
    f = F.col("rule_flags")
    traces = t.select(F.concat(F.lit("trace:"), "trace_id").alias("alert_id"),
                      F.when(f["n_plus_1"], f["n_plus_1_count"]).alias("n_plus_1_count"),
                      F.when(f["bimodal_latency"], f["latency_variance"]).alias("latency_variance"),
                      f["dangling_span"].alias("dangling_span"))
    pii = LG.pii_alerts(v_log(s, d), threshold=PII_QUERY_THRESHOLD).select(
        F.concat(F.lit("pii:"), F.col("seq").cast("string")).alias("alert_id"), "redaction_ratio")
    pods = CL.pod_alerts(v_pod(s, d)).select(F.concat(F.lit("pod:"), "k8s_pod").alias("alert_id"), "k8s_restarts")
    return traces.unionByName(pii, allowMissingColumns=True).unionByName(pods, allowMissingColumns=True)


register("alert_flag_pills", lambda s, d: DB.flag_pills(_flagged(s, d)), _rec(["v_trace", "v_log", "v_pod"], """
SELECT 'trace:' || trace_id AS alert_id, 'N+1 Queries' AS label, '×' || span_count AS detail FROM rv WHERE n_plus_1
UNION ALL SELECT 'trace:' || trace_id, 'Bimodal Latency',
                 CASE WHEN latency_variance > 0 THEN 'σ²≈' || format('{:,}', CAST(floor(latency_variance + 0.5) AS BIGINT)) END
          FROM rv WHERE bimodal_latency
UNION ALL SELECT 'trace:' || trace_id, 'Dangling Parent', '@' || dangling_span FROM rv WHERE dangling_span IS NOT NULL
UNION ALL SELECT 'pii:' || seq, 'PII Density', CAST(floor(round(redaction_ratio, 6) * 100 + 0.5) AS BIGINT) || '%'
          FROM pc JOIN pfired USING (service_name, seq)
UNION ALL SELECT 'pod:' || name, 'K8s Pod', CASE WHEN restarts > 0 THEN restarts || ' restarts' END
          FROM v_pod WHERE status IN ('CrashLoopBackOff', 'OOMKilled')""", _W1.strip() + "," + _PII))

register("payment_anomaly_lookup", lambda s, d: DB.payment_anomalies(v_txn(s, d), _al(s, d)), _rec(["v_txn"], """
SELECT t.txn_id, t.order_id, t.status, t.gateway, coalesce(g.n, 0) AS n_anomalies,
       coalesce(array_to_string(g.types, ','), '') AS anomaly_types, true AS found
FROM v_txn t LEFT JOIN (
  SELECT tid, count(*) AS n, list_sort(list(anomaly_type)) AS types FROM (
    SELECT DISTINCT tid, alert_id, anomaly_type FROM (
      SELECT txn_id AS tid, alert_id, anomaly_type FROM al
      UNION ALL SELECT dup_txn_id, alert_id, anomaly_type FROM al WHERE dup_txn_id IS NOT NULL))
  GROUP BY tid) g ON t.txn_id = g.tid"""))


def _unioned(s, d):
    al = _al(s, d)
    return DB.union_dedupe(al.filter(F.col("gateway") == "Razorpay"), al.filter(F.col("reason") == "fraud_velocity"))


register("alert_union_dedupe", lambda s, d: _unioned(s, d).select("alert_id", "gateway", "reason"), _rec(["v_txn"], """
SELECT DISTINCT alert_id, gateway, reason FROM al WHERE gateway = 'Razorpay' OR reason = 'fraud_velocity'"""))


def _feed(s, d):
    al = _al(s, d)                       # alerts of even payments arrive twice
    return DB.feed_dedupe(al.unionByName(al.filter("seq % 2 = 0")))


register("alert_feed", lambda s, d: _feed(s, d).select("feed_id", "ts", "anomaly_type"),
         _rec(["v_txn"], """
SELECT alert_id AS feed_id, ts, anomaly_type FROM al ORDER BY ts DESC, alert_id DESC LIMIT 50"""))

register("gateway_choices", lambda s, d: DB.gateway_choices(v_txn(s, d), K.registry(s)),
         _rec(["v_txn"], """
SELECT gateway FROM (SELECT 'All' AS gateway UNION ALL
  SELECT DISTINCT gateway FROM (SELECT gateway FROM v_txn UNION SELECT name FROM reg))""", _REG_SQL))

register("txn_retention", lambda s, d: DB.retain_by_id(v_txn(s, d), 1000).select("seq", "txn_id"),
         with_views(["v_txn"], "SELECT seq, txn_id FROM v_txn WHERE seq >= (SELECT max(seq) FROM v_txn) - 1000"))

register("trace_retention", lambda s, d: DB.retain_newest(
    v_span(s, d).select("trace_seq").distinct(), 500, "trace_seq"), with_views(["v_span"], """
SELECT DISTINCT trace_seq FROM v_span ORDER BY trace_seq DESC LIMIT 500"""))

def _inr_sql(v: str) -> str:
    w = f"CAST(CAST(round({v}) AS BIGINT) AS VARCHAR)"
    grouped = (f"reverse(regexp_replace(regexp_replace(reverse(left({w}, length({w}) - 3)), "
               f"'([0-9]{{2}})', '\\1,', 'g'), ',$', '')) || ',' || right({w}, 3)")
    return (f"(CASE WHEN {v} >= 1e7 THEN '₹' || printf('%.2f', {v} / 1e7) || ' Cr' "
            f"WHEN {v} >= 1e5 THEN '₹' || printf('%.2f', {v} / 1e5) || ' L' "
            f"ELSE '₹' || (CASE WHEN length({w}) > 3 THEN {grouped} ELSE {w} END) END)")


register("gateway_volume_compact", lambda s, d: K.gateway_breakdown(v_txn(s, d)).select(
    "gateway", DB.compact_inr(F.col("volume")).alias("v1"), DB.compact_inr(F.col("volume") * 7).alias("v7"),
    DB.compact_inr(F.col("volume") * 321).alias("v321")), with_views(["v_txn"], f"""
SELECT gateway, {_inr_sql('volume')} AS v1, {_inr_sql('volume * 7')} AS v7, {_inr_sql('volume * 321')} AS v321 FROM (
  SELECT gateway, round(sum(CASE WHEN status = 'SUCCESS' AND currency = 'INR' THEN amount ELSE 0.0 END), 2) AS volume
  FROM v_txn GROUP BY gateway)"""))

register("failure_rate_percent", lambda s, d: PD.failure_spike_candidates(v_txn(s, d)).select(
    "seq", DB.clamp01(F.col("score")).alias("clamped"), DB.percent(F.col("failure_rate"), 1).alias("pct")),
    with_views(["v_txn"], """
SELECT seq, greatest(0.0, least(1.0, least(0.99, f / n + 0.4))) AS clamped, round(round(f / n, 2) * 100.0, 1) AS pct
FROM fs WHERE n >= 3 AND f / n >= 0.5""", _CAND_SQL.split(",\nc_fs")[0]))

register("payment_timeline", lambda s, d: DB.payment_timeline(v_txn(s, d)), with_views(["v_txn"], """
SELECT txn_id, step, label, sub, "at", done, bad FROM (
  SELECT txn_id, 1 AS step, 'Payment initiated' AS label, CAST(NULL AS VARCHAR) AS sub, ts - INTERVAL 1200 MILLISECOND AS "at",
         true AS done, false AS bad FROM v_txn
  UNION ALL SELECT txn_id, 2, 'Sent to gateway', gateway, ts - INTERVAL 900 MILLISECOND, true, false FROM v_txn
  UNION ALL SELECT txn_id, 3, CASE WHEN status = 'FAILED' THEN 'Authorization declined' ELSE 'Authorized by bank' END,
            CASE WHEN status = 'FAILED' THEN failure_reason ELSE provider END, ts - INTERVAL 400 MILLISECOND, true,
            status = 'FAILED' FROM v_txn
  UNION ALL SELECT txn_id, 4, CASE WHEN status = 'FAILED' THEN 'Payment failed' WHEN status = 'PENDING' THEN 'Awaiting settlement'
            ELSE 'Captured / settled' END, CAST(NULL AS VARCHAR), ts, status NOT IN ('FAILED', 'PENDING'),
            status = 'FAILED' FROM v_txn)"""))

register("gateway_cards", lambda s, d: DB.gateway_cards(K.integrations(s, v_txn(s, d), configured=("RAZORPAY", "STRIPE"))),
         with_views(["v_txn"], """
SELECT name, CASE WHEN live THEN 'live' WHEN configured THEN 'ready' ELSE 'available' END AS status,
       CASE WHEN secs_since_event IS NULL THEN NULL WHEN secs_since_event < 60 THEN CAST(secs_since_event AS VARCHAR) || 's ago'
            ELSE CAST(CAST(floor(secs_since_event / 60) AS BIGINT) AS VARCHAR) || 'm ago' END AS ago
FROM integ""", _REG_SQL))

register("payment_incidents_first5", lambda s, d: DB.incidents_view(_al(s, d), payment_only=True, first=5).select(
    "alert_id", "anomaly_type", "ts"), _rec(["v_txn"], """
SELECT alert_id, anomaly_type, ts FROM al
WHERE anomaly_type IN ('Payment Failure Spike', 'Fraud Velocity', 'Duplicate Charge', 'Gateway Timeout')
ORDER BY ts DESC, alert_id DESC LIMIT 5"""))


def _decoded(s, d):
    scores = F.when(F.col("gateway") == "Razorpay", F.create_map("reason", "anomaly_score"))
    return DB.json_roundtrip(_al(s, d), scores)


register("alert_json_decode", lambda s, d: _decoded(s, d).select(
    "alert_id", F.concat_ws(",", "reasons").alias("reasons"), F.size("ml_scores").alias("n_scores"),
    F.element_at("ml_scores", F.element_at("reasons", 1)).alias("score")),
    _rec(["v_txn"], """
SELECT alert_id, reason AS reasons, CASE WHEN gateway = 'Razorpay' THEN 1 ELSE 0 END AS n_scores,
       CASE WHEN gateway = 'Razorpay' THEN anomaly_score END AS score FROM al"""))

# ---- evidence -------------------------------------------------------------------------

_ATYPE_SQL = """CASE WHEN list_contains(inc.reasons, 'n_plus_1') THEN 'N+1 Query Regression'
                 WHEN list_contains(inc.reasons, 'bimodal_latency') THEN 'Bimodal Latency'
                 WHEN list_contains(inc.reasons, 'dangling_parent') THEN 'Dependency Chain Break'
                 ELSE 'Unclassified Anomaly' END"""

_KIND = """CASE WHEN contains(anomaly_type, 'Failure Spike') THEN 'failure_spike'
                 WHEN contains(anomaly_type, 'Gateway Timeout') THEN 'timeout'
                 WHEN contains(anomaly_type, 'Fraud Velocity') THEN 'velocity'
                 WHEN contains(anomaly_type, 'Duplicate') THEN 'duplicate' ELSE 'other' END"""

register("root_cause", lambda s, d: EV.root_cause(_al(s, d)).select(
    "alert_id", "kind", "root_cause", F.concat_ws(" | ", "suggested_fixes").alias("fixes")),
    _rec(["v_txn"], f"""
SELECT alert_id, kind,
  CASE kind
    WHEN 'failure_spike' THEN 'Payment failure rate spiked to ' || printf('%.0f', round(coalesce(failure_rate, 0.0) * 100))
         || '% on gateway ' || coalesce(gateway, 'unknown') || ', indicating a PSP-side degradation or expired gateway credentials.'
    WHEN 'timeout' THEN 'Gateway ' || coalesce(gateway, 'unknown') || ' exceeded timeout budget ('
         || printf('%.0f', round(duration_ms)) || 'ms), stalling checkout completions.'
    WHEN 'velocity' THEN 'Account ' || coalesce(account, 'unknown') || ' initiated ' || coalesce(CAST(txn_per_min AS VARCHAR), '?')
         || ' transactions/min, far above baseline — pattern consistent with card testing or account takeover.'
    WHEN 'duplicate' THEN 'Duplicate charge detected (original ' || coalesce(dup_txn_id, 'unknown')
         || ') — idempotency key was not honored across retries.'
  END AS root_cause,
  CASE kind
    WHEN 'failure_spike' THEN 'Fail over traffic from ' || coalesce(gateway, 'the affected gateway')
         || ' to a healthy PSP via routing rules | Enable automatic gateway retries with exponential backoff | Check PSP status page and open a priority ticket'
    WHEN 'timeout' THEN 'Reduce gateway call timeout and add circuit breaker | Route new transactions to a secondary gateway | Reconcile PENDING transactions once the gateway recovers'
    WHEN 'velocity' THEN 'Temporarily block the account and force re-authentication | Enable step-up verification (OTP/3DS) for high-velocity accounts | Review device fingerprints linked to the account'
    WHEN 'duplicate' THEN 'Auto-refund the duplicate transaction | Enforce idempotency keys at the gateway adapter layer | Add uniqueness constraint on (order_id, amount, window)'
  END AS fixes
FROM (SELECT *, {_KIND} AS kind FROM al)"""))


def _fired(s, d):
    al = _al(s, d)
    return al.select("alert_id", F.concat_ws("\n", EV.fired_detectors(al)).alias("detectors"))


register("fired_detectors", _fired, _rec(["v_txn"], """
SELECT alert_id, CASE reason
  WHEN 'payment_failure_spike' THEN 'Payment Failure Spike — failure rate ' || printf('%.0f', round(coalesce(failure_rate, 0.0) * 100))
       || '% on gateway ''' || gateway || ''''
  WHEN 'gateway_timeout' THEN 'Gateway Timeout — gateway ''' || gateway || ''' exceeded its timeout budget'
  WHEN 'fraud_velocity' THEN 'Fraud Velocity — account ''' || account || ''' at ' || CAST(txn_per_min AS VARCHAR)
       || ' transactions/min (card-testing / ATO pattern)'
  WHEN 'duplicate_charge' THEN 'Duplicate Charge — idempotency violation, original transaction ' || dup_txn_id
  END AS detectors
FROM al"""))


def _trace_alerts(s, d, traces=None):
    """Trace alerts; ``traces`` is the trace table if it is written already."""
    verdicts = TR.rule_verdicts(v_trace(s, d)) if traces is None else TR.rule_verdicts(traces, materialize_input=False)
    return TR.trace_alerts(verdicts).select(
        "trace_id", "service", "route", "anomaly_score", "duration_ms", "anomaly_type", "reasons",
        F.col("rule_flags.n_plus_1_count").alias("n_plus_1_count"),
        F.col("rule_flags.latency_variance").alias("latency_variance"),
        F.col("rule_flags.dangling_span").alias("dangling_span"))


register("incident_span_stats", lambda s, d: EV.span_stats(
    v_span(s, d).join(_trace_alerts(s, d).select("trace_id"), "trace_id", "left_semi")),
    with_views(["v_trace", "v_span"], """
SELECT trace_id, count(*) AS span_count, CAST(sum(CASE WHEN duration_ms > 500 THEN 1 ELSE 0 END) AS BIGINT) AS slow_count,
       count(DISTINCT service) AS services, min(duration_ms) AS min_ms, round(avg(duration_ms), 9) AS avg_ms,
       max(duration_ms) AS max_ms
FROM v_span WHERE trace_id IN (SELECT trace_id FROM rv WHERE len(reasons) > 0) GROUP BY trace_id""", _W1))


def _pack(s, d, scored=False):
    from .materialize import materialize
    t = v_trace(s, d, materialized=True)                     # the alerts and the scores read it
    inc = materialize(_trace_alerts(s, d, t), "incidents")   # read several times below
    scores = None
    if scored:
        scores = EN.soft_vote(EN.ensemble_scores(t, models=["autoencoder_mse"]), t, ["autoencoder_mse"])
    return EV.evidence_pack(inc, v_span(s, d), LG.incident_logs(v_log(s, d), inc), scores)


_PACK = _W1 + """,
inc AS (SELECT * FROM rv WHERE len(reasons) > 0),
ed AS (SELECT trace_id, count(*) AS edge_count FROM (
         SELECT c.trace_id, row_number() OVER (PARTITION BY c.trace_id ORDER BY c.start_time, c.span_id) AS e
         FROM v_span c JOIN v_span p ON p.trace_id = c.trace_id AND c.parent_span_id = p.span_id)
       WHERE e <= 15 GROUP BY trace_id),
lg AS (SELECT trace_id, count(*) AS log_count FROM (
         SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY ts DESC, seq DESC) AS r
         FROM v_log WHERE trace_id IN (SELECT trace_id FROM inc)) WHERE r <= 25 GROUP BY trace_id),
dgl AS (SELECT trace_id, count(*) AS n, string_agg('  ' || span_id || ' (' || service || '::' || name || ') references missing parent '
                 || parent_span_id, chr(10) ORDER BY e) AS lines FROM (
          SELECT c.*, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS e FROM v_span c
          WHERE trace_id IN (SELECT trace_id FROM inc) AND coalesce(parent_span_id, '') <> '' AND NOT EXISTS (
            SELECT 1 FROM v_span p WHERE p.trace_id = c.trace_id AND p.span_id = c.parent_span_id)) WHERE e <= 20 GROUP BY trace_id),
st AS (SELECT trace_id, count(*) AS span_count, sum(CASE WHEN duration_ms > 500 THEN 1 ELSE 0 END) AS slow_count,
              count(DISTINCT service) AS services FROM v_span WHERE trace_id IN (SELECT trace_id FROM inc) GROUP BY trace_id)"""

register("evidence_pack", lambda s, d: _pack(s, d).select(
    "trace_id", "span_count", "slow_count", "services", "edge_count", "log_count",
    F.size("detectors").alias("n_detectors"), F.size("dangling").alias("n_dangling"),
    F.size("inventory").alias("n_inventory")), with_views(["v_trace", "v_span", "v_log"], """
SELECT inc.trace_id, st.span_count, CAST(st.slow_count AS BIGINT) AS slow_count, st.services,
       coalesce(ed.edge_count, 0) AS edge_count, coalesce(lg.log_count, 0) AS log_count,
       CAST(len(inc.reasons) AS INTEGER) AS n_detectors, CAST(coalesce(dgl.n, 0) AS INTEGER) AS n_dangling,
       CAST(least(st.span_count, 20) AS INTEGER) AS n_inventory
FROM inc JOIN st USING (trace_id) LEFT JOIN ed USING (trace_id) LEFT JOIN lg USING (trace_id) LEFT JOIN dgl USING (trace_id)""", _PACK))

_DOC = _PACK + """,
sp AS (SELECT trace_id, min(duration_ms) AS mn, round(avg(duration_ms), 9) AS av, max(duration_ms) AS mx
       FROM v_span WHERE trace_id IN (SELECT trace_id FROM inc) GROUP BY trace_id),
edt AS (SELECT trace_id, string_agg('  ' || parent_id || ' → ' || child_id || ' (' || child_service || ')',
                                    chr(10) ORDER BY e) AS lines FROM (
          SELECT c.trace_id, p.span_id AS parent_id, c.span_id AS child_id, c.service AS child_service,
                 row_number() OVER (PARTITION BY c.trace_id ORDER BY c.start_time, c.span_id) AS e
          FROM v_span c JOIN v_span p ON p.trace_id = c.trace_id AND c.parent_span_id = p.span_id
          WHERE c.trace_id IN (SELECT trace_id FROM inc)) WHERE e <= 15 GROUP BY trace_id),
inv AS (SELECT trace_id, string_agg('  - ' || service || '::' || name || ' dur=' || printf('%.0f', round(duration_ms)) || 'ms status='
                 || status_code || ' span=' || span_id || ' parent=' || coalesce(parent_span_id, '')
                 || CASE WHEN duration_ms > 500 THEN ' [ANOMALOUS]' ELSE '' END, chr(10) ORDER BY e) AS lines FROM (
          SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS e FROM v_span
          WHERE trace_id IN (SELECT trace_id FROM inc)) WHERE e <= 20 GROUP BY trace_id),
lgl AS (SELECT trace_id, string_agg('  - [' || severity || '] ' || service_name || ': ' || substring(body, 1, 240), chr(10) ORDER BY r) AS lines
        FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts DESC, seq DESC) AS r FROM v_log
              WHERE trace_id IN (SELECT trace_id FROM inc)) WHERE r <= 25 GROUP BY trace_id)"""

_Q = "'"
_DOC_BODY = f"""
SELECT inc.trace_id, concat_ws(chr(10),
  'ANOMALY: ' || ({_ATYPE_SQL}) || ' on ' || inc.primary_service || ' (' ||
      (SELECT name FROM v_span s WHERE s.trace_seq = inc.trace_seq ORDER BY start_time, span_id LIMIT 1) || ')',
  'score=' || printf('%.3f', 1.0) || ' duration=' || printf('%.0f', round(inc.duration_ms)) || 'ms trace=' || inc.trace_id,
  'SPANS: ' || st.span_count || ' total, ' || st.slow_count || ' slow, ' || st.services || ' services, min/avg/max '
      || printf('%.1f', round(sp.mn, 1)) || '/' || printf('%.1f', round(sp.av, 1)) || '/'
      || printf('%.1f', round(sp.mx, 1)) || ' ms',
  'DETECTORS:',
  coalesce(nullif(concat_ws(chr(10),
     CASE WHEN inc.n_plus_1 THEN '- N+1 Query Regression — span_count=' || inc.span_count
          || ' (Chebyshev bound on rolling span-count distribution)' END,
     CASE WHEN inc.bimodal_latency THEN '- Bimodal Latency — EWMA variance≈' || printf('%.1f', round(inc.latency_variance, 1))
          || ' (σ exceeds threshold → latency distribution has split into two modes)' END,
     CASE WHEN inc.dangling_span IS NOT NULL THEN '- Dependency Chain Break — dangling span {_Q}{_Q}' || inc.dangling_span
          || '{_Q}{_Q} (parent_span_id references a span not present in the reconstructed trace)' END), ''),
     '- (none; ML-only detection)'),
  'MODEL SCORES:', '- (no ML scores)',
  'DEPENDENCIES:', coalesce(edt.lines, '  (no parent-child links found)'),
  'DANGLING PARENTS:', coalesce(dgl.lines, '  (none)'),
  'SPAN INVENTORY:', coalesce(inv.lines, '  (no spans)'),
  'CORRELATED LOGS:', coalesce(lgl.lines, '  (no correlated logs)')) AS evidence
FROM inc JOIN st USING (trace_id) JOIN sp USING (trace_id) LEFT JOIN edt USING (trace_id)
     LEFT JOIN dgl USING (trace_id) LEFT JOIN inv USING (trace_id) LEFT JOIN lgl USING (trace_id)"""

register("evidence_text", lambda s, d: EV.evidence_text(_pack(s, d)),
         with_views(["v_trace", "v_span", "v_log"], _DOC_BODY, _DOC))

# with the principal component's score of each incident, from versions without a warm-up corpus
register("evidence_text_scored", lambda s, d: EV.evidence_text(_pack(s, d, scored=True)),
         with_views(["v_trace", "v_span", "v_log"],
                    _DOC_BODY.replace("'- (no ML scores)'", "'- autoencoder_mse: ' || printf('%.3f', round(ae.autoencoder_mse, 3))")
                    .replace("FROM inc JOIN st", "FROM inc JOIN ae USING (trace_id) JOIN st"),
                    _ARRIVED_COLD + "," + _MOMENTS + "," + _DOC))

# ---- root cause and detectors of all kinds of incidents ------------------------------------

def _all_incidents(s, d):
    """Trace, PII, pod and payment alerts with the columns that the texts need."""
    def texts(df, key, *columns):
        return df.select(F.concat(F.lit(key[0]), F.col(key[1]).cast("string")).alias("alert_id"), "anomaly_type", "service",
                         "route", "duration_ms", *columns)

    pii = LG.pii_alerts(v_log(s, d), threshold=PII_QUERY_THRESHOLD)
    pay = _al(s, d).withColumn("reasons", F.array("reason"))
    parts = [texts(_trace_alerts(s, d), ("trace:", "trace_id"), "reasons", "n_plus_1_count", "latency_variance", "dangling_span"),
             texts(pii, ("pii:", "seq"), F.array("reason").alias("reasons"), "redaction_ratio"),
             texts(CL.pod_alerts(v_pod(s, d)), ("pod:", "k8s_pod"), F.array("reason").alias("reasons"), "k8s_pod", "k8s_node",
                   "k8s_restarts", "k8s_deployment"),
             texts(pay, ("", "alert_id"), "reasons", "gateway", "failure_rate", "txn_per_min", "account", "dup_txn_id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _filled(text, *values):
    """A fixed text with its places filled, as SQL."""
    quoted = ["'" + p.replace("%%", "%").replace("'", "''") + "'" for p in text.split("%s")]
    return " || ".join(x for pair in zip(quoted, [*values, None]) for x in pair if x)


def _case(key, texts):
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in texts.items()) + " END"


def _fixes(kind):
    lines = "'" + " | ".join(FIXES[kind]).replace("'", "''") + "'"
    return (f"replace(replace(replace({lines}, '{{gateway}}', coalesce(gateway, 'the affected gateway')), "
            "'{service}', service), '{route}', route)")


_pct = "printf('%.0f', round(coalesce({0}, 0.0) * 100))".format
_whole = "printf('%.0f', round({0}))".format
_KINDS = {
    "n_plus_1": _filled(ROOT_CAUSES["n_plus_1"], "n_plus_1_count", "service"),
    "bimodal": _filled(ROOT_CAUSES["bimodal"], "route", _whole("latency_variance")),
    "dependency": _filled(ROOT_CAUSES["dependency"], "coalesce(dangling_span, 'unknown')"),
    "pii": _filled(ROOT_CAUSES["pii"], _pct("redaction_ratio")),
    "crashloop": _filled(ROOT_CAUSES["crashloop"], "pod", "node", "restarts"),
    "oom": _filled(ROOT_CAUSES["oom"], "pod"),
    "failure_spike": _filled(ROOT_CAUSES["failure_spike"], _pct("failure_rate"), "coalesce(gateway, 'unknown')"),
    "timeout": _filled(ROOT_CAUSES["timeout"], "coalesce(gateway, 'unknown')", _whole("duration_ms")),
    "velocity": _filled(ROOT_CAUSES["velocity"], "coalesce(account, 'unknown')", "coalesce(CAST(txn_per_min AS VARCHAR), '?')"),
    "duplicate": _filled(ROOT_CAUSES["duplicate"], "coalesce(dup_txn_id, 'unknown')")}
_DETECTED = {
    "n_plus_1": _filled(DETECTOR_TEXTS["n_plus_1"], "n_plus_1_count"),
    "bimodal_latency": _filled(DETECTOR_TEXTS["bimodal_latency"], "printf('%.1f', round(latency_variance, 1))"),
    "dangling_parent": _filled(DETECTOR_TEXTS["dangling_parent"], "dangling_span"),
    "pii_redaction_density": _filled(DETECTOR_TEXTS["pii_redaction_density"], _pct("redaction_ratio")),
    "k8s_crashloop": _filled(DETECTOR_TEXTS["pod_failure"], "pod", "node", "service", "restarts"),
    "k8s_oom": _filled(DETECTOR_TEXTS["pod_failure"], "pod", "node", "service", "restarts"),
    "payment_failure_spike": _filled(DETECTOR_TEXTS["payment_failure_spike"], _pct("failure_rate"), "gateway"),
    "gateway_timeout": _filled(DETECTOR_TEXTS["gateway_timeout"], "gateway"),
    "fraud_velocity": _filled(DETECTOR_TEXTS["fraud_velocity"], "account", "CAST(txn_per_min AS VARCHAR)"),
    "duplicate_charge": _filled(DETECTOR_TEXTS["duplicate_charge"], "dup_txn_id")}

_INCIDENTS = _ALERTS + "," + _PII + "," + _W1 + """,
inc_all AS (
  SELECT 'trace:' || trace_id AS alert_id, primary_service AS service,
         CASE WHEN n_plus_1 THEN 'n_plus_1' WHEN bimodal_latency THEN 'bimodal' ELSE 'dependency' END AS kind, reasons,
         (SELECT arg_min(name, (start_time, span_id)) FROM v_span s WHERE s.trace_seq = rv.trace_seq) AS route, duration_ms,
         CAST(CASE WHEN n_plus_1 THEN span_count ELSE 0 END AS VARCHAR) AS n_plus_1_count,
         CASE WHEN bimodal_latency THEN latency_variance ELSE 0.0 END AS latency_variance, dangling_span,
         NULL::DOUBLE AS redaction_ratio, NULL::VARCHAR AS pod, NULL::VARCHAR AS node, NULL::VARCHAR AS restarts,
         NULL::VARCHAR AS gateway, NULL::DOUBLE AS failure_rate, NULL::BIGINT AS txn_per_min, NULL::VARCHAR AS account,
         NULL::VARCHAR AS dup_txn_id
  FROM rv WHERE len(reasons) > 0
  UNION ALL
  SELECT 'pii:' || seq, service_name, 'pii', ['pii_redaction_density'], 'security.pii_density', 0.0, NULL, NULL, NULL,
         round(redaction_ratio, 6), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM pc JOIN pfired USING (service_name, seq)
  UNION ALL
  SELECT 'pod:' || name, deployment, CASE status WHEN 'OOMKilled' THEN 'oom' ELSE 'crashloop' END,
         [CASE status WHEN 'OOMKilled' THEN 'k8s_oom' ELSE 'k8s_crashloop' END], 'k8s://' || node || '/' || substr(name, 1, 24), 0.0,
         NULL, NULL, NULL, NULL, name, node, CAST(restarts AS VARCHAR), NULL, NULL, NULL, NULL, NULL
  FROM v_pod WHERE status IN ('CrashLoopBackOff', 'OOMKilled')
  UNION ALL
  SELECT alert_id, service, """ + _KIND + """, [reason], route, duration_ms, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         gateway, failure_rate, txn_per_min, account, dup_txn_id
  FROM al)"""

_EVERY = ["v_txn", "v_trace", "v_span", "v_log", "v_pod"]

register("root_cause_all_kinds", lambda s, d: EV.root_cause(_all_incidents(s, d)).select(
    "alert_id", "kind", "root_cause", F.concat_ws(" | ", "suggested_fixes").alias("fixes")),
    _rec(_EVERY, f"SELECT alert_id, kind, {_case('kind', _KINDS)} AS root_cause, {_case('kind', {k: _fixes(k) for k in _KINDS})} AS fixes FROM inc_all",
         _INCIDENTS))

def _fired_all(s, d):
    incidents = _all_incidents(s, d)
    return incidents.select("alert_id", F.concat_ws("\n", EV.fired_detectors(incidents)).alias("detectors"))


register("fired_detectors_all_kinds", _fired_all,
    _rec(_EVERY, f"""
SELECT alert_id, array_to_string(list_filter([{", ".join(f"CASE WHEN list_contains(reasons, '{k}') THEN {v} END" for k, v in _DETECTED.items())}],
       lambda x: x IS NOT NULL), chr(10)) AS detectors
FROM inc_all""", _INCIDENTS))

register("incident_headline", lambda s, d: EV.headline(_al(s, d)), _rec(["v_txn"], """
SELECT coalesce(arg_max('Detected anomaly in ' || service || ' — ' || printf('%.0f', round(coalesce(duration_ms, 0.0)))
                || 'ms latency on ' || route || '. Investigate for potential performance degradation.', (ts, alert_id)),
                'No active anomalies detected. System operating normally.') AS headline,
       count(*) > 0 AS has_anomaly
FROM al"""))
