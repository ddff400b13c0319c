"""Registered log queries (Spark) and their DuckDB oracles.

The driver documents carry far fewer redaction tokens than the 0.8 density
the detector is tuned for, so the density query is registered with the
threshold passed as 0.08 (a parameter of the operator; the default stays 0.8).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.redaction import is_redacted
from ..operators import logs as LG
from ..operators import traces as TR
from .catalog_traces import _W1
from .oracle import with_views
from .registry import register
from .vehicles import v_log, v_trace

PII_QUERY_THRESHOLD = 0.08

_FLAG = ("(contains(body, '[REDACTED_EMAIL]') OR contains(body, '[REDACTED_AUTHOR]') "
         "OR contains(body, '[REDACTED_CC]'))")

register("log_redaction", lambda s, d: v_log(s, d).select(
    "seq", "service_name", "body", is_redacted(F.col("body")).alias("is_redacted")),
    with_views(["v_log"], f"SELECT seq, service_name, body, {_FLAG} AS is_redacted FROM v_log"))

register("log_redaction_counter", lambda s, d: LG.redaction_counter(v_log(s, d)),
         with_views(["v_log"], f"""
SELECT service, 'redaction_count' AS metric_type, CAST(running AS DOUBLE) AS value, ts AS timestamp, seq FROM (
  SELECT service_name AS service, ts, seq, {_FLAG} AS f,
         sum(CASE WHEN {_FLAG} THEN 1 ELSE 0 END) OVER (PARTITION BY service_name ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM v_log) WHERE f"""))

_PII = f"""
lf AS (SELECT *, {_FLAG} AS is_redacted FROM v_log),
pd AS (SELECT *, count(*) OVER w AS window_log_count,
              sum(CASE WHEN is_redacted THEN 1 ELSE 0 END) OVER w AS redacted_count
       FROM lf WINDOW w AS (PARTITION BY service_name ORDER BY ts
                            RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)),
pc AS (SELECT *, redacted_count / window_log_count AS redaction_ratio FROM pd
       WHERE window_log_count >= 5 AND redacted_count / window_log_count > {PII_QUERY_THRESHOLD}),
pnx AS MATERIALIZED (SELECT a.service_name, a.seq, arg_min(b.seq, b.ts) AS nseq
        FROM pc a LEFT JOIN pc b ON a.service_name = b.service_name AND b.ts >= a.ts + INTERVAL 60 SECOND
        GROUP BY a.service_name, a.seq),
pfired AS (SELECT service_name, seq FROM (SELECT service_name, seq,
             row_number() OVER (PARTITION BY service_name ORDER BY ts, seq) AS r FROM pc) WHERE r = 1
           UNION ALL
           SELECT n.service_name, n.nseq FROM pfired f JOIN pnx n ON n.service_name = f.service_name AND n.seq = f.seq
           WHERE n.nseq IS NOT NULL)"""


def _rec(views, body, extra):
    return with_views(views, body, extra).replace("WITH ", "WITH RECURSIVE ", 1)


register("pii_density_candidates", lambda s, d: LG.pii_density(
    v_log(s, d), threshold=PII_QUERY_THRESHOLD).select(
    "seq", "service_name", "window_log_count", "redacted_count", F.round("redaction_ratio", 6).alias("ratio")),
    _rec(["v_log"], """
SELECT seq, service_name, window_log_count, CAST(redacted_count AS BIGINT) AS redacted_count,
       round(redaction_ratio, 6) AS ratio FROM pc""", _PII))

register("pii_alerts", lambda s, d: LG.pii_alerts(v_log(s, d), threshold=PII_QUERY_THRESHOLD),
         _rec(["v_log"], """
SELECT service_name AS service, 'security.pii_density' AS route, round(redaction_ratio, 6) AS anomaly_score,
       true AS is_anomaly, CAST(0.0 AS DOUBLE) AS duration_ms, trace_id, ts AS timestamp,
       'pii_redaction_density' AS reason, 'PII Redaction Density' AS anomaly_type,
       round(redaction_ratio, 6) AS redaction_ratio, window_log_count,
       CAST(redacted_count AS BIGINT) AS redacted_count, seq
FROM pc JOIN pfired USING (service_name, seq)""", _PII))


def _anom(s, d):
    return TR.rule_verdicts(v_trace(s, d)).filter("is_anomaly")


register("trace_log_correlation", lambda s, d: LG.correlate_logs(v_log(s, d), _anom(s, d)).select(
    "trace_id", "seq", "rank", "service_name", "severity"),
    with_views(["v_log", "v_trace"], """
SELECT trace_id, seq, rank, service_name, severity FROM (
  SELECT trace_id, seq, service_name, severity,
         row_number() OVER (PARTITION BY trace_id ORDER BY ts, seq) AS rank
  FROM v_log WHERE trace_id IN (SELECT trace_id FROM rv WHERE len(reasons) > 0) AND trace_id <> '')
WHERE rank <= 50""", _W1))

register("incident_logs", lambda s, d: LG.incident_logs(v_log(s, d), _anom(s, d)),
         with_views(["v_log", "v_trace"], """
SELECT trace_id, rank, seq, severity, service_name, substring(body, 1, 240) AS body FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts DESC, seq DESC) AS rank
  FROM v_log WHERE trace_id IN (SELECT trace_id FROM rv WHERE len(reasons) > 0))
WHERE rank <= 25""", _W1))
