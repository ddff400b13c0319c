"""Registered trace queries (Spark) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import rnd
from ..operators import traces as TR
from .materialize import materialize
from .oracle import with_views
from .registry import register
from .vehicles import v_span, v_trace

# ---- reconstruction -----------------------------------------------------------

register("trace_build", lambda s, d: v_trace(s, d).select(
    "trace_id", "duration_ms", "span_count", rnd(F.col("error_rate"), 6).alias("error_rate"),
    "start_time", "has_anomaly", "primary_service", "dangling_span",
    F.concat_ws(",", "services").alias("services")),
    with_views(["v_trace"], """
SELECT trace_id, duration_ms, span_count, round(error_rate, 6) AS error_rate, start_time, has_anomaly,
       primary_service, dangling_span, array_to_string(services, ',') AS services
FROM v_trace"""))

register("trace_span_rows", lambda s, d: TR.trace_spans(v_span(s, d)).select(
    "trace_id", "position", "span_id", "service", "duration_ms"), with_views(["v_span"], """
SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS INTEGER) AS position,
       span_id, service, duration_ms
FROM v_span"""))

_W10 = """
sw AS (SELECT *, time_bucket(INTERVAL 10 SECOND, start_time) AS w FROM v_span)"""

register("trace_windowed", lambda s, d: TR.build_traces(v_span(s, d), carry=("trace_seq",), window_s=10).select(
    F.col("window.start").alias("window_start"), "trace_id", "span_count", "duration_ms",
    "has_anomaly", "start_time", "primary_service"),
    with_views(["v_span"], """
SELECT w AS window_start, trace_id, count(*) AS span_count, max(duration_ms) AS duration_ms,
       bool_or(duration_ms > 500) AS has_anomaly, min(start_time) AS start_time,
       any_value(primary_service) AS primary_service
FROM sw JOIN (
  SELECT w, trace_id, service AS primary_service FROM (
    SELECT w, trace_id, service, row_number() OVER (PARTITION BY w, trace_id
             ORDER BY sum(duration_ms) DESC, min(start_time)) AS k
    FROM sw GROUP BY w, trace_id, service) WHERE k = 1) USING (w, trace_id)
GROUP BY w, trace_id""", _W10))

register("trace_merge_partials", lambda s, d: TR.merge_partial_traces(
    TR.build_traces(v_span(s, d), carry=("trace_seq",), window_s=10)).select(
    "trace_id", "duration_ms", "span_count", "has_anomaly", "start_time"),
    with_views(["v_span"], """
SELECT trace_id, max(duration_ms) AS duration_ms, count(*) AS span_count,
       bool_or(duration_ms > 500) AS has_anomaly, min(start_time) AS start_time
FROM v_span GROUP BY trace_id"""))

register("span_flags", lambda s, d: TR.span_flags(v_span(s, d)).select(
    "trace_id", "span_id", "is_anomaly", "kind"), with_views(["v_span"], """
SELECT trace_id, span_id, duration_ms > 500 AS is_anomaly,
       CASE WHEN service = 'api-gateway' THEN 'API' WHEN contains(lower(name), 'db') THEN 'DATABASE'
            ELSE 'SERVICE' END AS kind
FROM v_span"""))

register("dangling_spans", lambda s, d: TR.dangling_spans(v_span(s, d)).select(
    "trace_id", "span_id", "parent_span_id", "name"), with_views(["v_span"], """
SELECT c.trace_id, c.span_id, c.parent_span_id, c.name FROM v_span c
WHERE coalesce(c.parent_span_id, '') <> ''
  AND NOT EXISTS (SELECT 1 FROM v_span p WHERE p.trace_id = c.trace_id AND p.span_id = c.parent_span_id)"""))

register("dependency_edges", lambda s, d: TR.dependency_edges(v_span(s, d)), with_views(["v_span"], """
SELECT trace_id, parent_id, child_id, parent_service, child_service, child_name, edge_no FROM (
  SELECT c.trace_id, p.span_id AS parent_id, c.span_id AS child_id, p.service AS parent_service,
         c.service AS child_service, c.name AS child_name,
         row_number() OVER (PARTITION BY c.trace_id ORDER BY c.start_time, c.span_id) AS edge_no
  FROM v_span c JOIN v_span p ON p.trace_id = c.trace_id AND c.parent_span_id = p.span_id)
WHERE edge_no <= 15"""))

# ---- rolling rule detectors ---------------------------------------------------

_W1 = """
w1 AS (SELECT *, count(*) OVER w AS n,
              coalesce(sum(CAST(span_count AS DOUBLE)) OVER w, 0.0) AS s1,
              coalesce(sum(CAST(span_count AS DOUBLE) * CAST(span_count AS DOUBLE)) OVER w, 0.0) AS s2
       FROM v_trace
       WINDOW w AS (PARTITION BY primary_service ORDER BY trace_seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w1f AS (SELECT *, n >= 10 AND span_count >= 10
                  AND span_count > (CASE WHEN n > 0 THEN s1 / n ELSE 0.0 END)
                      + 3.0 * sqrt(greatest(CASE WHEN n > 1 THEN (s2 - s1 * s1 / n) / (n - 1) ELSE 0.0 END, 0.0))
                  AS n_plus_1
        FROM w1),
w2 AS (SELECT *, row_number() OVER (PARTITION BY primary_service ORDER BY trace_seq) AS k FROM w1f),
ew(svc, k, m, v) AS (
  SELECT primary_service, k, duration_ms, CAST(0.0 AS DOUBLE) FROM w2 WHERE k = 1
  UNION ALL
  SELECT b.primary_service, b.k, e.m + CAST(0.2 AS DOUBLE) * (b.duration_ms - e.m),
         CAST(0.2 AS DOUBLE) * ((b.duration_ms - e.m) * (b.duration_ms - e.m)) + CAST(0.8 AS DOUBLE) * e.v
  FROM ew e JOIN w2 b ON b.primary_service = e.svc AND b.k = e.k + 1),
w2s AS (SELECT w2.*, CASE WHEN e.svc IS NOT NULL THEN {'m': e.m, 'v': e.v} END AS st, w2.k - 1 AS n2
        FROM w2 LEFT JOIN ew e ON e.svc = w2.primary_service AND e.k = w2.k - 1),
verd AS (SELECT *,
           coalesce(n2 >= 10 AND st IS NOT NULL
                    AND (CASE WHEN st.v > 0 THEN sqrt(st.v) ELSE 0.0 END) > 500
                    AND st.m > 200
                    AND duration_ms > st.m + (CASE WHEN st.v > 0 THEN sqrt(st.v) ELSE 0.0 END), false)
             AS bimodal_latency,
           round(coalesce(st.v, 0.0), 6) AS latency_variance
         FROM w2s),
rv AS (SELECT *, list_filter([CASE WHEN n_plus_1 THEN 'n_plus_1' END,
                              CASE WHEN bimodal_latency THEN 'bimodal_latency' END,
                              CASE WHEN dangling_span IS NOT NULL THEN 'dangling_parent' END],
                             lambda x: x IS NOT NULL) AS reasons
       FROM verd)"""



def _rule_input(s, d):
    """What the rolling detectors read of all traces, written once: they read it several times."""
    return materialize(v_trace(s, d).select("trace_id", "trace_seq", "primary_service", "span_count", "duration_ms"), "rule-input")


register("trace_n_plus_1", lambda s, d: TR.n_plus_1(_rule_input(s, d)).filter("n_plus_1").select(
    "trace_id", "primary_service", "span_count"), with_views(["v_trace"], """
SELECT trace_id, primary_service, span_count FROM w1f WHERE n_plus_1""", _W1))

register("trace_bimodal", lambda s, d: TR.bimodal(_rule_input(s, d)).filter("bimodal_latency").select(
    "trace_id", "primary_service", "duration_ms", "latency_variance"), with_views(["v_trace"], """
SELECT trace_id, primary_service, duration_ms, latency_variance FROM verd WHERE bimodal_latency""", _W1))

register("trace_rule_verdicts", lambda s, d: TR.rule_verdicts(v_trace(s, d)).filter("is_anomaly").select(
    "trace_id", "primary_service", F.concat_ws(",", "reasons").alias("reasons"), "rule_score"),
    with_views(["v_trace"], """
SELECT trace_id, primary_service, array_to_string(reasons, ',') AS reasons, CAST(1.0 AS DOUBLE) AS rule_score
FROM rv WHERE len(reasons) > 0""", _W1))

register("trace_bound_scores", lambda s, d: v_trace(s, d).select(
    "trace_id", TR.bound_score(F.col("duration_ms"), F.col("span_count"), F.col("error_rate"))
    .alias("bound_score")).filter("bound_score > 0"), with_views(["v_trace"], """
SELECT trace_id, bound_score FROM (
  SELECT trace_id, CAST(greatest(CASE WHEN duration_ms > 1000 THEN 0.8 ELSE 0.0 END,
                                 CASE WHEN span_count > 30 THEN 0.9 ELSE 0.0 END,
                                 CASE WHEN error_rate > 0.1 THEN 0.95 ELSE 0.0 END) AS DOUBLE) AS bound_score
  FROM v_trace) WHERE bound_score > 0"""))


def _alerts(s, d):
    return TR.trace_alerts(TR.rule_verdicts(v_trace(s, d)))


_ATYPE = """CASE WHEN list_contains(reasons, 'n_plus_1') THEN 'N+1 Query Regression'
                 WHEN list_contains(reasons, 'bimodal_latency') THEN 'Bimodal Latency'
                 WHEN list_contains(reasons, 'dangling_parent') THEN 'Dependency Chain Break'
                 ELSE 'Unclassified Anomaly' END"""

register("trace_alerts", lambda s, d: _alerts(s, d).select(
    "trace_id", "service", "route", "anomaly_score", "anomaly_type",
    F.concat_ws(",", "reasons").alias("reasons"), F.col("rule_flags.n_plus_1_count").alias("n_plus_1_count"),
    F.col("rule_flags.latency_variance").alias("latency_variance"),
    F.col("rule_flags.dangling_span").alias("dangling_span"), F.size("spans").alias("n_spans")),
    with_views(["v_trace", "v_span"], f"""
SELECT trace_id, primary_service AS service,
       (SELECT name FROM v_span s WHERE s.trace_seq = rv.trace_seq ORDER BY start_time, span_id LIMIT 1) AS route,
       CAST(1.0 AS DOUBLE) AS anomaly_score, {_ATYPE} AS anomaly_type, array_to_string(reasons, ',') AS reasons,
       CAST(CASE WHEN n_plus_1 THEN span_count ELSE 0 END AS INTEGER) AS n_plus_1_count,
       CASE WHEN bimodal_latency THEN latency_variance ELSE 0.0 END AS latency_variance,
       dangling_span, CAST(least(span_count, 20) AS INTEGER) AS n_spans
FROM rv WHERE len(reasons) > 0""", _W1))

register("trace_alerts_by_service", lambda s, d: _alerts(s, d).groupBy("service", "anomaly_type").agg(
    F.count(F.lit(1)).alias("alerts"), rnd(F.avg("duration_ms"), 6).alias("avg_duration_ms")),
    with_views(["v_trace"], f"""
SELECT primary_service AS service, {_ATYPE} AS anomaly_type, count(*) AS alerts,
       round(avg(duration_ms), 6) AS avg_duration_ms
FROM rv WHERE len(reasons) > 0 GROUP BY ALL""", _W1))

register("trace_counters", lambda s, d: TR.trace_counters(TR.rule_verdicts(v_trace(s, d))),
         with_views(["v_trace"], """
SELECT service, count(*) AS total, CAST(sum(CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS anomalous
FROM (SELECT unnest(services) AS service, reasons FROM rv) GROUP BY service""", _W1))

register("trace_stats_all", lambda s, d: TR.trace_stats(TR.trace_counters(TR.rule_verdicts(v_trace(s, d)))),
         with_views(["v_trace"], """
SELECT CAST(coalesce(sum(total), 0) AS BIGINT) AS total_traces, CAST(coalesce(sum(anomalous), 0) AS BIGINT) AS anomaly_count,
       round(CASE WHEN coalesce(sum(total), 0) > 0 THEN sum(anomalous) * 100.0 / sum(total) ELSE 0.0 END, 2) AS error_rate_pct
FROM (SELECT service, count(*) AS total, sum(CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END) AS anomalous
      FROM (SELECT unnest(services) AS service, reasons FROM rv) GROUP BY service)""", _W1))

register("trace_stats_service", lambda s, d: TR.trace_stats(
    TR.trace_counters(TR.rule_verdicts(v_trace(s, d))), "payment-service"),
    with_views(["v_trace"], """
SELECT CAST(coalesce(sum(total), 0) AS BIGINT) AS total_traces, CAST(coalesce(sum(anomalous), 0) AS BIGINT) AS anomaly_count,
       round(CASE WHEN coalesce(sum(total), 0) > 0 THEN sum(anomalous) * 100.0 / sum(total) ELSE 0.0 END, 2) AS error_rate_pct
FROM (SELECT service, count(*) AS total, sum(CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END) AS anomalous
      FROM (SELECT unnest(services) AS service, reasons FROM rv) GROUP BY service)
WHERE service = 'payment-service'""", _W1))

register("service_window_metrics", lambda s, d: TR.service_window_metrics(v_span(s, d)),
         with_views(["v_span"], """
SELECT time_bucket(INTERVAL 10 SECOND, start_time) AS window_start, trace_id, service,
       CAST(count(*) AS DOUBLE) AS throughput,
       list_sort(list(duration_ms))[greatest(0, CAST(floor(count(*) * 0.99) AS INTEGER) - 1) + 1] AS p99_latency
FROM v_span GROUP BY ALL"""))

register("span_waterfall", lambda s, d: TR.waterfall(v_span(s, d)), with_views(["v_span"], """
SELECT trace_id, span_id, name, service, start_time, duration_ms, off AS offset_ms,
       round(CASE WHEN tot > 0 THEN off * 100.0 / tot ELSE 0.0 END, 4) AS left_pct,
       round(CASE WHEN tot > 0 THEN duration_ms * 100.0 / tot ELSE 0.0 END, 4) AS width_pct,
       round(greatest(4.0, CASE WHEN tot > 0 THEN duration_ms * 100.0 / tot ELSE 0.0 END), 4) AS width_pct_compact
FROM (SELECT *, (epoch_us(start_time) - min(epoch_us(start_time)) OVER (PARTITION BY trace_id)) / 1000.0 AS off,
             max(duration_ms) OVER (PARTITION BY trace_id) AS tot FROM v_span)"""))

register("anomaly_rate_history", lambda s, d: TR.anomaly_rate_history(TR.rule_verdicts(v_trace(s, d))),
         with_views(["v_trace"], """
SELECT primary_service, trace_seq, total, anomalous,
       round(anomalous * 100.0 / total, 4) AS error_rate_pct FROM (
  SELECT primary_service, trace_seq,
         count(*) OVER c AS total,
         CAST(sum(CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END) OVER c AS BIGINT) AS anomalous,
         row_number() OVER (PARTITION BY primary_service ORDER BY trace_seq DESC) AS b
  FROM rv WINDOW c AS (PARTITION BY primary_service ORDER BY trace_seq
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE b <= 30""", _W1))

register("latest_span_per_trace", lambda s, d: TR.latest_by_key(
    v_span(s, d).select("trace_id", "span_id", "start_time", "duration_ms"), "trace_id", "start_time"),
    with_views(["v_span"], """
SELECT trace_id, span_id, start_time, duration_ms FROM v_span
QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY start_time DESC) = 1"""))

register("trace_lookup", lambda s, d: TR.trace_lookup(v_span(s, d), "7").select(
    "trace_id", "span_id", "service", "duration_ms"), with_views(["v_span"], """
SELECT trace_id, span_id, service, duration_ms FROM v_span WHERE trace_id = '7'"""))

register("alert_first_spans", lambda s, d: _alerts(s, d).select(
    "trace_id", F.posexplode("spans").alias("pos", "sp")).select(
    "trace_id", (F.col("pos") + 1).alias("pos"), F.col("sp.span_id").alias("span_id")),
    with_views(["v_trace", "v_span"], """
SELECT s.trace_id, pos, span_id FROM (
  SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS pos
  FROM v_span) s JOIN rv ON rv.trace_id = s.trace_id
WHERE len(rv.reasons) > 0 AND pos <= 20""", _W1))

# a store that lost one trace in three, and keeps all spans of the others
register("alert_stored_trace", lambda s, d: TR.alert_with_stored_trace(
    _alerts(s, d), v_span(s, d).filter("trace_seq % 3 <> 0")),
    with_views(["v_trace", "v_span"], """
SELECT s.trace_id, s.span_id, s.duration_ms, s.trace_seq % 3 <> 0 AS stored
FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS pos FROM v_span) s
JOIN rv ON rv.trace_id = s.trace_id
WHERE len(rv.reasons) > 0 AND (s.trace_seq % 3 <> 0 OR s.pos <= 20)""", _W1))
