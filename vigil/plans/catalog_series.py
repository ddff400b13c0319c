"""Registered metric-series and Kubernetes queries (Spark) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as CL
from ..operators import series as SR
from .oracle import with_views
from .registry import register
from .vehicles import v_metric, v_node, v_pod

NOW = "2024-01-01 12:00:00"

register("metric_trend", lambda s, d: SR.trend(v_metric(s, d)), with_views(["v_metric"], """
SELECT service, metric_type, last_value, prev_value, round(last_value - prev_value, 6) AS trend FROM (
  SELECT service, metric_type,
         arg_max(value, seq) FILTER (WHERE r = 1) AS last_value,
         arg_max(value, seq) FILTER (WHERE r = 2) AS prev_value
  FROM (SELECT *, row_number() OVER (PARTITION BY service, metric_type ORDER BY ts DESC, seq DESC) AS r
        FROM v_metric) WHERE r <= 2 GROUP BY service, metric_type)"""))

register("metric_last_n", lambda s, d: SR.last_n(v_metric(s, d), 50), with_views(["v_metric"], """
SELECT service, metric_type, ts, seq, value, CAST(c - r + 1 AS INTEGER) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY service, metric_type ORDER BY ts DESC, seq DESC) AS r,
         least(50, count(*) OVER (PARTITION BY service, metric_type)) AS c
  FROM v_metric) WHERE r <= 50"""))

register("metric_align_two", lambda s, d: SR.align_two(v_metric(s, d), "api-gateway", "payment-service"),
         with_views(["v_metric"], """
SELECT time, "api-gateway", "payment-service" FROM (
  SELECT strftime(ts, '%H:%M:%S') AS time,
         arg_max(value, ts) FILTER (WHERE service = 'api-gateway') AS "api-gateway",
         arg_max(value, ts) FILTER (WHERE service = 'payment-service') AS "payment-service"
  FROM v_metric WHERE metric_type = 'p99_latency' AND service IN ('api-gateway', 'payment-service')
  GROUP BY 1)
ORDER BY time DESC LIMIT 30"""))

register("metric_concat", lambda s, d: SR.concat_series(
    v_metric(s, d), ["api-gateway", "payment-service"], "throughput"),
    with_views(["v_metric"], """
SELECT seq, service, metric_type, value, ts FROM v_metric
WHERE metric_type = 'throughput' AND service IN ('api-gateway', 'payment-service') ORDER BY ts, seq"""))

register("metric_redaction_total", lambda s, d: SR.redaction_total(
    v_metric(s, d), ["api-gateway", "payment-service"]), with_views(["v_metric"], """
SELECT round(coalesce(sum(v), 0.0), 6) AS redactions FROM (
  SELECT arg_max(value, seq) AS v FROM v_metric
  WHERE metric_type = 'redaction_count' AND service IN ('api-gateway', 'payment-service')
  GROUP BY service)"""))

register("metric_throughput_total", lambda s, d: SR.throughput_total(v_metric(s, d)),
         with_views(["v_metric"], """
SELECT round(coalesce(sum(value), 0.0), 6) AS throughput FROM v_metric WHERE metric_type = 'throughput'"""))

register("metric_latency_state", lambda s, d: SR.latency_state(v_metric(s, d)), with_views(["v_metric"], """
SELECT service, arg_max(value, seq) AS last_p99,
       CASE WHEN arg_max(value, seq) > 500 THEN 'Critical' ELSE 'Healthy' END AS state
FROM v_metric WHERE metric_type = 'p99_latency' GROUP BY service"""))

register("metric_mode_series", lambda s, d: SR.series_for_mode(v_metric(s, d), "redaction"),
         with_views(["v_metric"], """
SELECT seq, service, metric_type, value, ts FROM v_metric WHERE metric_type = 'redaction_count'"""))

# ---- Kubernetes -----------------------------------------------------------------

register("k8s_node_pods", lambda s, d: CL.nodes_with_pods(v_node(s), v_pod(s, d)).select(
    "name", "zone", "pod", "cpu_m", "mem_mi"), with_views(["v_node", "v_pod"], """
SELECT n.name, n.zone, p.name AS pod, p.cpu_m, p.mem_mi FROM v_node n LEFT JOIN v_pod p ON p.node = n.name"""))

_UTIL = """
util AS (
  SELECT name, zone, cpu_capacity_m, mem_capacity_mi,
         CAST(round(cpu) AS BIGINT) AS cpu_used_m, CAST(round(mem) AS BIGINT) AS mem_used_mi,
         round(least(100.0, cpu / cpu_capacity_m * 100), 1) AS cpu_pct,
         round(least(100.0, mem / mem_capacity_mi * 100), 1) AS mem_pct, pods,
         CASE WHEN mem / mem_capacity_mi * 100 > 85 THEN ['Ready', 'MemoryPressure'] ELSE ['Ready'] END AS conditions
  FROM (SELECT n.name, n.zone, n.cpu_capacity_m, n.mem_capacity_mi,
               coalesce(sum(p.cpu_m), 0.0) + 350 AS cpu, coalesce(sum(p.mem_mi), 0.0) + 1200 AS mem,
               count(p.name) AS pods
        FROM v_node n LEFT JOIN v_pod p ON p.node = n.name GROUP BY ALL))"""

register("k8s_node_utilisation", lambda s, d: CL.node_utilisation(v_node(s), v_pod(s, d)).withColumn(
    "conditions", F.concat_ws(",", "conditions")),
    with_views(["v_node", "v_pod"], "SELECT * REPLACE (array_to_string(conditions, ',') AS conditions) FROM util",
               _UTIL))

register("k8s_node_bars", lambda s, d: CL.node_utilisation(v_node(s), v_pod(s, d)).select(
    "name", "cpu_pct", SR.pct_band(F.col("cpu_pct")).alias("cpu_bar"),
    "mem_pct", SR.pct_band(F.col("mem_pct")).alias("mem_bar")), with_views(["v_node", "v_pod"], """
SELECT name, cpu_pct, CASE WHEN cpu_pct >= 80 THEN 'red' WHEN cpu_pct >= 60 THEN 'amber' ELSE 'green' END AS cpu_bar,
       mem_pct, CASE WHEN mem_pct >= 80 THEN 'red' WHEN mem_pct >= 60 THEN 'amber' ELSE 'green' END AS mem_bar
FROM util""", _UTIL))

register("k8s_cluster_summary", lambda s, d: CL.cluster_summary(v_node(s), v_pod(s, d)),
         with_views(["v_node", "v_pod"], """
SELECT count(*) AS nodes_ready, count(*) AS nodes_total,
       round(sum(cpu_used_m) / sum(cpu_capacity_m) * 100, 1) AS cluster_cpu_pct,
       round(sum(mem_used_mi) / sum(mem_capacity_mi) * 100, 1) AS cluster_mem_pct,
       (SELECT CAST(sum(CASE WHEN status = 'Running' THEN 1 ELSE 0 END) AS BIGINT) FROM v_pod) AS pods_running,
       (SELECT count(*) FROM v_pod) AS pods_total,
       (SELECT CAST(coalesce(sum(restarts), 0) AS BIGINT) FROM v_pod) AS total_restarts
FROM util""", _UTIL))

register("k8s_pods_listing", lambda s, d: CL.pods_listing(v_pod(s, d), NOW), with_views(["v_pod"], f"""
SELECT deployment, name, node, status, restarts, round(cpu_m, 1) AS cpu_m, round(mem_mi, 1) AS mem_mi,
       CASE WHEN mins < 1 THEN '<1m'
            WHEN mins < 60 THEN CAST(CAST(floor(mins) AS BIGINT) AS VARCHAR) || 'm'
            ELSE CAST(CAST(floor(mins / 60) AS BIGINT) AS VARCHAR) || 'h' ||
                 CAST(CAST(floor(fmod(mins, 60)) AS BIGINT) AS VARCHAR) || 'm' END AS age
FROM (SELECT *, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_at)) / 60e6) AS mins FROM v_pod)
ORDER BY deployment, name"""))

_EVENTS = """
ev AS (SELECT CASE WHEN status = 'Pending' THEN 'Normal' ELSE 'Warning' END AS type,
              CASE WHEN status = 'CrashLoopBackOff' THEN 'BackOff' WHEN status = 'OOMKilled' THEN 'OOMKilling'
                   ELSE 'Scheduled' END AS reason,
              CASE WHEN status = 'CrashLoopBackOff'
                     THEN 'Back-off restarting failed container in pod ' || name || ' (restarts: ' || restarts || ')'
                   WHEN status = 'OOMKilled' THEN 'Memory cgroup out of memory: killed container in pod ' || name
                   ELSE 'Successfully assigned default/' || name || ' to ' || node END AS message,
              started_at AS timestamp
       FROM v_pod WHERE status IN ('CrashLoopBackOff', 'OOMKilled', 'Pending'))"""

register("k8s_events_newest", lambda s, d: CL.newest_events(CL.pod_events(v_pod(s, d)), 40),
         with_views(["v_pod"], "SELECT * FROM ev ORDER BY timestamp DESC, message LIMIT 40", _EVENTS))

register("k8s_pod_alerts", lambda s, d: CL.pod_alerts(v_pod(s, d)), with_views(["v_pod"], """
SELECT deployment AS service, 'k8s://' || node || '/' || substring(name, 1, 24) AS route,
       CAST(CASE WHEN status = 'CrashLoopBackOff' THEN 0.9 ELSE 0.85 END AS DOUBLE) AS anomaly_score, true AS is_anomaly,
       CAST(0.0 AS DOUBLE) AS duration_ms, 'k8s-' || substring(sha256(name), 1, 12) AS trace_id,
       started_at AS timestamp,
       CASE WHEN status = 'CrashLoopBackOff' THEN 'k8s_crashloop' ELSE 'k8s_oom' END AS reason,
       CASE WHEN status = 'CrashLoopBackOff' THEN 'Pod CrashLoopBackOff' ELSE 'Pod OOMKilled' END AS anomaly_type,
       name AS k8s_pod, node AS k8s_node, restarts AS k8s_restarts, deployment AS k8s_deployment
FROM v_pod WHERE status IN ('CrashLoopBackOff', 'OOMKilled')"""))
