"""DuckDB SQL twins of the derived views, used by ``oracle_sql()``.

Each oracle statement is ``WITH <views> <body>``; only the views a body needs
are emitted.  The expressions mirror ``plans/vehicles.py`` one for one.
"""
from __future__ import annotations

from ..functions.constants import (FAILURE_REASONS, K8S_NODES, METHOD_PROVIDER, SERVICES,
                                   TXN_GATEWAYS, TXN_METHODS, TXN_TYPES)


def _lst(names):
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def _pick(names, expr):
    return f"{_lst(names)}[(({expr}) % {len(names)}) + 1]"


EPOCH_2024_US = 1704067200000000

VIEWS: dict[str, str] = {}

VIEWS["v_txn"] = f"""
v_txn AS (
  SELECT event_id AS seq,
         'TXN' || event_id AS txn_id,
         'ORD' || CAST(floor(event_id / 2) AS BIGINT) AS order_id,
         {_pick(TXN_TYPES, 'event_id')} AS txn_type,
         {_pick(TXN_METHODS, 'event_id')} AS method,
         {_pick(METHOD_PROVIDER, 'event_id')} AS provider,
         {_pick(TXN_GATEWAYS, 'user_id')} AS gateway,
         CAST(floor(value) AS DOUBLE) AS amount,
         CASE WHEN event_id % 10 < 8 THEN 'INR' ELSE 'USD' END AS currency,
         CASE WHEN event_type = 'error' THEN 'FAILED'
              WHEN event_type = 'signup' THEN 'PENDING' ELSE 'SUCCESS' END AS status,
         value * 40.0 AS latency_ms,
         CASE WHEN event_type = 'error' THEN {_pick(FAILURE_REASONS, 'event_id')} END AS failure_reason,
         'user_' || user_id AS "user",
         make_timestamp({EPOCH_2024_US} + event_id * 200000) AS ts,
         CASE WHEN event_id % 4 = 0 THEN 'live' ELSE 'sim' END AS source
  FROM events
)"""

VIEWS["v_span"] = f"""
v_span AS (
  SELECT l_orderkey AS trace_seq,
         CAST(l_orderkey AS VARCHAR) AS trace_id,
         rn,
         's' || rn AS span_id,
         CASE WHEN l_linenumber = 1 THEN '' ELSE 's' || CAST(floor(l_linenumber / 2) AS BIGINT) END AS parent_span_id,
         {_pick(SERVICES, 'l_suppkey')} AS service,
         l_returnflag || l_linestatus AS name,
         l_extendedprice / 40.0 AS duration_ms,
         make_timestamp(epoch_us(l_shipdate) + rn * 10000) AS start_time,
         CAST(CASE WHEN l_returnflag = 'R' AND rn % 5 = 0 THEN 2 ELSE 0 END AS INTEGER) AS status_code
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                   ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS rn
        FROM lineitem)
)"""

# A1 + A3 + A4: one row per trace (no window), features and primary service
VIEWS["v_trace"] = """
v_trace_svc AS (
  SELECT trace_seq, service, sum(duration_ms) AS svc_dur, min(start_time) AS first_start
  FROM v_span GROUP BY trace_seq, service
),
v_trace_primary AS (
  SELECT trace_seq, service AS primary_service FROM (
    SELECT *, row_number() OVER (PARTITION BY trace_seq ORDER BY svc_dur DESC, first_start) AS k
    FROM v_trace_svc) WHERE k = 1
),
v_trace_dangling AS (
  SELECT c.trace_seq, arg_min(c.name, epoch_us(c.start_time)) AS dangling_span
  FROM v_span c
  WHERE coalesce(c.parent_span_id, '') <> ''
    AND NOT EXISTS (SELECT 1 FROM v_span p WHERE p.trace_seq = c.trace_seq AND p.span_id = c.parent_span_id)
  GROUP BY c.trace_seq
),
v_trace AS (
  SELECT s.trace_seq, any_value(s.trace_id) AS trace_id,
         max(s.duration_ms) AS duration_ms,
         count(*) AS span_count,
         avg(CASE WHEN s.status_code NOT IN (0, 1) THEN 1.0 ELSE 0.0 END) AS error_rate,
         min(s.start_time) AS start_time,
         bool_or(s.duration_ms > 500) AS has_anomaly,
         any_value(p.primary_service) AS primary_service,
         any_value(d.dangling_span) AS dangling_span,
         list_sort(list(DISTINCT s.service)) AS services
  FROM v_span s JOIN v_trace_primary p USING (trace_seq)
       LEFT JOIN v_trace_dangling d USING (trace_seq)
  GROUP BY s.trace_seq
)"""

VIEWS["v_log_raw"] = f"""
v_log AS (
  SELECT doc_id AS seq,
         CAST(doc_id % 1000 AS VARCHAR) AS trace_id,
         'd' || doc_id AS span_id,
         source AS service_name,
         regexp_replace(
           regexp_replace(
             regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}', '[REDACTED_EMAIL]', 'g'),
             '\\b\\d{{4}}[- ]?\\d{{4}}[- ]?\\d{{4}}[- ]?\\d{{4}}\\b', '[REDACTED_CC]', 'g'),
           '"author":\\s*"[^"]*"', '"author": "[REDACTED_AUTHOR]"', 'g') AS body,
         CASE lang WHEN 'en' THEN 'INFO' WHEN 'fr' THEN 'WARN' WHEN 'de' THEN 'ERROR' ELSE 'DEBUG' END AS severity,
         make_timestamp({EPOCH_2024_US} + doc_id * 100000) AS ts
  FROM documents
)"""

VIEWS["v_metric"] = f"""
v_metric AS (
  SELECT event_id AS seq,
         {_pick(SERVICES, 'user_id')} AS service,
         CASE WHEN event_type = 'error' THEN 'redaction_count'
              WHEN event_type IN ('click', 'view') THEN 'p99_latency'
              ELSE 'throughput' END AS metric_type,
         value, ts
  FROM events
)"""

_node_rows = ", ".join(f"('{n}', '{z}', {c}, {m})" for n, z, c, m in K8S_NODES)
VIEWS["v_node"] = f"""
v_node AS (
  SELECT * FROM (VALUES {_node_rows}) AS t(name, zone, cpu_capacity_m, mem_capacity_mi)
)"""

VIEWS["v_pod"] = f"""
v_pod AS (
  SELECT {_pick(SERVICES, 's_nationkey')} || '-pod-' || s_suppkey AS name,
         {_pick(SERVICES, 's_nationkey')} AS deployment,
         {_pick([n[0] for n in K8S_NODES], 's_suppkey')} AS node,
         CASE WHEN s_suppkey % 20 = 0 THEN 'CrashLoopBackOff'
              WHEN s_suppkey % 20 = 1 THEN 'OOMKilled'
              WHEN s_suppkey % 20 = 2 THEN 'Pending' ELSE 'Running' END AS status,
         CAST(s_suppkey % 4 AS INTEGER) AS restarts,
         60.0 + abs(s_acctbal) / 50.0 AS cpu_m,
         180.0 + abs(s_acctbal) / 10.0 AS mem_mi,
         make_timestamp({EPOCH_2024_US} + s_suppkey * 60000000) AS started_at
  FROM supplier
)"""

_DEPS = {"v_trace": ["v_span"], "v_log": ["v_log_raw"]}
_ORDER = ["v_txn", "v_span", "v_trace", "v_log_raw", "v_metric", "v_node", "v_pod"]


def with_views(views: list[str], body: str, extra_ctes: str = "") -> str:
    need: list[str] = []

    def add(v):
        if v == "v_log":
            v = "v_log_raw"
        for d in _DEPS.get(v, []):
            add(d)
        if v not in need:
            need.append(v)

    for v in views:
        add(v)
    need.sort(key=_ORDER.index)
    ctes = ",\n".join(VIEWS[v].strip() for v in need)
    if extra_ctes:
        ctes = ctes + ",\n" + extra_ctes.strip() if ctes else extra_ctes.strip()
    return f"WITH {ctes}\n{body}" if ctes else body
