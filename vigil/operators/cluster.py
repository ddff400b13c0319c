"""Kubernetes snapshot queries (J8, A22, A23, P17, T2, M16) over pods and nodes.

The node pool is a fixed three-row dimension and is broadcast; pods are the
scaled table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import rnd
from ..functions.constants import K8S_CPU_OVERHEAD_M, K8S_MEM_OVERHEAD_MI

# FIXED VALUES: pod alert scores per failure type (the live system draws them at random).
POD_ALERT_SCORE = {"CrashLoopBackOff": 0.9, "OOMKilled": 0.85}


def nodes_with_pods(nodes: DataFrame, pods: DataFrame) -> DataFrame:
    """Node ⟕ pods: pods look their node up in the fixed pool, nodes without pods follow."""
    p = pods.select(F.col("node").alias("_node"), "cpu_m", "mem_mi", F.col("name").alias("pod"))
    hit = p.join(F.broadcast(nodes), F.col("name") == F.col("_node")).drop("_node")
    used = pods.select(F.col("node").alias("name")).distinct()
    return hit.unionByName(nodes.join(used, "name", "left_anti"), allowMissingColumns=True)


def node_utilisation(nodes: DataFrame, pods: DataFrame) -> DataFrame:
    """used = Σ pods + overhead; percentages capped at 100; conditions; pod count."""
    used = pods.groupBy(F.col("node").alias("name")).agg(       # one row per node before the join
        F.sum("cpu_m").alias("_cpu"), F.sum("mem_mi").alias("_mem"), F.count("name").alias("_pods"))
    g = nodes.join(used, "name", "left").select(
        "name", "zone", "cpu_capacity_m", "mem_capacity_mi",
        (F.coalesce("_cpu", F.lit(0.0)) + K8S_CPU_OVERHEAD_M).alias("cpu"),
        (F.coalesce("_mem", F.lit(0.0)) + K8S_MEM_OVERHEAD_MI).alias("mem"),
        F.coalesce("_pods", F.lit(0)).alias("pods"))
    mem_pct = F.col("mem") / F.col("mem_capacity_mi") * 100
    return g.select(
        "name", "zone", "cpu_capacity_m", "mem_capacity_mi",
        rnd(F.col("cpu")).cast("long").alias("cpu_used_m"),
        rnd(F.col("mem")).cast("long").alias("mem_used_mi"),
        rnd(F.least(F.lit(100.0), F.col("cpu") / F.col("cpu_capacity_m") * 100), 1).alias("cpu_pct"),
        rnd(F.least(F.lit(100.0), mem_pct), 1).alias("mem_pct"),
        "pods",
        F.when(mem_pct > 85, F.array(F.lit("Ready"), F.lit("MemoryPressure")))
         .otherwise(F.array(F.lit("Ready"))).alias("conditions"))


def cluster_summary(nodes: DataFrame, pods: DataFrame) -> DataFrame:
    """Node and pod counts, weighted CPU / memory %, total restarts."""
    u = node_utilisation(nodes, pods)
    nodes_agg = u.agg(F.count(F.lit(1)).alias("nodes_ready"),
                      F.count(F.lit(1)).alias("nodes_total"),
                      rnd(F.sum("cpu_used_m") / F.sum("cpu_capacity_m") * 100, 1).alias("cluster_cpu_pct"),
                      rnd(F.sum("mem_used_mi") / F.sum("mem_capacity_mi") * 100, 1).alias("cluster_mem_pct"))
    p = pods.agg(F.sum(F.when(F.col("status") == "Running", 1).otherwise(0)).cast("long").alias("pods_running"),
                 F.count(F.lit(1)).alias("pods_total"),
                 F.coalesce(F.sum("restarts"), F.lit(0)).cast("long").alias("total_restarts"))
    return nodes_agg.select("*", *[p.select(c).scalar().alias(c) for c in p.columns])


def pod_age(started: F.Column, now) -> F.Column:
    """``<1m`` / ``Nm`` / ``NhMm`` of the time since start (``now`` a parameter)."""
    mins = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp"))
                                   - F.unix_micros(started.cast("timestamp"))) / 60e6)
    return (F.when(mins < 1, F.lit("<1m"))
            .when(mins < 60, F.concat(F.floor(mins).cast("string"), F.lit("m")))
            .otherwise(F.concat(F.floor(mins / 60).cast("string"), F.lit("h"),
                                F.floor(mins % 60).cast("string"), F.lit("m"))))


def pods_listing(pods: DataFrame, now) -> DataFrame:
    """Pods ordered by (deployment, name) with age text."""
    return pods.select("deployment", "name", "node", "status", "restarts",
                       rnd(F.col("cpu_m"), 1).alias("cpu_m"), rnd(F.col("mem_mi"), 1).alias("mem_mi"),
                       pod_age(F.col("started_at"), now).alias("age")).orderBy("deployment", "name")


def pod_events(pods: DataFrame) -> DataFrame:
    """K8s events derived from pod states (Warning BackOff / OOMKilling, Normal Scheduled)."""
    s = F.col("status")
    return pods.filter(s.isin("CrashLoopBackOff", "OOMKilled", "Pending")).select(
        F.when(s == "Pending", "Normal").otherwise("Warning").alias("type"),
        F.when(s == "CrashLoopBackOff", "BackOff").when(s == "OOMKilled", "OOMKilling")
         .otherwise("Scheduled").alias("reason"),
        F.when(s == "CrashLoopBackOff", F.format_string(
            "Back-off restarting failed container in pod %s (restarts: %d)", F.col("name"), F.col("restarts")))
         .when(s == "OOMKilled", F.format_string(
            "Memory cgroup out of memory: killed container in pod %s", F.col("name")))
         .otherwise(F.format_string("Successfully assigned default/%s to %s", F.col("name"), F.col("node")))
         .alias("message"),
        F.col("started_at").alias("timestamp"))


def newest_events(events: DataFrame, n: int = 40) -> DataFrame:
    """Newest 40 events."""
    return events.orderBy(F.desc("timestamp"), "message").limit(n)


def pod_alerts(pods: DataFrame) -> DataFrame:
    """CrashLoopBackOff / OOMKilled pods → alerts with the pod flags."""
    s = F.col("status")
    bad = pods.filter(s.isin(*POD_ALERT_SCORE))
    score = F.when(s == "CrashLoopBackOff", POD_ALERT_SCORE["CrashLoopBackOff"]).otherwise(
        POD_ALERT_SCORE["OOMKilled"])
    return bad.select(
        F.col("deployment").alias("service"),
        F.concat(F.lit("k8s://"), F.col("node"), F.lit("/"), F.substring("name", 1, 24)).alias("route"),
        score.alias("anomaly_score"), F.lit(True).alias("is_anomaly"), F.lit(0.0).alias("duration_ms"),
        F.concat(F.lit("k8s-"), F.substring(F.sha2(F.col("name"), 256), 1, 12)).alias("trace_id"),
        F.col("started_at").alias("timestamp"),
        F.when(s == "CrashLoopBackOff", "k8s_crashloop").otherwise("k8s_oom").alias("reason"),
        F.when(s == "CrashLoopBackOff", "Pod CrashLoopBackOff").otherwise("Pod OOMKilled").alias("anomaly_type"),
        F.col("name").alias("k8s_pod"), F.col("node").alias("k8s_node"),
        F.col("restarts").alias("k8s_restarts"), F.col("deployment").alias("k8s_deployment"))
