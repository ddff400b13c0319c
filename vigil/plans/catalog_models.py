"""Registered model queries (Spark) and their DuckDB oracles.

Refit rule, half-space trees, principal component and local outlier factor have SQL beside
them; the SVM and the isolation forest are checked against loops in the tests, so the query
of all five models is compared by rows only and the composite alerts take the other three.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.common import rnd
from ..models import ensemble as EN
from ..operators import traces as TR
from ..session import checkpoint_dir
from ..sources import otlp as OT
from ..sources.tables import table
from .catalog_traces import _ATYPE, _W1
from .materialize import materialize
from .oracle import with_views
from .registry import register
from .vehicles import v_trace

SQL_MODELS = ["hs_trees", "autoencoder_mse", "lof"]


def _baseline(s, d):
    """The parts' prices as a warm-up corpus, landed as JSON lines of which one in nine is broken or blank."""
    folder = f"{checkpoint_dir(s).rstrip('/')}/vigil-baseline/{uuid.uuid4().hex}"
    key = F.col("p_partkey")
    record = F.to_json(F.struct((F.col("p_retailprice") / 4).alias("duration_ms"), key.alias("line")))
    (table(s, d, "part").select(F.when(key % 18 == 0, "").when(key % 9 == 0, "{broken").otherwise(record).alias("value"))
     .write.text(folder))
    return OT.load_baseline(s, folder)


def _arrivals(s, d, baseline=True):
    return EN.arrivals(v_trace(s, d), baseline=_baseline(s, d) if baseline else None)


_ARRIVED = """
arrived AS (
  SELECT *, row_number() OVER w - 1 AS seen,
         coalesce(sum(normal) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS normals
  FROM (SELECT 0 AS live, p_partkey AS pos, NULL::VARCHAR AS trace_id, least(p_retailprice / 4 / 1000.0, 5.0) AS f_dur,
               CAST(1 AS DOUBLE) AS f_spans, CAST(0 AS DOUBLE) AS f_err, 1 AS normal
        FROM part WHERE p_partkey % 9 <> 0
        UNION ALL
        SELECT 1, trace_seq, trace_id, least(duration_ms / 1000.0, 5.0), CAST(span_count AS DOUBLE),
               CAST(error_rate AS DOUBLE), CASE WHEN error_rate = 0 THEN 1 ELSE 0 END FROM v_trace)
  WINDOW w AS (ORDER BY live, pos)),
learned AS (
  SELECT version, CAST(normals - 50 * version AS INTEGER) AS place, trace_id, f_dur, f_spans, f_err
  FROM (SELECT *, unnest([normals // 50, normals // 50 - 1]) AS version FROM arrived WHERE normal = 1)
  WHERE version >= 0
  QUALIFY count(*) OVER (PARTITION BY version) = 100),
asked AS (SELECT *, CASE WHEN normals >= 100 THEN (normals - 100) // 50 END AS version FROM arrived WHERE live = 1)"""

#: Without the warm-up corpus.
_ARRIVED_COLD = _ARRIVED.replace("WHERE p_partkey % 9 <> 0", "WHERE false")

_MOMENTS = """
moments AS (
  SELECT version, avg(f_dur) AS mean_dur, avg(f_spans) AS mean_spans, avg(f_err) AS mean_err,
         CASE WHEN stddev_pop(f_dur) > 0 THEN stddev_pop(f_dur) ELSE 1 END AS sd_dur,
         CASE WHEN stddev_pop(f_spans) > 0 THEN stddev_pop(f_spans) ELSE 1 END AS sd_spans,
         stddev_pop(f_dur) > 0 AS varies_dur, stddev_pop(f_spans) > 0 AS varies_spans,
         CASE WHEN stddev_pop(f_dur) > 0 AND stddev_pop(f_spans) > 0 THEN covar_pop(f_dur, f_spans) ELSE 0 END AS covariance
  FROM learned GROUP BY version),
ae AS (
  SELECT trace_id, CASE WHEN mean_dur IS NULL THEN 0.0
                        ELSE greatest(0.0, least(1.0, (z0 * z0 + z1 * z1 + z2 * z2 - a * a) / 3 / 0.1)) END AS autoencoder_mse
  FROM (SELECT *, CASE WHEN varies_dur AND varies_spans THEN (z0 + CASE WHEN covariance < 0 THEN -1 ELSE 1 END * z1) * sqrt(0.5::DOUBLE)
                       WHEN varies_dur THEN z0 WHEN varies_spans THEN z1 ELSE 0 END AS a
        FROM (SELECT trace_id, m.*, (f_dur - mean_dur) / sd_dur AS z0, (f_spans - mean_spans) / sd_spans AS z1, f_err - mean_err AS z2
              FROM asked LEFT JOIN moments m USING (version))))"""

_DISTANCE = "sqrt((a.f_dur - b.f_dur) * (a.f_dur - b.f_dur) + (a.f_spans - b.f_spans) * (a.f_spans - b.f_spans) + (a.f_err - b.f_err) * (a.f_err - b.f_err))"

_LOF = f"""
near AS (
  SELECT version, i, j, d FROM (
    SELECT a.version, a.place AS i, b.place AS j, {_DISTANCE} AS d
    FROM learned a JOIN learned b ON a.version = b.version AND a.place <> b.place)
  QUALIFY row_number() OVER (PARTITION BY version, i ORDER BY d, j) <= 20),
kd AS (SELECT version, i AS j, max(d) AS kdist FROM near GROUP BY version, i),
dens AS (
  SELECT version, i AS j, 1.0::DOUBLE / (avg(greatest(d, kdist)) + 1e-10) AS lrd
  FROM near JOIN kd USING (version, j) GROUP BY version, i),
lof AS (
  SELECT trace_id, greatest(0.0, least(1.0, avg(lrd) / (1.0::DOUBLE / (avg(greatest(d, kdist)) + 1e-10)) - 1)) AS lof
  FROM (SELECT a.trace_id, a.version, b.place AS j, {_DISTANCE} AS d
        FROM asked a JOIN learned b USING (version)
        QUALIFY row_number() OVER (PARTITION BY a.trace_id ORDER BY d, b.place) <= 20)
  JOIN kd USING (version, j) JOIN dens USING (version, j) GROUP BY trace_id)"""


def _hs_sql() -> str:
    """The seeded trees as rows, and the walk of every trace."""
    axis, place = EN.hs_shapes()
    rows = ", ".join(f"({t}, {n}, {axis[t, n]}, {float(place[t, n])!r}::DOUBLE)"
                     for t in range(axis.shape[0]) for n in range(axis.shape[1]))
    top = float(EN.HS_TREES * EN.HS_WINDOW * (2 ** (EN.HS_HEIGHT + 1) - 1))
    return f"""
shapes(tree, node, axis, place) AS (VALUES {rows}),
walk AS (
  SELECT seen // {EN.HS_WINDOW} AS win, seen, trace_id, f_dur / 5.0 AS x0, least(f_spans / {EN.HS_SPANS}, 1.0) AS x1, f_err AS x2,
         t.tree, 0 AS depth, 0 AS node
  FROM arrived, (SELECT DISTINCT tree FROM shapes) t
  UNION ALL
  SELECT win, seen, trace_id, x0, x1, x2, w.tree, depth + 1,
         2 * w.node + 1 + CASE WHEN CASE axis WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END > place THEN 1 ELSE 0 END
  FROM walk w JOIN shapes s ON s.tree = w.tree AND s.node = w.node),
masses AS (
  SELECT win, tree, node, count(*) AS mass FROM walk
  WHERE win IN (SELECT seen // {EN.HS_WINDOW} FROM arrived GROUP BY 1 HAVING count(*) = {EN.HS_WINDOW}) GROUP BY ALL),
opened AS (
  SELECT m.win + 1 AS win, m.tree, m.node, m.mass FROM masses m
  JOIN masses u ON u.win = m.win AND u.tree = m.tree AND u.node = CASE WHEN m.node = 0 THEN 0 ELSE (m.node - 1) // 2 END
  WHERE m.node = 0 OR u.mass >= {0.1 * EN.HS_WINDOW}),
hs AS (
  SELECT trace_id, least((1 - coalesce(sum(mass * pow(2.0, depth)), 0) / {top}) / 0.8, 1.0) AS hs_trees
  FROM walk LEFT JOIN opened USING (win, tree, node) WHERE trace_id IS NOT NULL GROUP BY trace_id)"""


_HS = _hs_sql()

register("ml_features", lambda s, d: EN.features(v_trace(s, d)).select("trace_id", *EN.FEATS),
         with_views(["v_trace"], """
SELECT trace_id, least(duration_ms / 1000.0, 5.0) AS f_dur, CAST(span_count AS DOUBLE) AS f_spans,
       CAST(error_rate AS DOUBLE) AS f_err FROM v_trace"""))

register("ml_training_rows", lambda s, d: EN.training_rows(_arrivals(s, d)).select(
    "version", "place", "trace_id", rnd(F.col("f_dur"), 6).alias("f_dur"), "f_spans"),
    with_views(["v_trace"], "SELECT version, place, trace_id, round(f_dur, 6) AS f_dur, f_spans FROM learned", _ARRIVED))

register("ml_training_sizes", lambda s, d: EN.training_rows(_arrivals(s, d, baseline=False)).groupBy("version").agg(
    F.count(F.lit(1)).alias("n"), F.countDistinct("trace_id").alias("traces")), with_views(["v_trace"], """
SELECT version, count(*) AS n, count(DISTINCT trace_seq) AS traces
FROM (SELECT trace_seq, unnest([r // 50, r // 50 - 1]) AS version
      FROM (SELECT trace_seq, row_number() OVER (ORDER BY trace_seq) - 1 AS r FROM v_trace WHERE error_rate = 0))
WHERE version >= 0 GROUP BY version HAVING count(*) = 100"""))

register("ml_versions_in_force", lambda s, d: _arrivals(s, d).filter("trace_id is not null").select(
    "trace_id", EN.version_in_force(F.col("normals")).alias("version")),
    with_views(["v_trace"], "SELECT trace_id, version FROM asked", _ARRIVED))

register("ml_moments", lambda s, d: EN.moments(EN.training_rows(_arrivals(s, d))).select(
    "version", *[rnd(F.col(f"{m}_{c}"), 6).alias(f"{m}_{c[2:]}") for m in ("mean", "sd") for c in EN.FEATS[:2]],
    rnd(F.col("covariance"), 6).alias("covariance")), with_views(["v_trace"], """
SELECT version, round(mean_dur, 6) AS mean_dur, round(mean_spans, 6) AS mean_spans, round(sd_dur, 6) AS sd_dur,
       round(sd_spans, 6) AS sd_spans, round(covariance, 6) AS covariance FROM moments""", _ARRIVED + "," + _MOMENTS))


def _scores(s, d, models):
    t = v_trace(s, d, materialized=True)
    return t, materialize(EN.ensemble_scores(t, baseline=_baseline(s, d), models=models), "model-scores")


register("ml_hs_masses", lambda s, d: EN.hs_masses(EN.hs_nodes(_arrivals(s, d))),
         with_views(["v_trace"], "SELECT * FROM masses", _ARRIVED + "," + _HS))

for _name, _sql in (("hs_trees", _ARRIVED + "," + _HS + ", found AS (SELECT * FROM hs)"),
                    ("autoencoder_mse", _ARRIVED + "," + _MOMENTS + ", found AS (SELECT * FROM ae)"),
                    ("lof", _ARRIVED + "," + _LOF + ", found AS (SELECT trace_id, coalesce(lof, 0.0) AS lof FROM asked LEFT JOIN lof USING (trace_id))")):
    register(f"ml_{_name}_scores", lambda s, d, m=_name: _scores(s, d, [m])[1].select(
        "trace_id", rnd(F.col(m), 6).alias(m)),
        with_views(["v_trace"], f"SELECT trace_id, round({_name}, 6) AS {_name} FROM found", _sql))


def _voted(s, d, models):
    t, scores = _scores(s, d, models)
    return t, EN.soft_vote(scores, t, models)


register("ml_ensemble_scores", lambda s, d: _voted(s, d, EN.MODELS)[1].drop("per_model"))


def _composite(s, d):
    t, votes = _voted(s, d, SQL_MODELS)
    rv = TR.rule_verdicts(t, materialize_input=False).join(
        votes.select("trace_id", "aggregate_score", "ml_anomaly", "per_model"), "trace_id")
    comp = TR.composite(rv, ml_score=F.col("aggregate_score"),
                        ml_reasons=F.when(F.col("ml_anomaly"), F.array(F.lit("ml_ensemble")))
                        .otherwise(F.array().cast("array<string>")),
                        per_model=F.col("per_model"))
    return comp.filter("is_anomaly").select(
        "trace_id", "primary_service", rnd(F.col("score"), 6).alias("score"), F.concat_ws(",", "reasons").alias("reasons"),
        TR.classify(F.col("reasons"), F.col("per_model")).alias("anomaly_type"))


register("ml_composite_alerts", _composite, with_views(["v_trace"], f"""
SELECT trace_id, primary_service, round(greatest(rule, aggregate), 6) AS score, array_to_string(reasons, ',') AS reasons,
       CASE WHEN len(list_filter(reasons, lambda x: x <> 'ml_ensemble')) > 0 THEN {_ATYPE}
            WHEN lof > 0.8 THEN 'Statistical Outlier (LOF)' WHEN hs_trees > 0.8 THEN 'Statistical Outlier (HS-Trees)'
            WHEN autoencoder_mse > 0.8 THEN 'Reconstruction Anomaly (Autoencoder)' ELSE 'ML Ensemble Anomaly' END AS anomaly_type
FROM (SELECT trace_id, primary_service, hs_trees, autoencoder_mse, lof, aggregate,
             CASE WHEN len(reasons) > 0 THEN 1.0 ELSE 0.0 END AS rule,
             CASE WHEN aggregate > 0.5 THEN list_append(reasons, 'ml_ensemble') ELSE reasons END AS reasons
      FROM (SELECT rv.*, hs_trees, autoencoder_mse, coalesce(lof, 0.0) AS lof,
                   least(0.6 * ((0.0 + hs_trees + autoencoder_mse + coalesce(lof, 0.0)) / 3) + 0.4 *
                     greatest(CASE WHEN duration_ms > 1000 THEN 0.8 ELSE 0.0 END, CASE WHEN span_count > 30 THEN 0.9 ELSE 0.0 END,
                              CASE WHEN error_rate > 0.1 THEN 0.95 ELSE 0.0 END), 1.0) AS aggregate
            FROM rv JOIN hs USING (trace_id) JOIN ae USING (trace_id) LEFT JOIN lof USING (trace_id)))
WHERE len(reasons) > 0""", _ARRIVED + "," + _MOMENTS + "," + _LOF + "," + _HS + "," + _W1))
