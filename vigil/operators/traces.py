"""Trace reconstruction, features and trace rule detectors.

A1–A10, J2, J3, J7, W1, W2, W13, W14, P3, P8, P20, S8, T3, M1, M2, M10–M13.

Span order inside a trace is (start_time, span_id).  Trace arrival order is a
caller-given sequence column (``trace_seq``); the per-service rolling
detectors (N+1 and bimodal latency) run in that order inside (service, block)
partitions, so one hot service is never a single task:

* N+1 needs (n, Σx, Σx²) of all earlier traces of the service — a prefix sum
  over (service, coarse block) totals plus a running sum inside the block;
* bimodal latency is an EWMA, folded inside (service, block).  What a block makes of
  any state before it is a fixed polynomial in that state, so each block is summed up
  on its own, the summaries are composed in block order and every block then starts
  from its exact state.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import known, rnd, safe_div
from ..functions.constants import (BIMODAL_LAMBDA, BIMODAL_MEAN_MIN_MS, BIMODAL_STD_MS,
                                   BIMODAL_WARMUP, N_PLUS_1_FLOOR, N_PLUS_1_K, N_PLUS_1_WARMUP,
                                   SPAN_SLOW_MS)
from ..plans.ordered import key_rank

COARSE_TRACES = 5_000_000
BLOCK_TRACES = 200_000
LIST_PARTS = 16

SPAN_FIELDS = ["start_time", "span_id", "name", "service", "duration_ms", "trace_id",
               "parent_span_id", "status_code", "is_anomaly"]


def span_flags(spans: DataFrame) -> DataFrame:
    """P3 slow flag (> 500 ms, strict) and P20 span kind; root parent normalised."""
    return spans.select(
        "*",
        (F.col("duration_ms") > SPAN_SLOW_MS).alias("is_anomaly"),
        F.when(F.col("service") == "api-gateway", "API")
         .when(F.lower(F.col("name")).contains("db"), "DATABASE").otherwise("SERVICE").alias("kind"))


def dangling_spans(spans: DataFrame, key: str = "trace_id", extra: list[str] | None = None) -> DataFrame:
    """J2 table form: spans whose (non-empty) parent is not a span of the same
    trace (and of the same ``extra`` group, e.g. the window)."""
    extra = extra or []
    parents = spans.select(F.col(key).alias("_k"), F.col("span_id").alias("_p"),
                           *[F.col(c).alias("_x" + str(i)) for i, c in enumerate(extra)])
    child = spans.filter(F.coalesce(F.col("parent_span_id"), F.lit("")) != "")
    cond = (child[key] == parents["_k"]) & (child["parent_span_id"] == parents["_p"])
    for i, c in enumerate(extra):
        cond = cond & (child[c] == parents["_x" + str(i)])
    return child.join(parents, cond, "left_anti")


def dependency_edges(spans: DataFrame, key: str = "trace_id", cap: int = 15) -> DataFrame:
    """Parent → child edges inside a trace (first ``cap`` children by span order)."""
    p = spans.select(F.col(key).alias("_k"), F.col("span_id").alias("parent_id"),
                     F.col("service").alias("parent_service"))
    e = spans.join(p, (spans[key] == p["_k"]) & (spans["parent_span_id"] == p["parent_id"]))
    from ..plans.ordered import top_n_per_key
    first = top_n_per_key(e, [key], [F.col("start_time"), F.col("span_id")], cap, split_col="span_id")
    return first.select(key, "parent_id", F.col("span_id").alias("child_id"), "parent_service",
                        F.col("service").alias("child_service"), F.col("name").alias("child_name"),
                        F.col("rank").alias("edge_no"))


def build_traces(spans: DataFrame, key: str = "trace_id", carry: tuple[str, ...] = (),
                 window_s: int | None = None, max_spans: int = 20) -> DataFrame:
    """A1 + A3 + A4 + A5 + J2: one row per trace (or per (window, trace)).

    One pass over the spans: each stands for itself and once more for the parent that it
    names.  Spans that are already dealt by a part of the key (``v_span`` is) are not shuffled
    again, and what a caller does not read is not computed.  Every part is bounded whatever
    the size of a trace:
    * features: a two-level algebraic fold, (trace, service) partials then the
      trace — partial aggregation before any shuffle;
    * ``spans``: the alert's list, the first ``max_spans`` spans in (start_time,
      span_id) order, out of the first ones of each of ``LIST_PARTS`` parts of a trace;
      all spans stay as rows (``trace_spans``); ``route`` is the first one's name;
    * dangling parent: the first span by order whose parent's id is no span of the trace.
    """
    s = span_flags(spans) if "is_anomaly" not in spans.columns else spans
    gkeys = [key, *carry]
    if window_s:
        s = s.withColumn("window", F.window("start_time", f"{window_s} seconds"))
        gkeys = ["window", *gkeys]
    s = s.dropna(subset=gkeys)  # a span without a key is in no trace
    names = F.coalesce(F.col("parent_span_id"), F.lit("")) != ""
    s = s.withColumn("_own", F.explode(F.when(names, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    own = F.col("_own")
    s = s.withColumn("_id", F.when(own, F.col("span_id")).otherwise(F.col("parent_span_id")))
    s = s.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(LIST_PARTS)))
    held = Window.partitionBy(*gkeys, "_part", "_id")
    first = Window.partitionBy(*gkeys, "_part").orderBy(F.desc("_own"), "start_time", "span_id")
    s = s.withColumn("_rank", F.row_number().over(first)).withColumn("_is_span", F.max("_own").over(held))
    span_struct = F.struct(*[F.col(c) for c in SPAN_FIELDS])
    per_svc = s.groupBy(*gkeys, "service").agg(
        F.sum(F.when(own, F.col("duration_ms"))).alias("_sd"), F.min("start_time").alias("_first"),
        F.max("duration_ms").alias("_mx"), F.count_if(own).alias("_n"),
        F.sum(F.when(own & ~F.col("status_code").isin(0, 1), 1).otherwise(0)).alias("_err"),
        F.max(F.col("is_anomaly").cast("int")).alias("_slow"),
        F.collect_list(F.when(own & (F.col("_rank") <= max_spans), span_struct)).alias("_list"),
        F.min(F.struct("start_time", "span_id", "name")).alias("_head"),
        F.min(F.when(~own & ~F.col("_is_span"), F.struct("start_time", "span_id", "name"))).alias("_dangling"))
    return per_svc.groupBy(*gkeys).agg(
        F.max("_mx").alias("duration_ms"),
        F.sum("_n").cast("long").alias("span_count"),
        (F.sum("_err") / F.sum("_n")).alias("error_rate"),
        F.min("_first").alias("start_time"),
        (F.max("_slow") > 0).alias("has_anomaly"),
        F.array_sort(F.collect_list("service")).alias("services"),
        F.min_by("service", F.struct((-F.col("_sd")).alias("a"), F.col("_first").alias("b")))
        .alias("primary_service"),
        F.slice(F.array_sort(F.flatten(F.collect_list("_list"))), 1, max_spans).alias("spans"),
        F.min("_dangling")["name"].alias("dangling_span"),
        F.min("_head")["name"].alias("route"))


def merge_partial_traces(parts: DataFrame, key: str = "trace_id", max_spans: int = 20) -> DataFrame:
    """A2: merge (window, trace) partials into one trace: max / sum / or / min.

    The alert's list is the first ``max_spans`` spans of all partials, ranked as rows, so
    that a trace with very many windows is never gathered whole."""
    from ..plans.ordered import top_n_per_key
    totals = parts.groupBy(key).agg(
        F.max("duration_ms").alias("duration_ms"),
        F.sum("span_count").cast("long").alias("span_count"),
        F.max(F.col("has_anomaly").cast("int")).cast("boolean").alias("has_anomaly"),
        F.min("start_time").alias("start_time"))
    first = top_n_per_key(parts.select(key, F.explode("spans").alias("_s")), [key], [F.col("_s")], max_spans)
    return totals.join(first.groupBy(key).agg(F.array_sort(F.collect_list("_s")).alias("spans")), key, "left")


# ---- per-service rolling detectors ------------------------------------------

def n_plus_1(traces: DataFrame, order: str = "trace_seq", key: str = "primary_service",
             coarse: int | None = None, before: DataFrame | None = None) -> DataFrame:
    """Before the update, n ≥ 10, span_count ≥ 10 and span_count > mean + 3σ
    (sample σ over all earlier traces of the service; σ = 0 when n ≤ 1).  Span counts are
    whole numbers, so the sums and the variance's numerator are exact.  ``before`` holds
    (key, n, s1, s2) of traces that came earlier still (``span_totals``)."""
    cw = coarse or COARSE_TRACES
    x = F.col("span_count").cast("long")
    d = known(traces, key).withColumn("_cb", F.floor(F.col(order) / cw))
    tot = d.groupBy(key, "_cb").agg(F.count(F.lit(1)).alias("_bn"), F.sum(x).alias("_bs"),
                                     F.sum(x * x).alias("_bq"))
    if before is not None:
        tot = tot.unionByName(before.select(key, F.lit(-(1 << 62)).alias("_cb"), F.col("n").alias("_bn"),
                                            F.col("s1").alias("_bs"), F.col("s2").alias("_bq")))
    wp = Window.partitionBy(key).orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    pre = tot.select(key, "_cb", *[F.coalesce(F.sum(c).over(wp), F.lit(0)).alias(c + "0")
                                   for c in ("_bn", "_bs", "_bq")])
    wl = Window.partitionBy(key, "_cb").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    loc = d.select("*", F.coalesce(F.count(F.lit(1)).over(wl), F.lit(0)).alias("_ln"),
                   F.coalesce(F.sum(x).over(wl), F.lit(0)).alias("_ls"),
                   F.coalesce(F.sum(x * x).over(wl), F.lit(0)).alias("_lq"))
    j = loc.join(pre, [key, "_cb"])
    n = F.col("_bn0") + F.col("_ln")
    s1 = F.col("_bs0") + F.col("_ls")
    s2 = F.col("_bq0") + F.col("_lq")
    mean = safe_div(s1.cast("double"), n.cast("double"))
    whole = [c.cast("decimal(19,0)") for c in (n, s1, s2)]
    spread = (whole[0] * whole[2] - whole[1] * whole[1]).cast("double")
    var = F.when(n > 1, spread / (n.cast("double") * (n - 1))).otherwise(F.lit(0.0))
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    fire = (n >= N_PLUS_1_WARMUP) & (F.col("span_count") >= N_PLUS_1_FLOOR) & (x > mean + N_PLUS_1_K * std)
    return j.withColumn("n_plus_1", fire).drop(
        "_cb", "_ln", "_ls", "_lq", "_bn0", "_bs0", "_bq0")


def span_totals(traces: DataFrame, key: str = "primary_service", before: DataFrame | None = None) -> DataFrame:
    """(key, n, s1, s2): number of traces, sum and sum of squares of their span counts."""
    x = F.col("span_count").cast("long")
    rows = traces.select(key, F.lit(1).cast("long").alias("n"), x.alias("s1"), (x * x).alias("s2"))
    rows = rows if before is None else rows.unionByName(before.select(key, "n", "s1", "s2"))
    return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])


def _ewma_blocks(traces: DataFrame, order: str, key: str, block_rows: int | None, coarse: int | None) -> DataFrame:
    """key, order, duration_ms, the rank ``_kr`` in the key and its block ``blk``."""
    r = key_rank(known(traces, key), [key], order, F.floor(F.col(order) / (coarse or COARSE_TRACES)), out="_kr")
    return r.withColumn("blk", F.floor((F.col("_kr") - 1) / (block_rows or BLOCK_TRACES)))


def _ewma_summaries(rows: DataFrame, key: str) -> DataFrame:
    """(key, blk, n, first, m, v, s) of each block started from its own first latency.

    ``m`` and ``v`` are mean and variance behind the block, ``s`` is the sum of the
    differences from the mean before each row.
    """
    lam, rest = BIMODAL_LAMBDA, 1.0 - BIMODAL_LAMBDA

    def fold(batches):
        import pandas as pd
        cur, out = None, []
        n = first = m = v = s = 0.0
        for pdf in batches:
            for g, x in zip(zip(pdf[key].tolist(), pdf["blk"].tolist()), pdf["duration_ms"].tolist()):
                if g != cur:
                    if cur is not None:
                        out.append((*cur, n, first, m, v, s))
                    cur, n, first, m, v, s = g, 0, x, x, 0.0, 0.0
                d = x - m
                n, s, v, m = n + 1, s + d, lam * (d * d) + rest * v, m + lam * d
        if cur is not None:
            out.append((*cur, n, first, m, v, s))
        yield pd.DataFrame(out, columns=[key, "blk", "n", "first", "m", "v", "s"])

    slim = rows.select(key, "blk", "_kr", "duration_ms").repartition(key, "blk").sortWithinPartitions(key, "blk", "_kr")
    return slim.mapInPandas(fold, f"{key} string, blk long, n long, first double, m double, v double, s double")


def ewma_after(state: tuple[float, float] | None, n: int, first: float, m: float, v: float, s: float) -> tuple[float, float]:
    """State (mean, variance) behind a block that starts from ``state``, given its summary.

    With e = mean before - first, every mean of the block is off by e times a power of
    1 - lambda, so mean and variance behind it are polynomials in e.
    """
    if state is None:
        return m, v
    e = state[0] - first
    last, whole = (1.0 - BIMODAL_LAMBDA) ** (n - 1), (1.0 - BIMODAL_LAMBDA) ** n
    if e * e + state[1] + v == float("inf"):  # beyond doubles, and never back
        return m + whole * e, float("inf")
    return m + whole * e, (whole * state[1] + v - 2.0 * BIMODAL_LAMBDA * e * last * s
                           + e * e * (last * (1.0 - whole)))


def _ewma_starts(summaries: DataFrame, key: str, before: DataFrame | None) -> DataFrame:
    """(key, blk, _m, _v): the state in front of each block, composed in block order.

    The summaries are a row per block; ``before`` (key, m, v) is the state in front of block 0.
    """
    def fold(batches):
        import pandas as pd
        cur, state, out = None, None, []
        for pdf in batches:
            for k, blk, n, first, m, v, s in zip(*[pdf[c].tolist() for c in (key, "blk", "n", "first", "m", "v", "s")]):
                if k != cur:
                    cur, state = k, None
                state = (m, v) if blk < 0 else ewma_after(state, n, first, m, v, s)
                out.append((k, blk + 1, *state))
        yield pd.DataFrame(out, columns=[key, "blk", "_m", "_v"])

    if before is not None:
        summaries = summaries.unionByName(before.select(
            key, F.lit(-1).cast("long").alias("blk"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("first"),
            "m", "v", F.lit(0.0).alias("s")))
    return (summaries.repartition(key).sortWithinPartitions(key, "blk")
            .mapInPandas(fold, f"{key} string, blk long, _m double, _v double"))


def ewma_state(traces: DataFrame, order: str = "trace_seq", key: str = "primary_service",
               block_rows: int | None = None, coarse: int | None = None, before: DataFrame | None = None) -> DataFrame:
    """(key, n, m, v): number of traces and EWMA state behind them and those ``before``."""
    rows = _ewma_blocks(traces.select(key, order, "duration_ms"), order, key, block_rows, coarse)
    starts = _ewma_starts(_ewma_summaries(rows, key), key, before)
    last = starts.groupBy(key).agg(F.max_by(F.struct("_m", "_v"), "blk").alias("_s"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if before is not None:
        counts = counts.unionByName(before.select(key, "n")).groupBy(key).agg(F.sum("n").alias("n"))
    return last.join(counts, key).select(key, "n", F.col("_s._m").alias("m"), F.col("_s._v").alias("v"))


def _ewma_fold(key: str):
    """mapInPandas body: EWMA per (key, blk) over rows sorted by rank.

    Emits for every row the state *before* its update.  A block's seed row (rank 0) holds
    the state that the block starts from; without one its first row starts it.
    """
    lam = BIMODAL_LAMBDA
    keep = 1.0 - BIMODAL_LAMBDA

    def fold(batches):
        cur = None
        m = v = 0.0
        seeded = False
        for pdf in batches:
            if pdf.empty:
                continue
            ks, bs, rs = pdf[key].tolist(), pdf["blk"].tolist(), pdf["_kr"].tolist()
            xs, m0, v0 = pdf["duration_ms"].tolist(), pdf["_m"].tolist(), pdf["_v"].tolist()
            om, ov, osd = [], [], []
            for i in range(len(pdf)):
                g = (ks[i], bs[i])
                if g != cur:
                    cur, m, v, seeded = g, 0.0, 0.0, False
                if not rs[i]:
                    m, v, seeded = m0[i], v0[i], True
                om.append(m if seeded else None)
                ov.append(v if seeded else None)
                osd.append(seeded)
                x = xs[i]
                if not rs[i]:
                    continue
                if not seeded:
                    m, v, seeded = x, 0.0, True
                else:
                    d = x - m
                    v = lam * (d * d) + keep * v
                    m = m + lam * d
            out = pdf.assign(_m=om, _v=ov, _seeded=osd)
            yield out[out["_kr"] > 0]
    return fold


def bimodal(traces: DataFrame, order: str = "trace_seq", key: str = "primary_service",
            block_rows: int | None = None, coarse: int | None = None, before: DataFrame | None = None) -> DataFrame:
    """EWMA λ = 0.2 per service; fire when (state before update) n ≥ 10,
    σ > 500, mean > 200 and duration > mean + σ.  ``latency_variance`` is the
    variance before the update (rounded to 6 places).

    The fold is sequential inside (service, block); each block starts from the state that
    the blocks before it compose to (``_ewma_starts``), so only blocks with one behind them
    are summed up.  ``before`` holds (key, n, m, v) of traces that came earlier still
    (``ewma_state``).
    """
    rows = _ewma_blocks(traces, order, key, block_rows, coarse)
    counts = known(traces, key).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    last = counts.select(key, F.floor((F.col("_n") - 1) / (block_rows or BLOCK_TRACES)).alias("_last")).filter("_last > 0")
    starts = _ewma_starts(_ewma_summaries(rows.join(last, key).filter(F.col("blk") < F.col("_last")), key), key, before)
    d = (rows.withColumn("_m", F.lit(None).cast("double")).withColumn("_v", F.lit(None).cast("double"))
         .unionByName(starts.withColumn("_kr", F.lit(0).cast("long")), allowMissingColumns=True))
    schema = T.StructType(d.schema.fields + [T.StructField("_seeded", T.BooleanType())])
    d = d.repartition(key, "blk").sortWithinPartitions(key, "blk", "_kr").mapInPandas(_ewma_fold(key), schema)
    n = F.col("_kr") - 1
    if before is not None:
        d = d.join(before.select(key, F.col("n").alias("_before")), key, "left")
        n = n + F.coalesce("_before", F.lit(0))
    mean = F.col("_m")
    var = F.col("_v")
    std = F.when(var > 0, F.sqrt(var)).otherwise(F.lit(0.0))
    fire = ((n >= BIMODAL_WARMUP) & F.col("_seeded") & (std > BIMODAL_STD_MS)
            & (mean > BIMODAL_MEAN_MIN_MS) & (F.col("duration_ms") > mean + std))
    return (d.withColumn("bimodal_latency", F.coalesce(fire, F.lit(False)))
            .withColumn("latency_variance", rnd(F.coalesce(var, F.lit(0.0)), 6))
            .drop("_m", "_v", "_seeded", "_kr", "blk", "_before"))


def rule_verdicts(traces: DataFrame, order: str = "trace_seq", key: str = "trace_id",
                  materialize_input: bool = True, **kw) -> DataFrame:
    """M1: N+1, bimodal and dangling parent; score 1.0 when any reason.

    Both rolling detectors read only (key, order, service, feature) columns of
    the trace table, in two passes each, and are joined back on the trace key;
    the trace table is therefore written once to the checkpoint folder first.
    """
    if materialize_input:
        from ..plans.materialize import materialize
        traces = materialize(traces, "traces")
    cols = [key, order, "primary_service", "span_count", "duration_ms"]
    slim = traces.select(*cols)
    f1 = n_plus_1(slim, order, coarse=kw.get("coarse")).select(key, "n_plus_1")
    f2 = bimodal(slim, order, **kw).select(key, "bimodal_latency", "latency_variance")
    return verdicts(traces.join(f1, key).join(f2, key))


def verdicts(t: DataFrame) -> DataFrame:
    """M1: reasons, score and anomaly flag from the three rule columns."""
    reasons = F.array_compact(F.array(
        F.when(F.col("n_plus_1"), F.lit("n_plus_1")),
        F.when(F.col("bimodal_latency"), F.lit("bimodal_latency")),
        F.when(F.col("dangling_span").isNotNull(), F.lit("dangling_parent"))))
    return (t.withColumn("reasons", reasons)
            .withColumn("rule_score", F.when(F.size("reasons") > 0, 1.0).otherwise(0.0))
            .withColumn("is_anomaly", F.size("reasons") > 0))


def bound_score(duration: Column, span_count: Column, error_rate: Column) -> Column:
    """M2 deterministic bounds: >1000 ms → .8, >30 spans → .9, error rate > .1 → .95."""
    return F.greatest(F.when(duration > 1000, 0.8).otherwise(0.0),
                      F.when(span_count > 30, 0.9).otherwise(0.0),
                      F.when(error_rate > 0.1, 0.95).otherwise(0.0))


def composite(rule: DataFrame, ml_score: Column | None = None, ml_reasons: Column | None = None,
              per_model: Column | None = None) -> DataFrame:
    """Max score, concatenated reasons, merged model map; anomaly = any reason."""
    ml_score = ml_score if ml_score is not None else F.lit(0.0)
    ml_reasons = ml_reasons if ml_reasons is not None else F.array().cast("array<string>")
    per_model = per_model if per_model is not None else F.create_map().cast("map<string,double>")
    reasons = F.concat(F.col("reasons"), ml_reasons)
    return (rule.withColumn("score", F.greatest(F.col("rule_score"), ml_score))
            .withColumn("reasons", reasons)
            .withColumn("per_model", per_model)
            .withColumn("is_anomaly", F.size(reasons) > 0))


def classify(reasons: Column, per_model: Column) -> Column:
    """Dominant anomaly type (rules outrank models)."""
    def has(r):
        return F.array_contains(reasons, r)

    def pm(k):
        return F.coalesce(F.element_at(per_model, k), F.lit(0.0)) > 0.8
    return (F.when(has("n_plus_1"), "N+1 Query Regression")
            .when(has("bimodal_latency"), "Bimodal Latency")
            .when(has("dangling_parent"), "Dependency Chain Break")
            .when(has("pii_redaction_density"), "PII Redaction Density")
            .when(pm("lof"), "Statistical Outlier (LOF)")
            .when(pm("hs_trees"), "Statistical Outlier (HS-Trees)")
            .when(pm("isolation_forest"), "Statistical Outlier (Isolation Forest)")
            .when(pm("autoencoder_mse"), "Reconstruction Anomaly (Autoencoder)")
            .when(pm("one_class_svm"), "Boundary Anomaly (SVM)")
            .when(has("ml_ensemble"), "ML Ensemble Anomaly")
            .otherwise("Unclassified Anomaly"))


def rule_flags(df: DataFrame) -> Column:
    """The eight fixed rule-flag keys."""
    return F.struct(
        F.col("n_plus_1").alias("n_plus_1"),
        F.when(F.col("n_plus_1"), F.col("span_count")).otherwise(0).cast("int").alias("n_plus_1_count"),
        F.col("bimodal_latency").alias("bimodal_latency"),
        F.when(F.col("bimodal_latency"), F.col("latency_variance")).otherwise(0.0).alias("latency_variance"),
        F.col("dangling_span").isNotNull().alias("dependency_break"),
        F.col("dangling_span").alias("dangling_span"),
        F.lit(False).alias("pii_density"), F.lit(0.0).alias("redaction_ratio"))


def trace_alerts(verdicts: DataFrame, max_spans: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """One enriched alert per anomalous trace (route = first span's name)."""
    v = verdicts if "per_model" in verdicts.columns else composite(verdicts)
    a = v.filter(F.col("is_anomaly"))
    return a.select(
        F.col("primary_service").alias("service"),
        "route" if "route" in v.columns else F.element_at("spans", 1)["name"].alias("route"),
        F.col("score").alias("anomaly_score"), F.col("is_anomaly"),
        "duration_ms", "trace_id", F.col("start_time").alias("timestamp"),
        F.slice("spans", 1, max_spans).alias("spans"), "reasons",
        F.col("per_model").alias("ml_scores"), rule_flags(a).alias("rule_flags"),
        classify(F.col("reasons"), F.col("per_model")).alias("anomaly_type"),
        *[c for c in ("trace_seq",) if c in v.columns], *keep)


def trace_counters(verdicts: DataFrame) -> DataFrame:
    """+1 total (and +1 anomalous) per service appearing in each trace."""
    e = verdicts.select(F.explode("services").alias("service"), "is_anomaly")
    return e.groupBy("service").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("is_anomaly"), 1).otherwise(0)).cast("long").alias("anomalous"))


def trace_stats(counters: DataFrame, service: str | None = None) -> DataFrame:
    """A9 + A10: totals over one service or all (sum over services), error rate %."""
    c = counters if service in (None, "All Services") else counters.filter(F.col("service") == service)
    a = c.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total_traces"),
              F.coalesce(F.sum("anomalous"), F.lit(0)).cast("long").alias("anomaly_count"))
    return a.withColumn("error_rate_pct", rnd(safe_div(F.col("anomaly_count") * 100.0,
                                                       F.col("total_traces")), 2))


def service_window_metrics(spans: DataFrame, window_s: int = 10) -> DataFrame:
    """A6 + A7: span count and p99 per (window, trace, service).

    p99 index = max(0, int(n·0.99) − 1) of the sorted durations: the row with that
    rank, so no list of durations is gathered.
    """
    group = ["window_start", "trace_id", "service"]
    s = spans.select(F.window("start_time", f"{window_s} seconds")["start"].alias("window_start"),
                     "trace_id", "service", F.col("duration_ms").alias("p99_latency"))
    w = Window.partitionBy(*group)
    r = s.select("*", F.count(F.lit(1)).over(w).alias("_n"),
                 F.row_number().over(w.orderBy("p99_latency")).alias("_r"))
    pick = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(0.99)))
    return r.filter(F.col("_r") == pick).select(*group, F.col("_n").cast("double").alias("throughput"), "p99_latency")


def waterfall(spans: DataFrame, key: str = "trace_id", min_width: float = 4.0) -> DataFrame:
    """Offset from the trace start; left % and width % of the trace duration."""
    per = spans.groupBy(key).agg(F.min(F.unix_micros("start_time")).alias("_t0"),
                                 F.max("duration_ms").alias("_total"))     # partial aggregation
    t0, total = F.col("_t0"), F.col("_total")
    off = (F.unix_micros("start_time") - t0) / 1000.0
    return spans.join(per, key).select(
        key, "span_id", "name", "service", "start_time", "duration_ms",
        off.alias("offset_ms"),
        rnd(safe_div(off * 100.0, total), 4).alias("left_pct"),
        rnd(safe_div(F.col("duration_ms") * 100.0, total), 4).alias("width_pct"),
        rnd(F.greatest(F.lit(min_width), safe_div(F.col("duration_ms") * 100.0, total)), 4)
        .alias("width_pct_compact"))


def anomaly_rate_history(verdicts: DataFrame, order: str = "trace_seq", last: int = 30,
                         key: str = "primary_service") -> DataFrame:
    """Running anomalous / total ratio per service, last ``last`` points.

    Running values at the newest points follow from the service totals minus
    what comes after each point, so only the newest ``last`` rows per service
    are ranked (split top-N kernel).
    """
    from ..plans.ordered import top_n_per_key
    d = verdicts.select(key, order, F.col("is_anomaly").cast("int").alias("_a"))
    tot = d.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum("_a").alias("_na"))
    t = top_n_per_key(d, [key], [F.desc(order)], last, split_col=order).join(tot, key)
    after = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    j = t.withColumn("_later_a", F.coalesce(F.sum("_a").over(after), F.lit(0)))
    total = F.col("_n") - F.col("rank") + 1
    anomalous = F.col("_na") - F.col("_later_a")
    return j.select(key, order, total.alias("total"), anomalous.cast("long").alias("anomalous"),
                    rnd(anomalous * 100.0 / total, 4).alias("error_rate_pct"))


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keyed replace — the last write per key wins (``max_by`` aggregate with
    partial aggregation, so a key written very often is not one task)."""
    others = [c for c in df.columns if c != key]
    latest = df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_row"))
    return latest.select(key, *[F.col("_row")[c].alias(c) for c in others])


def trace_lookup(traces: DataFrame, trace_id: str) -> DataFrame:
    """Point lookup (pushed into the scan where the key is a column)."""
    return traces.filter(F.col("trace_id") == trace_id)


def trace_spans(spans: DataFrame, key: str = "trace_id") -> DataFrame:
    """A1: all spans of every trace as rows, numbered from 1 in (start_time, span_id) order."""
    w = Window.partitionBy(key).orderBy("start_time", "span_id")
    return spans.withColumn("position", F.row_number().over(w))


def alert_with_stored_trace(alerts: DataFrame, stored_spans: DataFrame) -> DataFrame:
    """The spans behind each alert as rows (trace_id, span_id, duration_ms, stored).

    All stored spans of the alert's trace, whatever their number; an alert whose trace
    is not in the store falls back to its own first spans.
    """
    a = alerts.select("trace_id", "spans")
    hit = stored_spans.join(a.select("trace_id"), "trace_id", "left_semi").select(
        "trace_id", "span_id", "duration_ms", F.lit(True).alias("stored"))
    own = (a.join(stored_spans.select("trace_id").distinct(), "trace_id", "left_anti")
           .select("trace_id", F.explode("spans").alias("s"))
           .select("trace_id", "s.span_id", "s.duration_ms", F.lit(False).alias("stored")))
    return hit.unionByName(own)
