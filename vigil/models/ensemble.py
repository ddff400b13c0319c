"""Anomaly models over trace features as Spark aggregates.

Traces are scored in arrival order, each before it is learned from.

* M8, refit rule: normal traces (error rate 0) fill a buffer; 100 of them make a version of
  the batch models and the newest 50 stay.  So version v is trained on the normal traces
  50 v … 50 v + 99, and a trace meets the version that the normal traces before it have
  completed.  Positions come from one range-partitioned order, a version's rows are a
  group of 100, and versions are rows of a model table: nothing is sequential.
* M3, half-space trees: 25 trees of seeded shape (a fixed table, no data in it).  A trace
  keeps its leaf of each tree, which names all its nodes; groups of whole windows of 100
  traces count masses, with the window before them beside them for the scores.
* M6, autoencoder as one principal component: mean, deviation and correlation per version
  are aggregates; training rows have no errors, so the component lies in the plane of
  duration and span count and has a closed form.
* M7, local outlier factor, 20 neighbours: k-distances and densities of a version's 100
  rows; a trace is compared with these 100.
* M5, one-class SVM: random Fourier features and subgradient steps over the version's rows.
* M4, isolation forest: a trace is isolated from the version's rows; every tree cuts the
  rows that are still with it at a place drawn by hash, so trees need no table.

M4, M5 and M7 are columns beside a version's row, computed in Arrow batches.

The soft vote (M9) takes the models that are asked for; an untrained one counts as 0.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from ..plans.ordered import range_rank

BUFFER, KEPT = 100, 50
HS_WINDOW, HS_TREES, HS_HEIGHT, HS_SEED = 100, 25, 8, 42
HS_GROUP = 50              # windows that are counted together
HS_SPANS = 32.0            # span counts from here on lie at the edge of the half-space trees' unit cube
IF_TREES, IF_HEIGHT = 25, 7
LOF_K = 20
SVM_FEATURES, SVM_STEPS, SVM_NU, SVM_RATE, SVM_SEED = 32, 30, 0.1, 0.05, 7
FEATS = ["f_dur", "f_spans", "f_err"]
MODELS = ["hs_trees", "isolation_forest", "one_class_svm", "autoencoder_mse", "lof"]


def features(traces: DataFrame) -> DataFrame:
    """Duration capped at 5 s (in seconds), span count, error rate."""
    return traces.withColumn("f_dur", F.least(F.col("duration_ms") / 1000.0, F.lit(5.0))) \
                 .withColumn("f_spans", F.col("span_count").cast("double")) \
                 .withColumn("f_err", F.col("error_rate").cast("double"))


# ---- arrival order, training rows, versions (M8, S6) ------------------------------------

def arrivals(traces: DataFrame, order: str = "trace_seq", baseline: DataFrame | None = None) -> DataFrame:
    """trace_id, the features, ``seen`` and ``normals``: traces and normal traces before each, in ``order``.

    Rows of the warm-up ``baseline`` (S6: duration_ms, span_count, error_rate, line) come first, in the
    order of their lines, without a trace id.
    """
    rows = features(traces).select("trace_id", F.col(order).alias("_at"), F.lit(1).alias("_live"), *FEATS)
    if baseline is not None:
        warm = features(baseline).select(F.lit(None).cast("string").alias("trace_id"),
                                         F.coalesce("line", F.monotonically_increasing_id()).alias("_at"), F.lit(0).alias("_live"), *FEATS)
        rows = rows.unionByName(warm)
    rows = rows.withColumn("_normal", (F.col("f_err") == 0).cast("int"))
    ranked = range_rank(rows, ["_live", "_at"], flags=["_normal"])
    return ranked.select("trace_id", *FEATS, F.col("_normal").alias("normal"), F.col("_pos").alias("seen"),
                         F.col("_fpos__normal").alias("normals"))


def training_rows(arrived: DataFrame) -> DataFrame:
    """M8: version, place (0 to 99), trace_id and features of the rows that each complete version learns.

    A normal trace is in at most two buffers; the last version may still be filling and is left out.
    """
    v = F.floor(F.col("normals") / KEPT)
    rows = (arrived.filter("normal = 1")
            .withColumn("version", F.explode(F.array(v, v - 1))).filter("version >= 0")
            .withColumn("place", (F.col("normals") - F.col("version") * KEPT).cast("int")))
    return (rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("version"))).filter(F.col("_n") == BUFFER)
            .select("version", "place", "trace_id", *FEATS))


def version_in_force(normals: Column) -> Column:
    """The version that so many normal traces have completed; null before the first."""
    return F.when(normals >= BUFFER, F.floor((normals - BUFFER) / KEPT))


def moments(training: DataFrame) -> DataFrame:
    """M6: mean and deviation of the features and correlation of duration and span count, per version.

    A feature that does not vary has deviation 1; the correlation is then 0.
    """
    def sd(c):
        return F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)

    both = (F.stddev_pop("f_dur") > 0) & (F.stddev_pop("f_spans") > 0)
    return training.groupBy("version").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in FEATS], *[sd(c).alias(f"sd_{c}") for c in FEATS],
        (F.stddev_pop("f_dur") > 0).alias("varies_dur"), (F.stddev_pop("f_spans") > 0).alias("varies_spans"),
        F.when(both, F.covar_pop("f_dur", "f_spans")).otherwise(0.0).alias("covariance"))


def reconstruction_error() -> Column:
    """M6: mean squared distance of a trace from its version's first principal component.

    Of two varying features the standardised component is (1, ±1) / √2 with the sign of their
    covariance, of one it is that feature's axis; the error rate never varies in training rows.
    """
    z = [(F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in FEATS]
    sign = F.when(F.col("covariance") < 0, -1.0).otherwise(1.0)
    along = (F.when(F.col("varies_dur") & F.col("varies_spans"), (z[0] + sign * z[1]) * F.lit(math.sqrt(0.5)))
             .when(F.col("varies_dur"), z[0]).when(F.col("varies_spans"), z[1]).otherwise(0.0))
    return (z[0] * z[0] + z[1] * z[1] + z[2] * z[2] - along * along) / 3.0


# ---- models of a version's points, in Arrow batches (M4, M5, M7) ---------------------------

def _grid(points: pa.Array) -> np.ndarray:
    """The points of the rows that have a version, by row, place and feature."""
    axes = points.flatten().flatten()
    return np.stack([a.to_numpy(zero_copy_only=False) for a in axes], -1).reshape(-1, BUFFER, len(FEATS))


def _table(values: pa.Array, width: int) -> np.ndarray:
    """Arrays of ``width`` values as the rows of a matrix, null arrays left out."""
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _traces(of: np.ndarray, *features: pa.Array) -> np.ndarray:
    return np.stack([f.to_numpy(zero_copy_only=False) for f in features], -1)[of]


def _having(values: pa.Array) -> np.ndarray:
    return values.is_valid().to_numpy(zero_copy_only=False)


def _placed(values: np.ndarray, of: np.ndarray) -> pa.Array:
    """``values`` at the rows ``of``, null elsewhere."""
    out = np.zeros(len(of))
    out[of] = values
    return pa.array(out, mask=~of)


def _lists(values: np.ndarray) -> pa.Array:
    """A matrix as one array per row."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))


def _mean(values: np.ndarray) -> np.ndarray:
    """Mean along the last axis, summed from the left."""
    return np.cumsum(values, axis=-1)[..., -1] / values.shape[-1]


def _distances(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    d = points - at
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])


def _nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and place of the LOF_K nearest points, by distance then place."""
    near = np.argsort(distances, axis=-1, kind="stable")[..., :LOF_K]
    return np.take_along_axis(distances, near, -1), near


def _density(near: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """1 / mean reachability distance from the ``near`` points, whose k-distances are ``reach``."""
    return 1.0 / (_mean(np.maximum(near, reach)) + 1e-10)


def with_densities(models: DataFrame) -> DataFrame:
    """M7: k-distance and local density of each of a version's ``points``."""
    @F.arrow_udf("struct<kdist: array<double>, lrd: array<double>>")
    def densities(points: pa.Array) -> pa.Array:
        kdist, lrd = [np.zeros((0, BUFFER))], [np.zeros((0, BUFFER))]
        for own in _grid(points):
            d = _distances(own[None], own[:, None])
            np.fill_diagonal(d, np.inf)
            near, at = _nearest(d)
            kdist.append(near[None, :, -1])
            lrd.append(_density(near, near[at, -1])[None])
        return pa.StructArray.from_arrays([_lists(np.concatenate(kdist)), _lists(np.concatenate(lrd))], ["kdist", "lrd"])

    return models.withColumn("_d", densities("points")).select("*", "_d.kdist", "_d.lrd").drop("_d")


def outlier_factor() -> Column:
    """M7: mean density of a trace's neighbours among its version's points over its own density."""
    @F.arrow_udf("double")
    def factor(points: pa.Array, kdist: pa.Array, lrd: pa.Array, dur: pa.Array, spans: pa.Array, err: pa.Array) -> pa.Array:
        of = _having(points)
        near, at = _nearest(_distances(_grid(points), _traces(of, dur, spans, err)[:, None]))
        own = _density(near, np.take_along_axis(_table(kdist, BUFFER), at, -1))
        return _placed(_mean(np.take_along_axis(_table(lrd, BUFFER), at, -1)) / own, of)

    return factor("points", "kdist", "lrd", *FEATS)


def svm_directions() -> tuple[np.ndarray, np.ndarray]:
    """Seeded directions and phases of the Fourier features."""
    rng = np.random.default_rng(SVM_SEED)
    return rng.normal(size=(SVM_FEATURES, 3)), rng.uniform(0, 2 * math.pi, SVM_FEATURES)


def _phi(points: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Fourier features of points for the kernel exp(-gamma d²)."""
    w, b = svm_directions()
    return math.sqrt(2.0 / SVM_FEATURES) * np.cos(np.sqrt(2 * gamma)[..., None] * (points @ w.T) + b)


def with_boundary(models: DataFrame) -> DataFrame:
    """M5: kernel width ``gamma`` (scale rule), weights and offset of a one-class SVM on ``points``.

    Each step lowers 0.5 |w|² - rho + mean(max(0, rho - w·phi)) / nu by its subgradient, whose
    sum goes over the version's violating rows.
    """
    @F.arrow_udf("struct<gamma: double, w: array<double>, rho: double>")
    def fitted(points: pa.Array) -> pa.Array:
        gammas, weights, offsets = [], [np.zeros((0, SVM_FEATURES))], []
        share = SVM_NU * BUFFER
        for own in _grid(points):
            flat = own.reshape(-1)
            spread = _mean((flat - _mean(flat)) ** 2)
            gammas.append(1.0 / (3 * (spread if spread > 0 else 1.0)))
            phis = _phi(own, np.full(BUFFER, gammas[-1]))
            w, rho = np.zeros(SVM_FEATURES), 0.0
            for _ in range(SVM_STEPS):
                out = phis @ w < rho
                w, rho = (w - SVM_RATE * (w - out.astype(float) @ phis / share), rho - SVM_RATE * (out.sum() / share - 1.0))
            weights.append(w[None])
            offsets.append(rho)
        return pa.StructArray.from_arrays([pa.array(gammas, pa.float64()), _lists(np.concatenate(weights)),
                                           pa.array(offsets, pa.float64())], ["gamma", "w", "rho"])

    return models.withColumn("svm", fitted("points"))


def outside_boundary() -> Column:
    """M5: how far a trace lies outside its version's boundary; negative inside."""
    @F.arrow_udf("double")
    def outside(gamma: pa.Array, weights: pa.Array, rho: pa.Array, dur: pa.Array, spans: pa.Array, err: pa.Array) -> pa.Array:
        of = _having(weights)
        gamma, rho = (x.to_numpy(zero_copy_only=False)[of] for x in (gamma, rho))
        phis = _phi(_traces(of, dur, spans, err), gamma)
        return _placed(rho - (phis * _table(weights, SVM_FEATURES)).sum(axis=-1), of)

    return outside("svm.gamma", "svm.w", "svm.rho", *FEATS)


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 2:
        return max(0.0, n - 1.0)
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def _hashed(seed: np.ndarray, value: np.ndarray, wide: bool) -> np.ndarray:
    """One step of ``F.xxhash64`` over whole numbers: ``wide`` ones are long, others int."""
    p1, p2, p3, p4, p5 = _PRIMES
    if wide:
        h = _rotated((seed + p5 + np.uint64(8)) ^ (_rotated(value * p2, 31) * p1), 27) * p1 + p4
    else:
        h = _rotated((seed + p5 + np.uint64(4)) ^ (value * p1), 23) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def isolation_draws(version: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """M4: axis and share of the cut at each of ``nodes`` of each tree of each version, drawn by hash."""
    trees = np.arange(1, IF_TREES + 1, dtype=np.uint64)
    drawn = []
    for k in (0, 1):
        h = _hashed(np.full(1, 42, np.uint64), np.full(1, k, np.uint64), False)
        h = _hashed(h, version.astype(np.int64).view(np.uint64)[:, None, None], True)
        h = _hashed(h, trees[:, None], False)
        drawn.append(_hashed(h, nodes.astype(np.uint64), True) & np.uint64((1 << 30) - 1))
    return (drawn[0] % np.uint64(3)).astype(int), drawn[1] / float(1 << 30)


def isolation_trees(version: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """M4: (axis, cut, size) by version, tree and node; children of node i are 2 i and 2 i + 1 (below the cut).

    A cut through points that are all in one place keeps them all on both sides.
    """
    shape = (len(version), IF_TREES, 1 << (IF_HEIGHT + 1))
    axis, cut, size = np.zeros(shape, np.int8), np.zeros(shape), np.zeros(shape, np.int16)
    here = np.ones((len(version), IF_TREES, 1, BUFFER), bool)
    by_axis, who = points.transpose(0, 2, 1), np.arange(len(version))[:, None, None]
    for level in range(IF_HEIGHT + 1):
        nodes = np.arange(1 << level, 2 << level)
        size[:, :, nodes] = here.sum(axis=-1)
        if level == IF_HEIGHT:
            return axis, cut, size
        own, share = isolation_draws(version, nodes)
        v = by_axis[who, own]
        low, high = np.where(here, v, np.inf).min(axis=-1), np.where(here, v, -np.inf).max(axis=-1)
        some = size[:, :, nodes] > 0
        at = np.where(some, low, 0.0) + np.where(some, high - low, 0.0) * share
        axis[:, :, nodes], cut[:, :, nodes] = own, at
        below, flat = v < at[..., None], ~(high > low)[..., None]
        here = np.stack([here & (~below | flat), here & (below | flat)], axis=3).reshape(*shape[:2], 2 << level, BUFFER)


def isolation() -> Column:
    """M4: isolation score of a trace among its version's points, in (0, 1].

    A tree keeps the points on the trace's side of cuts at a feature and place drawn by hash
    from the version, the tree and the path so far, until at most one is left.  Traces of a
    version that are in one batch share its trees.
    """
    @F.arrow_udf("double")
    def depth(version: pa.Array, points: pa.Array, dur: pa.Array, spans: pa.Array, err: pa.Array) -> pa.Array:
        of = _having(points)
        grid, at = _grid(points), _traces(of, dur, spans, err)
        own, first, which = np.unique(version.to_numpy(zero_copy_only=False)[of], return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable")
        ends, found = np.searchsorted(which[order], np.arange(len(own) + 1)), np.zeros(len(at))
        paths, tree = np.array([_average_path(n) for n in range(BUFFER + 1)]), np.arange(IF_TREES)
        for a in range(0, len(own), 8):               # some versions at a time
            b = min(a + 8, len(own))
            axis, cut, size = isolation_trees(own[a:b], grid[first[a:b]])
            rows = order[ends[a]:ends[b]]
            u, x = which[rows][:, None] - a, at[rows]
            node, steps = np.ones((len(rows), IF_TREES), int), np.zeros((len(rows), IF_TREES))
            for _ in range(IF_HEIGHT):
                more = size[u, tree, node] > 1
                below = np.take_along_axis(x, axis[u, tree, node].astype(int), 1) < cut[u, tree, node]
                node, steps = np.where(more, 2 * node + below, node), steps + more
            found[rows] = _mean(steps + paths[size[u, tree, node]])
        return _placed(found, of)

    n = float(BUFFER)
    return F.pow(F.lit(2.0), -depth("version", "points", *FEATS) / (2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n))


def versions(training: DataFrame, models: list[str] | None = None) -> DataFrame:
    """M8: the model table, one row per version; only what ``models`` need."""
    models = MODELS if models is None else models
    points = F.transform(F.array_sort(F.collect_list(F.struct("place", *FEATS))), lambda x: F.struct(*[x[c].alias(c) for c in FEATS]))
    out = training.groupBy("version").agg(points.alias("points")).join(moments(training), "version")
    if "lof" in models:
        out = with_densities(out)
    if "one_class_svm" in models:
        out = with_boundary(out)
    return out


# ---- half-space trees (M3) ----------------------------------------------------------------

def hs_shapes() -> tuple[np.ndarray, np.ndarray]:
    """Feature and place of the cut at each inner node of each tree, seeded; children of i are 2 i + 1 and 2 i + 2."""
    rng = np.random.default_rng(HS_SEED)
    inner = 2 ** HS_HEIGHT - 1
    axis, place = rng.integers(0, 3, (HS_TREES, inner)), rng.uniform(size=(HS_TREES, inner))
    low, high = np.zeros((HS_TREES, 2 * inner + 1, 3)), np.ones((HS_TREES, 2 * inner + 1, 3))
    tree = np.arange(HS_TREES)
    for i in range(inner):
        d = axis[:, i]
        place[:, i] = low[tree, i, d] + place[:, i] * (high[tree, i, d] - low[tree, i, d])
        for child in (2 * i + 1, 2 * i + 2):
            low[:, child], high[:, child] = low[:, i], high[:, i]
        high[tree, 2 * i + 1, d] = place[:, i]
        low[tree, 2 * i + 2, d] = place[:, i]
    return axis, place


def hs_nodes(arrived: DataFrame) -> DataFrame:
    """``win``, seen, trace_id and ``leaves``: the leaf of each tree that a trace falls into, which names
    all nodes that it passes (``hs_path``)."""
    axis, place = hs_shapes()

    @F.arrow_udf("array<smallint>")
    def leaves(*features: pa.Array) -> pa.Array:
        x, tree = np.stack([f.to_numpy(zero_copy_only=False) for f in features], -1), np.arange(HS_TREES)
        node = np.zeros((len(x), HS_TREES), int)
        for _ in range(HS_HEIGHT):
            node = 2 * node + 1 + (np.take_along_axis(x, axis[tree, node], 1) > place[tree, node])
        return _lists(node.astype(np.int16))

    cube = [F.col("f_dur") / 5.0, F.least(F.col("f_spans") / HS_SPANS, F.lit(1.0)), F.col("f_err")]
    return arrived.select(F.floor(F.col("seen") / HS_WINDOW).alias("win"), "seen", "trace_id", leaves(*cube).alias("leaves"))


def hs_path(leaves: np.ndarray, depth: int) -> np.ndarray:
    """The nodes at ``depth`` on the way to ``leaves``."""
    return (leaves + 1 >> HS_HEIGHT - depth) - 1


def _hs_counted(win: np.ndarray, leaves: np.ndarray) -> tuple[int, np.ndarray]:
    """(first window, mass by window, tree and node); windows that are not whole have none."""
    first, nodes = int(win.min()), 2 ** (HS_HEIGHT + 1) - 1
    span = int(win.max()) - first + 1
    rows = (win - first)[:, None] * HS_TREES + np.arange(HS_TREES)
    mass = sum(np.bincount((rows * nodes + hs_path(leaves, d)).ravel(), minlength=span * HS_TREES * nodes)
               for d in range(HS_HEIGHT + 1)).reshape(span, HS_TREES, nodes)
    mass[mass[:, 0, 0] != HS_WINDOW] = 0
    return first, mass


def _hs_group() -> Column:
    return F.floor(F.col("win") / HS_GROUP)


def hs_masses(nodes: DataFrame) -> DataFrame:
    """win, tree, node, mass: traces of each whole window through each node."""
    def counted(table: pa.Table) -> pa.Table:
        first, mass = _hs_counted(table["win"].to_numpy(), _table(table["leaves"].combine_chunks(), HS_TREES).astype(int))
        win, tree, node = np.nonzero(mass)
        return pa.table({"win": win + first, "tree": tree.astype(np.int32), "node": node.astype(np.int32), "mass": mass[win, tree, node]})

    return (nodes.select(_hs_group().alias("_group"), "win", "leaves").groupBy("_group")
            .applyInArrow(counted, "win long, tree int, node int, mass long"))


def hs_scores(arrived: DataFrame) -> DataFrame:
    """M3: trace_id and ``hs_trees``: 1 - mass · 2^depth down to the first node of little mass, scaled.

    The masses are those of the window before; without one the score is 1.  A group's last
    window goes into the next group too, where it is only counted.
    """
    def scored(table: pa.Table) -> pa.Table:
        win, leaves = table["win"].to_numpy(), _table(table["leaves"].combine_chunks(), HS_TREES).astype(int)
        first, mass = _hs_counted(win, leaves)
        own = table["own"].to_numpy()
        before, tree = (win[own] - first - 1)[:, None], np.arange(HS_TREES)
        known, at = before >= 0, np.maximum(before, 0)
        total, over = np.zeros(len(before)), None
        for d in range(HS_HEIGHT + 1):
            here = np.where(known, mass[at, tree, hs_path(leaves[own], d)], 0)
            total += np.where(over >= 0.1 * HS_WINDOW if d else True, here, 0).sum(axis=1) * 2.0 ** d
            over = here
        return pa.table({"trace_id": table["trace_id"].filter(table["own"]), "total": total})

    last = F.col("win") % HS_GROUP == HS_GROUP - 1
    groups = F.when(last, F.array(_hs_group(), _hs_group() + 1)).otherwise(F.array(_hs_group()))
    rows = hs_nodes(arrived).select(F.explode(groups).alias("_group"), "win", "trace_id", "leaves")
    found = (rows.withColumn("own", F.col("_group") == _hs_group()).groupBy("_group")
             .applyInArrow(scored, "trace_id string, total double"))
    top = float(HS_TREES * HS_WINDOW * (2 ** (HS_HEIGHT + 1) - 1))
    return (found.filter("trace_id is not null").groupBy("trace_id")
            .agg(F.least((1.0 - F.sum("total") / top) / 0.8, F.lit(1.0)).alias("hs_trees")))


# ---- scores and vote ------------------------------------------------------------------------

def _between(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def batch_scores() -> dict[str, Column]:
    """M4–M7 of a trace beside its version's row, normalised as the monitored system does."""
    return {"isolation_forest": _between((isolation() + 0.5) / 0.5),
            "one_class_svm": _between((outside_boundary() + 10.0) / 20.0),
            "autoencoder_mse": _between(reconstruction_error() / 0.1),
            "lof": _between(outlier_factor() - 1.0)}


def ensemble_scores(traces: DataFrame, order: str = "trace_seq", baseline: DataFrame | None = None,
                    models: list[str] | None = None) -> DataFrame:
    """trace_id, version in force and the score of each model; 0 for a batch model without a version."""
    models = MODELS if models is None else models
    arrived = arrivals(traces, order, baseline)
    table = materialize(versions(training_rows(arrived), models), "model-versions")
    rows = arrived.filter("trace_id is not null").withColumn("version", version_in_force(F.col("normals")))
    batch = {m: c for m, c in batch_scores().items() if m in models}
    out = rows.join(table, "version", "left").select("trace_id", "version", *[
        F.when(F.col("points").isNull(), 0.0).otherwise(c).alias(m) for m, c in batch.items()])
    if "hs_trees" in models:
        out = out.join(hs_scores(arrived), "trace_id")
    return out.select("trace_id", "version", *models)


def soft_vote(scores: DataFrame, traces: DataFrame, models: list[str] | None = None) -> DataFrame:
    """M9 (+M2, A25): aggregate = min(0.6·mean(models) + 0.4·bounds, 1);
    anomaly when strictly above 0.5."""
    from ..operators.traces import bound_score
    models = MODELS if models is None else models
    t = traces.select("trace_id", bound_score(F.col("duration_ms"), F.col("span_count"),
                                              F.col("error_rate")).alias("bound"))
    j = scores.join(t, "trace_id")
    ml_avg = sum((F.col(m) for m in models), F.lit(0.0)) / float(len(models))
    agg = F.least(F.lit(0.6) * ml_avg + F.lit(0.4) * F.col("bound"), F.lit(1.0))
    per_model = F.create_map(*[x for m in models for x in (F.lit(m), F.col(m))])
    return j.select(
        "trace_id", "version", *models, "bound", per_model.alias("per_model"),
        (F.aggregate(F.map_values(per_model), F.lit(0.0), lambda a, v: a + v)
         / F.size(per_model)).alias("ensemble_avg"),
        agg.alias("aggregate_score"), (agg > 0.5).alias("ml_anomaly"))
