"""Models against loops: refit rule, half-space trees, component, outlier factor, SVM, isolation forest."""
from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from vigil.models import ensemble as EN

SCHEMA = "trace_id string, trace_seq long, duration_ms double, span_count long, error_rate double"


def sample(n, seed, odd=()):
    rnd = random.Random(seed)
    rows = [(f"t{i}", i * 3, rnd.choice([rnd.gauss(200, 20), rnd.gauss(900, 100), 200.0]), rnd.randint(3, 5),
             0.0 if rnd.random() < 0.7 else 0.25) for i in range(n)]
    return rows + [(f"odd{k}", 3 * n + k, *o) for k, o in enumerate(odd)]


def vec(r):
    return [min(r[2] / 1000.0, 5.0), float(r[3]), float(r[4])]


def refits(rows, warm=()):
    """(training rows of each version, version in force per row) by filling the buffer row by row."""
    buffer, trained, force = [], [], []
    for r in [*warm, *rows]:
        force.append(len(trained) - 1 if trained else None)
        if r[4] == 0:
            buffer.append(r)
            if len(buffer) >= 100:
                trained.append(list(buffer))
                buffer = buffer[50:]
    return trained, force[len(warm):]


def test_refit_rule_and_warm_up(spark):
    rows = sample(420, 1)
    warm = [(None, None, 10.0 * i, 1, 0.0) for i in range(130)]
    df = spark.createDataFrame(rows, SCHEMA)
    base = spark.createDataFrame([(w[2], 1, 0.0, i) for i, w in enumerate(warm)],
                                 "duration_ms double, span_count long, error_rate double, line long")
    for before, baseline in (([], None), (warm, base)):
        arrived = EN.arrivals(df.repartition(5), baseline=baseline)
        trained, force = refits(rows, before)
        got = {}
        for r in EN.training_rows(arrived).collect():
            got.setdefault(r["version"], {})[r["place"]] = (r["trace_id"], r["f_dur"])
        assert len(trained) > 3
        assert got == {v: {p: (r[0], vec(r)[0]) for p, r in enumerate(own)} for v, own in enumerate(trained)}
        version = {r["trace_id"]: r["v"] for r in arrived.filter("trace_id is not null").select(
            "trace_id", EN.version_in_force(F.col("normals")).alias("v")).collect()}
        assert version == {r[0]: v for r, v in zip(rows, force)}


def walk(x, axis, place):
    node, out = 0, [0]
    for _ in range(EN.HS_HEIGHT):
        node = 2 * node + 1 + int(x[axis[node]] > place[node])
        out.append(node)
    return out


def test_half_space_trees_match_loop(spark):
    rows = sample(330, 2)
    got = {r["trace_id"]: r["hs_trees"] for r in
           EN.hs_scores(EN.arrivals(spark.createDataFrame(rows, SCHEMA))).collect()}
    axis, place = EN.hs_shapes()
    cube = [[v[0] / 5, min(v[1] / EN.HS_SPANS, 1.0), v[2]] for v in map(vec, rows)]
    top = EN.HS_TREES * EN.HS_WINDOW * (2 ** (EN.HS_HEIGHT + 1) - 1)
    for i, r in enumerate(rows):
        w = i // 100 - 1
        score = 0.0
        for t in range(EN.HS_TREES):
            paths = [walk(x, axis[t], place[t]) for x in cube[100 * w:100 * w + 100]] if w >= 0 else []
            for depth, node in enumerate(walk(cube[i], axis[t], place[t])):
                mass = sum(p[depth] == node for p in paths)
                score += mass * 2.0 ** depth
                if mass < 10:
                    break
        assert math.isclose(got[r[0]], min((1 - score / top) / 0.8, 1.0), rel_tol=1e-9), r[0]


def component_error(train, x):
    mean, sd = train.mean(axis=0), train.std(axis=0)
    sd[sd < 1e-12] = 1.0
    values, vectors = np.linalg.eigh(np.cov(((train - mean) / sd).T))
    z = (x - mean) / sd
    along = z @ vectors[:, -1] if values[-1] > 1e-12 else 0.0
    return ((z ** 2).sum() - along ** 2) / 3


def test_reconstruction_error_is_that_of_the_first_component(spark):
    for seed, fix in ((3, None), (4, "dur"), (5, "spans")):
        rows = [(i, s, 200.0 if fix == "dur" else d, 4 if fix == "spans" else n, e) for i, s, d, n, e in sample(300, seed)]
        arrived = EN.arrivals(spark.createDataFrame(rows, SCHEMA))
        table = EN.versions(EN.training_rows(arrived), ["autoencoder_mse"])
        got = {r["trace_id"]: r["e"] for r in arrived.withColumn("version", EN.version_in_force(F.col("normals")))
               .join(table, "version").select("trace_id", EN.reconstruction_error().alias("e")).collect()}
        trained, force = refits(rows)
        for r, v in zip(rows, force):
            if v is not None:
                want = component_error(np.array([vec(x) for x in trained[v]]), np.array(vec(r)))
                assert math.isclose(got[r[0]], want, rel_tol=1e-6, abs_tol=1e-9)


def outlier_factor(train, x):
    k = EN.LOF_K

    def nearest(p, own=None):
        return sorted((float(np.sqrt(((p - q) ** 2).sum())), j) for j, q in enumerate(train) if j != own)[:k]

    near = [nearest(p, i) for i, p in enumerate(train)]
    kdist = [n[-1][0] for n in near]
    density = lambda n: 1 / (np.mean([max(d, kdist[j]) for d, j in n]) + 1e-10)
    lrd = [density(n) for n in near]
    own = nearest(x)
    return np.mean([lrd[j] for _, j in own]) / density(own)


def svm_fit(train):
    w0, b = EN.svm_directions()
    gamma = 1 / (3 * (train.var() or 1.0))
    phi = lambda x: math.sqrt(2 / EN.SVM_FEATURES) * np.cos(math.sqrt(2 * gamma) * (x @ w0.T) + b)
    w, rho, share = np.zeros(EN.SVM_FEATURES), 0.0, EN.SVM_NU * EN.BUFFER
    for _ in range(EN.SVM_STEPS):
        out = [p for p in phi(train) if p @ w < rho]
        w, rho = (w - EN.SVM_RATE * (w - (sum(out) if out else 0.0) / share), rho - EN.SVM_RATE * (len(out) / share - 1))
    return lambda x: rho - phi(x) @ w


def test_outlier_factor_and_boundary_match_loops(spark):
    rows = sample(260, 6, odd=[(4800.0, 40, 0.5), (200.0, 4, 0.0)])
    arrived = EN.arrivals(spark.createDataFrame(rows, SCHEMA))
    table = EN.versions(EN.training_rows(arrived), ["lof", "one_class_svm"])
    got = {r["trace_id"]: r for r in arrived.withColumn("version", EN.version_in_force(F.col("normals"))).join(table, "version")
           .select("trace_id", EN.outlier_factor().alias("lof"), EN.outside_boundary().alias("svm")).collect()}
    trained, force = refits(rows)
    fits = [svm_fit(np.array([vec(x) for x in own])) for own in trained]
    for r, v in list(zip(rows, force))[::7] + list(zip(rows, force))[-2:]:
        if v is not None:
            train = np.array([vec(x) for x in trained[v]])
            assert math.isclose(got[r[0]]["lof"], outlier_factor(train, np.array(vec(r))), rel_tol=1e-6)
            assert math.isclose(got[r[0]]["svm"], fits[v](np.array(vec(r))), rel_tol=1e-6, abs_tol=1e-9)


def test_planted_outlier_ranks_first(spark):
    rows = sample(300, 7, odd=[(4800.0, 40, 0.5)])
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["trace_id"]: r for r in EN.soft_vote(EN.ensemble_scores(df), df).collect()}
    assert len(got) == len(rows)
    for r in got.values():
        assert all(0.0 <= r[m] <= 1.0 for m in EN.MODELS) and 0.0 <= r["aggregate_score"] <= 1.0
    assert got["odd0"]["ml_anomaly"] and got["odd0"]["version"] is not None
    for m in ("lof", "autoencoder_mse", "one_class_svm", "hs_trees"):
        assert got["odd0"][m] >= max(r[m] for r in got.values() if r["version"] is not None)


def test_isolation_scores_spread(spark):
    rows = sample(300, 8, odd=[(4800.0, 40, 0.5)])
    arrived = EN.arrivals(spark.createDataFrame(rows, SCHEMA))
    table = EN.versions(EN.training_rows(arrived), ["isolation_forest"])
    scored = arrived.withColumn("version", EN.version_in_force(F.col("normals"))).join(table, "version").select(
        "trace_id", EN.isolation().alias("s"))
    got = {r["trace_id"]: r["s"] for r in scored.collect()}
    assert got == {r["trace_id"]: r["s"] for r in scored.collect()}
    assert 0.0 < min(got.values()) < max(got.values()) <= 1.0
    assert got["odd0"] >= sorted(got.values())[-5]


def test_cold_start_cannot_fire(spark):
    rows = [(f"t{i}", i, 2000.0, 3, 0.5) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    sc = EN.soft_vote(EN.ensemble_scores(df), df)
    r = sc.agg(F.max("aggregate_score").alias("m"), F.max(F.col("ml_anomaly").cast("int")).alias("a")).first()
    assert abs(r["m"] - 0.5) < 1e-9 and r["a"] == 0
    assert EN.ensemble_scores(df.limit(0)).collect() == []


def test_half_space_windows_in_groups(spark, monkeypatch):
    """One row per trace before masses are counted; the same scores and masses in groups of any size."""
    rows = sample(730, 9)
    arrived = EN.arrivals(spark.createDataFrame(rows, SCHEMA))
    assert EN.hs_nodes(arrived).count() == len(rows)

    def found():
        return (sorted(map(tuple, EN.hs_masses(EN.hs_nodes(arrived)).collect())),
                {r["trace_id"]: r["hs_trees"] for r in EN.hs_scores(arrived).collect()})

    masses, scores = found()
    axis, place = EN.hs_shapes()
    want = {}
    for i, v in enumerate(map(vec, rows[:700])):
        for t in range(EN.HS_TREES):
            for node in walk([v[0] / 5, min(v[1] / EN.HS_SPANS, 1.0), v[2]], axis[t], place[t]):
                want[i // 100, t, node] = want.get((i // 100, t, node), 0) + 1
    assert {m[:3]: m[3] for m in masses} == want and len(masses) == len(want)
    for size in (1, 3):
        monkeypatch.setattr(EN, "HS_GROUP", size)
        assert found() == (masses, scores)


def test_isolation_trees_are_drawn_by_spark_hash_and_match_loop(spark):
    versions = np.array([0, 3, 1 << 40])
    nodes = np.arange(1, 128)
    axis, share = EN.isolation_draws(versions, nodes)
    keys = [(int(v), t, int(n)) for v in versions for t in range(1, EN.IF_TREES + 1) for n in nodes]
    h = [F.pmod(F.xxhash64(F.lit(k), "version", "tree", "node"), F.lit(1 << 30)) for k in (0, 1)]
    drawn = {tuple(r)[:3]: tuple(r)[3:] for r in spark.createDataFrame(keys, "version long, tree int, node long").select(
        "*", h[0] % 3, h[1] / float(1 << 30)).collect()}
    assert [drawn[k] for k in keys] == list(zip(axis.ravel().tolist(), share.ravel().tolist()))
    rnd = np.random.default_rng(5)
    points = np.stack([rnd.choice([0.2, 0.9, 1.4], (3, 100)), rnd.integers(3, 6, (3, 100)).astype(float), np.zeros((3, 100))], -1)
    axes, cuts, sizes = EN.isolation_trees(versions, points)
    for v in range(3):
        for t in (0, 24):
            held = {1: points[v]}
            for n in range(1, 128):
                own, a = held[n], axis[v, t, n - 1]
                if len(own):
                    low, high = own[:, a].min(), own[:, a].max()
                    at = low + (high - low) * share[v, t, n - 1]
                    assert axes[v, t, n] == a and cuts[v, t, n] == at
                    held[2 * n], held[2 * n + 1] = (own, own) if high <= low else (own[own[:, a] >= at], own[own[:, a] < at])
                else:
                    held[2 * n] = held[2 * n + 1] = own
            assert all(sizes[v, t, n] == len(own) for n, own in held.items())
