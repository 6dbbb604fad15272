"""The grouped fit against plain Newton rounds, and the jobs on it against loops over configurations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairolake.operators import heads as H
from kairolake.operators import learned as M
from kairolake.operators.anchors import hash_uniform
from kairolake.plans import head_jobs as Q


def newton(x, y, ridge=1e-3, rounds=60):
    """Weights and bias on raw features: plain Newton rounds with halved steps, row by row."""
    n, d = x.shape
    mean, scale = x.mean(0), x.std(0)
    scale[scale <= 1e-9 * np.maximum(1, np.abs(mean))] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(n)])
    ratio = (n - y.sum()) / y.sum() if 0 < y.sum() < n else 1.0
    weight, penalty = np.where(y > 0, ratio, 1.0), np.diag([ridge] * d + [0.0])
    loss = lambda w: (weight * (np.logaddexp(0, z @ w) - y * (z @ w))).sum() / n + ridge / 2 * w[:d] @ w[:d]
    w = np.zeros(d + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ w)))
        slope = z.T @ (weight * (p - y)) / n + penalty @ w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z / n + penalty + 1e-12 * np.eye(d + 1)
        step = np.linalg.solve(curve, slope)
        while loss(w - step) > loss(w) + 1e-12 and np.abs(step).max() > 1e-12:
            step = step / 2
        w = w - step
    return w[:d] / scale, w[d] - (w[:d] * mean / scale).sum()


SCHEMA = "g int, features array<double>, y double, member array<double>"


def rows_of(rng, g, n, d, samples, shift=0.0, sharp=1.0):
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 20, d) + shift
    y = (sharp * (x - shift).sum(1) / 20 + rng.normal(size=n) > 0.5).astype(float)
    member = (rng.random((n, samples)) < 0.8).astype(float)
    return x, y, member, [(g, a.tolist(), float(b), m.tolist()) for a, b, m in zip(x, y, member, strict=True)]


@pytest.mark.parametrize("at_once", [1 << 21, 30])
def test_grouped_fit_is_plain_newton(spark, monkeypatch, at_once):
    """Groups of different widths, far from the origin, nearly separable, of a single class: all in one fit."""
    monkeypatch.setattr(H, "AT_ONCE", at_once)  # also with one group a run
    rng = np.random.default_rng(1)
    sets = {0: rows_of(rng, 0, 400, 2, 3), 3: rows_of(rng, 3, 300, 4, 3, shift=1000.0), 7: rows_of(rng, 7, 200, 3, 3, sharp=500.0)}
    x, y, member, rows = rows_of(rng, 9, 60, 2, 3)
    sets[9] = (x, np.zeros(60), member, [(g, a, 0.0, m) for g, a, _, m in rows])
    bad = [(0, [1.0, None], 1.0, [1.0] * 3), (0, [1.0, float("nan")], 1.0, [1.0] * 3), (0, [1.0, 2.0], None, [1.0] * 3), (None, [1.0, 2.0], 1.0, [1.0] * 3), (0, None, 1.0, [1.0] * 3), (0, [1.0, 2.0], 0.0, None)]
    df = spark.createDataFrame([r for s in sets.values() for r in s[3]] + bad, SCHEMA).repartition(5)
    got = H.fit_heads(df, 3)
    assert sorted(got) == sorted(sets)
    for g, (x, y, member, _) in sets.items():
        for s in range(3):
            own = member[:, s] > 0
            if g == 9:  # the bias of a single class has no bound: it ends where the slope vanishes
                assert (x @ got[g][s].weights + got[g][s].bias < -15).all()
                continue
            w, b = newton(x[own], y[own])
            assert got[g][s].weights == pytest.approx(w, rel=1e-4, abs=1e-6) and got[g][s].bias == pytest.approx(b, rel=1e-4, abs=1e-4)


def test_fit_edges(spark, monkeypatch):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1.0, [1.0, 0.0]), (1, [2.0, 2.0], 0.0, [1.0, 0.0])], SCHEMA)
    got = H.fit_heads(df, 2)
    assert got[1][1].weights.tolist() == [0.0, 0.0] and got[1][1].bias == 0.0  # a sample without rows
    assert got[1][0].weights[1] == pytest.approx(0, abs=1e-9)  # a constant feature
    assert H.fit_heads(df.limit(0), 2) == {}
    assert H.scored(df, {}).count() == 0 and H.scored(df.withColumn("g", F.lit(5)), got).count() == 0
    monkeypatch.setattr(H, "MODELS", 3)
    with pytest.raises(ValueError):
        H.fit_heads(df, 2)
    with pytest.raises(ValueError):
        M.logistic(spark.createDataFrame([], "features array<double>, label int"))


def test_scores_of_groups(spark):
    heads = {0: [H.Head(np.array([1.0, -2.0]), 0.5), H.Head(np.array([0.0, 1.0]), 0.0)], 1: [H.Head(np.array([2.0]), 0.0), H.Head(np.array([-1.0]), 1.0)]}
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, [1.0])], "g int, features array<double>")
    got = {r["g"]: r["p"] for r in H.scored(df, heads).collect()}
    curve = lambda v: 1 / (1 + math.exp(-v))
    assert got == {0: pytest.approx([curve(-2.5), curve(2.0)]), 1: pytest.approx([curve(6.0), curve(-2.0)])}


def test_no_model_object_in_a_plan(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3)], int(i % 5 > 2)) for i in range(60)], "clip_id long, features array<double>, label int")
    for model in (M.logistic(rows), M.mlp(rows, [2, 3, 2], 20)):
        plan = M.predict(model, rows)._jdf.queryExecution().toString()
        assert "UDF" not in plan and "Python" not in plan and M.predict(model, rows).where("(p >= 0.5) <> (label = 1)").count() == 0


def test_perceptron_is_its_layers(spark):
    """The column expression against the layers multiplied out."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)) * 5 + 2
    df = spark.createDataFrame([(i, r.tolist(), int(r[0] + r[1] > 4) + int(r[2] > 5)) for i, r in enumerate(x)], "i long, features array<double>, label int")
    model = M.mlp(df, [3, 5, 4, 3], 15)
    h = x
    for w, b in model.layers[:-1]:
        h = 1 / (1 + np.exp(-(h @ w.T + b)))
    odds = h @ model.layers[-1][0].T + model.layers[-1][1]
    want = np.exp(odds) / np.exp(odds).sum(1, keepdims=True)
    got = {r["i"]: (r["chance"], r["prediction"]) for r in M.predict_class(model, df).collect()}
    assert all(got[i][0] == pytest.approx(want[i]) and got[i][1] == want[i].argmax() for i in range(80))


# jobs against loops


@pytest.fixture(scope="module")
def clips(spark):
    rng = np.random.default_rng(6)
    seconds, features = [], []
    for c in range(48):
        gt = (rng.random(10) < 0.25).astype(int)
        score = rng.normal(size=10) + 1.2 * gt
        for t in range(10):
            seconds.append((c, t, float(score[t]), int(gt[t])))
            features += [(c, t, r, [float(score[t] + rng.normal() * 200 / r), r / 100]) for r in (160, 224, 352)]
    return seconds, features, spark.createDataFrame(seconds, "clip_id long, t int, score double, gt int").cache(), spark.createDataFrame(features, "clip_id long, t int, resolution int, features array<double>").cache()


def plan_of(anchors, n=10, r=4):
    """Equal-budget plan of one clip in a loop."""
    if not anchors:
        return [224] * n
    high = anchors[: n // r]
    rest = sorted((t for t in range(n) if t not in high), key=lambda t: (min(abs(t - a) for a in anchors), t))
    base = set(rest[: n - r * len(high)])
    return [352 if t in high else 224 if t in base else 160 for t in range(n)]


def drawn(spark, seeds):
    rows = spark.range(48).select(F.col("id"), *[hash_uniform(str(s), F.col("id")).alias(f"u{s}") for s in range(seeds)]).collect()
    return [{r["id"] for r in rows if r[f"u{s}"] < Q.DRAWN} for s in range(seeds)]


def accuracy(clips, config, seeds, test, spark):
    """Accuracy by (seed, clip) of a (k, threshold) in plain Python; None: the uniform plan."""
    seconds, features, _, _ = clips
    of = {(c, t, r): f for c, t, r, f in features}
    by = {}
    for c, t, s, g in seconds:
        by.setdefault(c, []).append((s, g))
    rows = {}
    for c, own in by.items():
        std = np.std([s for s, _ in own])
        anchors = [] if config is None or (config[1] > 0 and std < config[1]) else sorted(range(10), key=lambda t: (-own[t][0], t))[: config[0]]
        plan = plan_of(anchors)
        rows[c] = (np.array([of[c, t, plan[t]] for t in range(10)]), np.array([g for _, g in own], float))
    out = {}
    for s, chosen in enumerate(drawn(spark, seeds)):
        fit = [c for c in rows if c % 2 == 0 and c in chosen]
        w, b = newton(np.concatenate([rows[c][0] for c in fit]), np.concatenate([rows[c][1] for c in fit]))
        for c in rows:
            if test(c):
                x, y = rows[c]
                out[s, c] = float((((x @ w + b) >= 0) == (y > 0)).mean())
    return out


def mean_delta(clips, config, seeds, test, spark):
    a, b = accuracy(clips, config, seeds, test, spark), accuracy(clips, None, seeds, test, spark)
    return [np.mean([a[s, c] - b[s, c] for q, c in a if q == s]) for s in range(seeds)]


CONFIGS = [(0, 1, 0.0), (1, 2, 0.0), (2, 2, 1.0), (3, 3, 0.0), (4, 1, 5.0)]
TRAIN, VAL, TEST = (lambda: F.col("clip_id") % 2 == 0), (lambda: F.col("clip_id") % 4 == 1), (lambda: F.col("clip_id") % 4 == 3)


def test_sweep_is_a_loop_over_configs(spark, clips):
    _, _, seconds, features = clips
    got = {r["config"]: r for r in Q.sweep(seconds.select("clip_id", "t", "score"), seconds, features, CONFIGS, 10, 3, TRAIN(), VAL()).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for c, k, th in CONFIGS:
        deltas = mean_delta(clips, (k, th), 3, lambda c: c % 4 == 1, spark)
        assert got[c]["n"] == 3 and got[c]["delta"] == pytest.approx(np.mean(deltas), abs=1e-9)
    assert got[4]["delta"] == 0 and got[4]["p"] == 1  # every clip falls back to the uniform plan


def test_promotion(spark, clips):
    _, _, seconds, features = clips
    out = Q.promote(seconds.select("clip_id", "t", "score"), seconds, features, CONFIGS, 10, 2, 4, TRAIN(), VAL(), TEST(), 2).collect()
    assert len(out) == 2 and sum(r["best"] for r in out) == 1 and sorted(r["pick"] for r in out) == [1, 2]
    few = {c: np.mean(mean_delta(clips, (k, th), 2, lambda c: c % 4 == 1, spark)) for c, k, th in CONFIGS}
    of = {c: (k, th) for c, k, th in CONFIGS}
    for r in out:
        assert r["few_delta"] == pytest.approx(few[r["config"]], abs=1e-9)
        assert r["val_delta"] == pytest.approx(np.mean(mean_delta(clips, of[r["config"]], 4, lambda c: c % 4 == 1, spark)), abs=1e-9)
        assert r["test_delta"] == pytest.approx(np.mean(mean_delta(clips, of[r["config"]], 4, lambda c: c % 4 == 3, spark)), abs=1e-9)


def test_equal_budgets_and_widths(spark, clips):
    """Every baseline but the low one costs the same; side features widen only the concat variants."""
    _, _, seconds, features = clips
    rows = Q.planned_rows(seconds.select("clip_id", "t", "score"), seconds, features, Q.BASELINES, 10)
    cost = {(Q.BASELINES[r["g"]].name, r["tokens"]) for r in rows.groupBy("g", "clip_id").agg(F.sum("tokens").alias("tokens")).collect()}
    assert cost == {(v.name, 1000 if v.kind == "uniform_low" else 1960) for v in Q.BASELINES}
    assert {(Q.BASELINES[r["g"]].extra, r["d"]) for r in rows.select("g", F.size("features").alias("d")).distinct().collect()} == {(False, 2), (True, 3)}
    with pytest.raises(ValueError):
        Q.variant_rows(rows, features, seconds, Q.BASELINES, None)


def test_whole_triads():
    assert (160, 224, 352) in Q.whole_triads([160, 224, 352]) and Q.whole_triads([112, 160, 224]) == []


def test_planned_rows_are_never_broadcast(spark, clips, monkeypatch):
    """Scores, truth and features grow with the input; at 60 times sf0.1 their hash tables overfilled the driver."""
    plans, stored = [], Q.stored
    seconds, features = stored(clips[2], "seconds"), stored(clips[3], "features")
    monkeypatch.setattr(Q, "stored", lambda rows, name: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or stored(rows, name))
    Q.planned_rows(seconds.drop("gt"), seconds.select("clip_id", "t", "gt"), features, [Q.Variant("anchored", "anchored")], 10)
    assert plans and not any("BroadcastHashJoin" in plan for plan in plans)
