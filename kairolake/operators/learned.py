"""Learned scores and heads on (clip_id, t, features array, label).

Features are written once before a fit, so that its passes read a table instead of repeating the plan that made it.
What a fit gives are plain numbers, and rows are scored by column expressions: no fitted object is part of a plan."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import stored
from .heads import Head, fit_heads, logit


class Perceptron(NamedTuple):
    """(weights, bias) of each layer on the features as they are; the layers but the last end in a logistic curve."""

    layers: list[tuple[np.ndarray, np.ndarray]]


def logistic(rows: DataFrame, iterations: int = 30) -> Head:
    """Standardised, class-weighted logistic regression."""
    fitted = fit_heads(rows.select(F.lit(0).alias("g"), "features", (F.col("label") != 0).cast("double").alias("y"), F.array(F.lit(1.0)).alias("member")), 1, iterations)
    if not fitted:
        raise ValueError("no row to fit on")
    return fitted[0][0]


def _moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature; constant ones have deviation 1."""
    sums = rows.agg(*[f(F.col("features")[i]) for f in (F.avg, F.stddev_pop) for i in range(width)]).first()
    mean, spread = np.array(sums[:width], float), np.array(sums[width:], float)
    return mean, np.where(spread > 1e-12, spread, 1.0)


def mlp(rows: DataFrame, layers: list[int], iterations: int = 30, seed: int = 1) -> Perceptron:
    """Multilayer perceptron on standardised features; one row a second."""
    ready = stored(rows.select("features", F.col("label").cast("double").alias("label")), "fit")
    mean, scale = _moments(ready, layers[0])
    lists = [F.array(*map(F.lit, x.tolist())) for x in (mean, scale)]
    shifted = F.zip_with(F.zip_with("features", lists[0], lambda a, m: a - m), lists[1], lambda a, s: a / s)
    fitted = MultilayerPerceptronClassifier(featuresCol="scaled", layers=layers, maxIter=iterations, seed=seed).fit(ready.select("label", array_to_vector(shifted).alias("scaled")))
    flat, out, at = fitted.weights.toArray(), [], 0
    for a, b in zip(layers[:-1], layers[1:], strict=True):
        out.append((flat[at : at + a * b].reshape(a, b).T, flat[at + a * b : at + a * b + b]))
        at += a * b + b
    first, bias = out[0]
    out[0] = (first / scale, bias - first @ (mean / scale))
    return Perceptron(out)


def _layer(x: Column, weights: np.ndarray, bias: np.ndarray) -> Column:
    return F.array(*[logit(x, Head(w, float(b))) for w, b in zip(weights, bias, strict=True)])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _softmax(odds: Column) -> Column:
    lifted = lambda o: _let(F.array_max(o), lambda m: F.transform(o, lambda v: F.exp(v - m)))
    share = lambda e: _let(F.aggregate(e, F.lit(0.0), lambda s, u: s + u), lambda total: F.transform(e, lambda v: v / total))
    return _let(odds, lambda o: _let(lifted(o), share))


def chances(model: Head | Perceptron, features: Column) -> Column:
    """Probabilities of all classes as an array."""
    if isinstance(model, Head):
        return _let(1 / (1 + F.exp(-logit(features, model))), lambda p: F.array(1 - p, p))

    def forward(x: Column, layers: list[tuple[np.ndarray, np.ndarray]]) -> Column:
        if len(layers) == 1:
            return _softmax(_layer(x, *layers[0]))
        return _let(F.transform(_layer(x, *layers[0]), lambda v: 1 / (1 + F.exp(-v))), lambda h: forward(h, layers[1:]))

    return forward(features, model.layers)


def predict(model: Head | Perceptron, rows: DataFrame) -> DataFrame:
    """Adds ``p``, the probability of class 1."""
    return rows.withColumn("p", chances(model, F.col("features"))[1]).drop("features")


def predict_class(model: Head | Perceptron, rows: DataFrame) -> DataFrame:
    """Adds ``chance``, the probabilities of all classes; ``prediction`` is the largest one's class."""
    rows = rows.withColumn("chance", chances(model, F.col("features"))).drop("features")
    return rows.withColumn("prediction", (F.array_position("chance", F.array_max("chance")) - 1).cast("double"))


def gate_rows(rows: DataFrame, condition, least: int = 64) -> DataFrame | None:
    """Training rows of a gate: those where the condition holds, None if they are too few or of one class."""
    chosen = rows.where(condition)
    n, classes = chosen.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    return chosen if n >= least and classes > 1 else None


def with_context(rows: DataFrame, half: int) -> DataFrame:
    """Features of the seconds around each second appended; outside the clip they are 0."""
    time = Window.partitionBy("clip_id").orderBy("t")
    zero = F.transform("features", lambda x: x * 0.0)
    near = [F.coalesce(F.lag("features", -i).over(time), zero) for i in range(-half, half + 1)]
    return rows.withColumn("features", F.concat(*near))


def pooled(rows: DataFrame) -> DataFrame:
    """(clip_id, features): mean over the clip's seconds, dimension by dimension."""
    flat = rows.select("clip_id", F.posexplode("features").alias("i", "x")).groupBy("clip_id", "i").agg(F.avg("x").alias("x"))
    return flat.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("features"))


def _summed(rows: DataFrame, columns: list[str], parts) -> np.ndarray:
    """The sum over all rows of the vector that ``parts`` makes of a frame: added up in each task, then across them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                more = parts(frame)
                total = more if total is None else total + more
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "x": total})

    sums = rows.select(*columns).mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()
    return sums["x"].to_numpy()


def multilabel(features: DataFrame, labels: DataFrame, rounds: int = 8, ridge: float = 1e-3) -> DataFrame:
    """(clip_id, label, p): standardised, class-weighted logistic regressions of all labels (a small dimension) in
    one fit. Each Newton round is one pass over the clips for all labels together."""
    names = sorted(r["label"] for r in labels.select("label").distinct().collect())
    hot = labels.groupBy("clip_id").agg(F.collect_set("label").alias("has"))
    y = F.array(*[F.coalesce(F.array_contains("has", name), F.lit(False)).cast("double") for name in names])
    rows = stored(features.join(hot, "clip_id", "left").select("clip_id", "features", y.alias("y")), "multilabel")
    first = rows.select(F.size("features")).first()
    if first is None or not names:
        return rows.select("clip_id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("p")).where("false")
    d, m = first[0], len(names)
    read = lambda frame: (np.stack(frame["features"]), np.stack(frame["y"]))

    def moments(frame: pd.DataFrame) -> np.ndarray:
        x, hot = read(frame)
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0), hot.sum(axis=0)])

    sums = _summed(rows, ["features", "y"], moments)
    n, mean, positive = sums[0], sums[1 : d + 1] / sums[0], sums[2 * d + 1 :]
    scale = np.sqrt(np.maximum(sums[d + 1 : 2 * d + 1] / n - mean * mean, 0))
    scale[scale <= 1e-12] = 1.0
    ratio = np.where((positive > 0) & (positive < n), (n - positive) / np.maximum(positive, 1), 1.0)

    def ready(x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - mean) / scale, np.ones(len(x))])

    w = np.zeros((m, d + 1))
    for _ in range(rounds):

        def slopes(frame: pd.DataFrame, w=w) -> np.ndarray:
            x, hot = read(frame)
            x = ready(x)
            p = 1 / (1 + np.exp(-np.clip(x @ w.T, -30, 30)))
            weight = np.where(hot > 0, ratio, 1.0)
            curve = np.einsum("nl,ni,nj->lij", weight * p * (1 - p), x, x)
            return np.concatenate([((weight * (hot - p)).T @ x).ravel(), curve.ravel()])

        sums = _summed(rows, ["features", "y"], slopes)
        gradient, curve = sums[: m * (d + 1)].reshape(m, d + 1) / n, sums[m * (d + 1) :].reshape(m, d + 1, d + 1) / n
        penalty = np.diag([ridge] * d + [1e-9])
        w = w + np.stack([np.linalg.solve(curve[i] + penalty + 1e-9 * np.eye(d + 1), gradient[i] - penalty @ w[i]) for i in range(m)])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                p = 1 / (1 + np.exp(-np.clip(ready(np.stack(frame["features"])) @ w.T, -30, 30)))
                yield pd.DataFrame({"clip_id": frame["clip_id"].repeat(m), "label": np.tile(names, len(frame)), "p": p.ravel()})

    kind = rows.schema["clip_id"].dataType.simpleString()
    return rows.select("clip_id", "features").mapInPandas(score, f"clip_id {kind}, label string, p double")


def regress(rows: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """Adds ``prediction`` of a linear regression on a real label: least squares on standardised features with a
    ridge, solved from sums that each task adds up. No row gives no row."""
    ready = stored(rows, "fit")
    first = ready.select(F.size("features")).first()
    if first is None:
        return ready.withColumn("prediction", F.lit(None).cast("double")).drop("features")
    mean, scale = _moments(ready, first[0])

    def sums(frame: pd.DataFrame) -> np.ndarray:
        x = np.column_stack([(np.stack(frame["features"]) - mean) / scale, np.ones(len(frame))])
        return np.concatenate([(x.T @ x).ravel(), x.T @ frame["label"].to_numpy(float), [len(x)]])

    d = first[0] + 1
    total = _summed(ready, ["features", "label"], sums)
    n = total[-1]
    w = np.linalg.solve(total[: d * d].reshape(d, d) / n + np.diag([ridge] * (d - 1) + [0.0]), total[d * d : -1] / n)
    head = Head(w[:-1] / scale, float(w[-1] - w[:-1] @ (mean / scale)))
    return ready.withColumn("prediction", logit(F.col("features"), head)).drop("features")
