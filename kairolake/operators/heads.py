"""Logistic heads of many groups in one distributed fit.

A group is a baseline, a configuration or a resolution triad; each has several samples (seeds), which differ in the
rows they are fitted on. All of them are fitted together: a Newton round is one pass over the rows, in which every task
adds up loss, slopes and curvatures by group and sample and returns these sums alone. Features may have another length
in each group. Models are plain numbers; rows are scored by column expressions, so that no fitted object is part of a
plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import stored

#: Numbers that a pass sums for all groups and samples together, at most; more groups are fitted in several runs.
AT_ONCE = 1 << 21
#: The most numbers that the models of one fit may have: they are sent to every task.
MODELS = 1 << 24
#: A sample is settled when no slope exceeds this.
SETTLED = 1e-9


class Head(NamedTuple):
    """Weights and bias on the features as they are."""

    weights: np.ndarray
    bias: float


def sums_by_group(rows: DataFrame, parts: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """The vector that ``parts(g, x, y, member)`` makes of a group's rows, summed in each task and then across them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            g, y = batch.column("g").to_numpy(), batch.column("y").to_numpy()
            feature, member = batch.column("features"), batch.column("member")
            flat = feature.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(feature.value_lengths().to_numpy())])
            within = member.flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1)
            for group in np.unique(g).tolist():
                own = np.flatnonzero(g == group)
                width = ends[own[0] + 1] - ends[own[0]]
                more = parts(group, flat[ends[own][:, None] + np.arange(width)], y[own], within[own])
                total[group] = more if group not in total else total[group] + more
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["g", "x"])

    partial = rows.select("g", "features", "y", "member").mapInArrow(run, "g int, x array<double>")
    summed = partial.select("g", F.posexplode("x").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("x")).toPandas()
    return {int(g): part.sort_values("i")["x"].to_numpy() for g, part in summed.groupby("g")}


class _Sample:
    """Newton's method of one sample of one group, on standardised features, with halved steps where the loss rises."""

    def __init__(self, n: float, positive: float, x: np.ndarray, xx: np.ndarray, centre: np.ndarray, ridge: float):
        d = len(x)
        self.n, self.ridge = max(n, 1.0), ridge
        mean = x / self.n
        spread = np.sqrt(np.maximum(xx / self.n - mean * mean, 0))
        scale = np.where(spread > 1e-9 * np.maximum(1.0, np.abs(mean)), spread, 1.0)
        self.ratio = (n - positive) / positive if 0 < positive < n else 1.0
        # from (weights, bias) on standardised features to those on features less ``centre``
        self.turn = np.zeros((d + 1, d + 1))
        self.turn[:d, :d] = np.diag(1 / scale)
        self.turn[d, :d], self.turn[d, d] = -(mean - centre) / scale, 1.0
        self.centre, self.at, self.best, self.step, self.loss, self.done = centre, np.zeros(d + 1), np.zeros(d + 1), None, np.inf, n == 0

    @property
    def tried(self) -> np.ndarray:
        """Coefficients to evaluate next, on features less ``centre``."""
        return self.turn @ self.at

    def update(self, loss: float, slope: np.ndarray, curve: np.ndarray) -> None:
        d = len(slope) - 1
        loss = loss / self.n + self.ridge / 2 * float(self.at[:d] @ self.at[:d])
        if not loss <= self.loss + 1e-12:
            self.step = self.step / 2
            self.at = self.best + self.step
            self.done = float(np.abs(self.step).max()) < 1e-12
            return
        penalty = np.diag([self.ridge] * d + [0.0])
        slope = self.turn.T @ slope / self.n + penalty @ self.at
        curve = self.turn.T @ curve @ self.turn / self.n + penalty + 1e-12 * np.eye(d + 1)
        self.best, self.loss, self.done = self.at, loss, float(np.abs(slope).max()) < SETTLED
        self.step = -np.linalg.solve(curve, slope)
        self.at = self.best + self.step

    def head(self) -> Head:
        turned = self.turn @ self.best
        return Head(turned[:-1], float(turned[-1] - turned[:-1] @ self.centre))


def _fit(rows: DataFrame, moments: dict[int, np.ndarray], samples: int, rounds: int, ridge: float) -> dict[int, list[Head]]:
    state: dict[int, list[_Sample]] = {}
    for g, m in moments.items():
        m = m.reshape(samples, -1)
        d = (m.shape[1] - 2) // 2
        centre = m[:, 2 : 2 + d].sum(0) / max(1.0, m[:, 0].sum())
        state[g] = [_Sample(r[0], r[1], r[2 : 2 + d], r[2 + d :], centre, ridge) for r in m]
    for _ in range(rounds):
        open_ = [g for g, s in state.items() if not all(x.done for x in s)]
        if not open_:
            break
        sent = {g: (state[g][0].centre, np.stack([x.tried for x in state[g]]), np.array([x.ratio for x in state[g]])) for g in open_}

        def slopes(g: int, x: np.ndarray, y: np.ndarray, member: np.ndarray, sent=sent) -> np.ndarray:
            centre, tried, ratio = sent[g]
            x = np.column_stack([x - centre, np.ones(len(x))])
            i, j = np.triu_indices(x.shape[1])
            at = x @ tried.T
            p = 1 / (1 + np.exp(-np.clip(at, -500, 500)))
            weight = member * np.where(y[:, None] > 0, ratio, 1.0)
            loss = (weight * (np.logaddexp(0, at) - y[:, None] * at)).sum(0)
            return np.column_stack([loss, (weight * (p - y[:, None])).T @ x, (weight * p * (1 - p)).T @ (x[:, i] * x[:, j])]).ravel()

        for g, total in sums_by_group(rows.where(F.col("g").isin(open_)), slopes).items():
            total = total.reshape(samples, -1)
            d = len(state[g][0].at)
            i, j = np.triu_indices(d)
            for one, own in zip(state[g], total, strict=True):
                if not one.done:
                    curve = np.zeros((d, d))
                    curve[i, j] = curve[j, i] = own[1 + d :]
                    one.update(own[0], own[1 : 1 + d], curve)
    return {g: [x.head() for x in s] for g, s in state.items()}


def fit_heads(rows: DataFrame, samples: int, rounds: int = 30, ridge: float = 1e-3) -> dict[int, list[Head]]:
    """For each group its ``samples`` heads: ridge logistic regressions on standardised features in which positives
    weigh as much as negatives in all.

    ``rows`` has g (int), features (array, of one length within a group), y (0 or 1) and member (array of ``samples``
    numbers: 0 where the row isn't fitted on). Rows with a null among these, or a feature that isn't a number, are
    left out; a sample without rows gets zeros (p = 1/2), one of a single class is fitted with equal weights; a group
    without rows has no entry. Groups, samples and feature lengths are dimensions: more than ``MODELS`` numbers in all
    raise ValueError, and groups beyond ``AT_ONCE`` are fitted in further runs over the same stored rows."""
    whole = F.col("g").isNotNull() & F.col("y").isNotNull() & F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x)) & F.forall("member", lambda x: x.isNotNull())
    kept = rows.select(F.col("g").cast("int").alias("g"), F.col("features").cast("array<double>").alias("features"), F.col("y").cast("double").alias("y"), F.col("member").cast("array<double>").alias("member")).where(whole)
    ready = stored(kept, "heads")
    moments = sums_by_group(ready, lambda g, x, y, member: np.column_stack([member.sum(0), member.T @ y, member.T @ x, member.T @ (x * x)]).ravel())
    width = {g: (len(m) // samples - 2) // 2 + 1 for g, m in moments.items()}
    if samples * sum(width.values()) > MODELS:
        raise ValueError("too many groups, samples or features for one fit")
    out, turn, held = {}, {}, 0
    for g, m in sorted(moments.items()):
        more = samples * width[g] * (width[g] + 3)
        if turn and held + more > AT_ONCE:
            out |= _fit(ready.where(F.col("g").isin(list(turn))), turn, samples, rounds, ridge)
            turn, held = {}, 0
        turn[g], held = m, held + more
    return out | (_fit(ready.where(F.col("g").isin(list(turn))), turn, samples, rounds, ridge) if turn else {})


def _dot(features: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(features, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def logit(features: Column, head: Head) -> Column:
    """Log odds of class 1 under one head."""
    return _dot(features, F.array(*map(F.lit, head.weights.tolist()))) + F.lit(head.bias)


def scored(rows: DataFrame, heads: dict[int, list[Head]]) -> DataFrame:
    """``rows(g, features, ...)`` with ``p``, the probabilities under the group's heads, one a sample; rows of groups
    without heads are left out. The heads, a bounded dimension, are broadcast."""
    if not heads:
        return rows.withColumn("p", F.array().cast("array<double>")).where(F.lit(False))
    table = rows.sparkSession.createDataFrame([(g, [h.weights.tolist() for h in own], [h.bias for h in own]) for g, own in heads.items()], "g int, head_w array<array<double>>, head_b array<double>")
    joined = rows.join(F.broadcast(table), "g")
    at = F.transform("head_w", lambda w, i: _dot(F.col("features"), w) + F.get("head_b", i))
    return joined.withColumn("p", F.transform(at, lambda x: 1 / (1 + F.exp(-x)))).drop("head_w", "head_b")


def newton_sql(name: str, rows: str, d: int, keys: list[str], rounds: int = 14, ridge: float = 1e-3) -> str:
    """The same fit in SQL: CTEs that end in ``name`` (keys, w1 to wd, b) from the CTE ``rows`` (keys, x1 to xd, y).
    Plain Newton rounds from zero, each solved by a Cholesky factorisation in the select list."""
    k, n = ", ".join(keys), d + 1
    z = [f"z{i}" for i in range(1, n)] + ["1"]
    at = " + ".join([f"t{i} * z{i}" for i in range(1, n)] + [f"t{n}"])
    moments = ", ".join(f"avg(x{i}) as m{i}, case when stddev_pop(x{i}) > 1e-9 * greatest(1, abs(avg(x{i}))) then stddev_pop(x{i}) else 1.0 end as s{i}" for i in range(1, n))
    steps = [
        f"{name}_m as materialized (select {k}, count(*) as n, case when sum(y) > 0 and sum(y) < count(*) then (count(*) - sum(y)) * 1.0::double / sum(y) else 1.0 end as ratio, {moments} from {rows} group by {k})",
        f"{name}_z as materialized (select {k}, n, y, case when y > 0 then ratio else 1.0 end as w, {', '.join(f'(x{i} - m{i}) / s{i} as z{i}' for i in range(1, n))} from {rows} join {name}_m using ({k}))",
        f"{name}_0 as (select {k}, {', '.join(f'0.0::double as t{i}' for i in range(1, n + 1))} from {name}_m)",
    ]
    for r in range(rounds):
        sums = [f"sum(w * (p - y) * {z[i]}) / any_value(n)" + (f" + {ridge} * any_value(t{i + 1})" if i < d else "") + f" as g{i + 1}" for i in range(n)]
        sums += [f"sum(w * p * (1 - p) * {z[i]} * {z[j]}) / any_value(n) + {(ridge if i < d else 0) + 1e-12 if i == j else 0} as h{i + 1}_{j + 1}" for i in range(n) for j in range(i + 1)]
        solve = []
        for i in range(1, n + 1):
            for j in range(1, i + 1):
                rest = "".join(f" - l{i}_{q} * l{j}_{q}" for q in range(1, j))
                solve.append(f"sqrt(h{i}_{i}{rest}) as l{i}_{i}" if i == j else f"(h{i}_{j}{rest}) / l{j}_{j} as l{i}_{j}")
        solve += [f"(g{i}{''.join(f' - l{i}_{q} * f{q}' for q in range(1, i))}) / l{i}_{i} as f{i}" for i in range(1, n + 1)]
        solve += [f"(f{i}{''.join(f' - l{q}_{i} * d{q}' for q in range(i + 1, n + 1))}) / l{i}_{i} as d{i}" for i in range(n, 0, -1)]
        steps.append(f"""{name}_{r + 1} as materialized (select {k}, {', '.join(f't{i} - d{i} as t{i}' for i in range(1, n + 1))} from (select *, {', '.join(solve)} from (
            select {k}, {', '.join(f'any_value(t{i}) as t{i}' for i in range(1, n + 1))}, {', '.join(sums)} from (select z.*, {', '.join(f't{i}' for i in range(1, n + 1))}, 1 / (1 + exp(-({at}))) as p from {name}_z z join {name}_{r} using ({k})) group by {k})))""")
    weights = ", ".join(f"t{i} / s{i} as w{i}" for i in range(1, n))
    steps.append(f"{name} as materialized (select {k}, {weights}, t{n} - ({' + '.join(f't{i} * m{i} / s{i}' for i in range(1, n))}) as b from {name}_{rounds} join {name}_m using ({k}))")
    return ", ".join(steps)
