"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts of few cut edges; a small classifier learns from
it which parts the neighbours of a vector lie in. Every vector of the table is indexed under its most probable
part; a query is sent to its several most probable parts and compared there with every vector, in blocks.

How many parts a query visits is measured, not guessed: a few hundred rows are searched exactly against the whole
table, and the probability that visits must cover is the least that finds ``recall`` of their neighbours. Where
vectors cluster, that is one part or two; vectors without any structure need most of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, table


@dataclass(frozen=True)
class AnnConfig:
    """``sample`` bounds the vectors that partition and classifier are fitted on, ``probes`` the rows (about) that
    ``recall`` is measured with. There is a part for each ``part_rows`` rows of the table, ``least_parts`` at least
    and one for 16 sampled vectors at most, as a power of two. ``block``: vectors and queries that meet in one task
    at most."""

    k: int = 5
    sample: int = 8192
    part_rows: int = 1000
    least_parts: int = 16
    neighbours: int = 10
    recall: float = 0.95
    probes: int = 256
    block: int = 4096
    steps: int = 300
    seed: int = 3


@dataclass(frozen=True)
class AnnIndex:
    """``rows(vec_id, v, norm, part)``, the router's weights (None: one part), and the probability to cover."""

    rows: DataFrame
    weights: list[np.ndarray] | None
    mass: float
    cfg: AnnConfig


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k most similar other rows of unit vectors, block by block."""
    x, out, k = x.astype(np.float32), [], min(k, len(x) - 1)
    for i in range(0, len(x), 256):
        s = x @ x[i : i + 256].T
        s = np.negative(s, out=s).T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = np.inf
        out.append(np.argpartition(s, k - 1, axis=1)[:, :k].astype(np.int32) if k else np.zeros((len(s), 0), np.int32))
    return np.concatenate(out) if out else np.zeros((0, 0), np.int32)


def _bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Halves ``nodes`` of the graph with edges (a, b): the Fiedler order, then swaps that cut fewer edges."""
    n = len(nodes)
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1e-9
    v = rng.standard_normal(n)
    root = np.sqrt(degree)
    for _ in range(100):
        v -= root * (v @ root) / (root @ root)
        u = v / root
        v = v + (np.bincount(a, weights=u[b], minlength=n) + np.bincount(b, weights=u[a], minlength=n)) / root
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        cut = side[a] != side[b]
        gain = np.bincount(a, weights=2.0 * cut - 1, minlength=n) + np.bincount(b, weights=2.0 * cut - 1, minlength=n)
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = (x[np.argsort(-gain[x], kind="stable")][: max(1, n // 50)] for x in (left, right))
        m = min(len(left), len(right))
        good = gain[left[:m]] + gain[right[:m]] > 2
        if not good.any():
            break
        trial = side.copy()
        trial[left[:m][good]], trial[right[:m][good]] = True, False
        if (trial[a] != trial[b]).sum() >= cut.sum():
            break
        side = trial
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Recursive bisection of the neighbour graph into ``parts`` (a power of two) of equal size."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(graph), np.int64)
    a, b = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    for _ in range(int(np.log2(max(1, parts)))):
        fresh = np.zeros_like(label)
        for part in np.unique(label):
            nodes = np.flatnonzero(label == part)
            at = np.full(len(label), -1)
            at[nodes] = np.arange(len(nodes))
            inside = (at[a] >= 0) & (at[b] >= 0)
            fresh[nodes] = 2 * part + _bisect(nodes, at[a][inside], at[b][inside], rng)
        label = fresh
    return label


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray, cfg: AnnConfig) -> list[np.ndarray]:
    """One hidden layer, trained by Adam on the shares of each vector's neighbourhood in the parts."""
    rng = np.random.default_rng(cfg.seed)
    h, d, p = 128, x.shape[1], target.shape[1]
    w = [rng.standard_normal((d, h)) * np.sqrt(2 / d), np.zeros(h), rng.standard_normal((h, p)) * np.sqrt(1 / h), np.zeros(p)]
    m, v = [np.zeros_like(q) for q in w], [np.zeros_like(q) for q in w]
    for t in range(1, cfg.steps + 1):
        rows = rng.integers(0, len(x), min(len(x), 512))
        z = np.maximum(x[rows] @ w[0] * np.sqrt(d) + w[1], 0)
        e = (softmax(z @ w[2] + w[3]) - target[rows]) / len(rows)
        back = (e @ w[2].T) * (z > 0)
        grads = [x[rows].T @ back * np.sqrt(d), back.sum(axis=0), z.T @ e, e.sum(axis=0)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - 5e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w


def route(x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
    return softmax(np.maximum(x @ w[0] * np.sqrt(x.shape[1]) + w[1], 0) @ w[2] + w[3])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, norm) of the vectors that take part: finite, not zero, of the table's most common length."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).where("norm > 0")
    lengths = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1)
    return rows.join(F.broadcast(lengths.select("dims")), F.size("v") == F.col("dims")).drop("dims")


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _drawn(cfg: AnnConfig, salt: int):
    return F.pmod(F.xxhash64(F.lit(cfg.seed + salt), "vec_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))


def fit(rows: DataFrame, n: int, cfg: AnnConfig) -> list[np.ndarray] | None:
    """Router weights from a sample of at most about ``cfg.sample`` of the ``n`` rows (those with the smallest hashes
    of their ids); None if there are too few rows to cut."""
    sample = rows.where(_drawn(cfg, 0) < cfg.sample / max(1, n)).orderBy("vec_id").limit(2 * cfg.sample).select("v").toPandas()
    if len(sample) < 4 * cfg.least_parts:
        return None
    parts = 1 << int(np.log2(min(max(cfg.least_parts, n // cfg.part_rows), max(cfg.least_parts, len(sample) // 16))))
    x = _unit(sample["v"])
    graph = neighbour_graph(x, cfg.neighbours)
    part = balanced_parts(graph, parts, cfg.seed)
    target, row = np.zeros((len(x), parts)), np.arange(len(x))
    target[row, part] = 0.5
    for j in range(graph.shape[1]):  # half for the own part, half for the neighbours'
        target[row, part[graph[:, j]]] += 0.5 / graph.shape[1]
    weights = train_router(x, target, cfg)
    del sample, graph, target
    give_back()
    return weights


def _visited(x: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """By row: the parts from the most probable on, and the probability that those before each hold."""
    p = route(x, weights)
    order = np.argsort(-p, axis=1, kind="stable")
    upto = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
    return order, np.column_stack([np.zeros(len(p)), upto[:, :-1]])


def _mass(rows: DataFrame, weights: list[np.ndarray], n: int, cfg: AnnConfig) -> float:
    """The probability that visits must cover, from the exact neighbours of about ``cfg.probes`` rows."""
    probes = rows.where(_drawn(cfg, 1) < cfg.probes / n).orderBy("vec_id").limit(2 * cfg.probes).select("vec_id", "v").toPandas()
    if not len(probes):
        return 1.0
    ids, x = probes["vec_id"].to_numpy(), _unit(probes["v"])

    def top(frames):
        for frame in frames:
            if len(frame):
                s = x @ _unit(frame["v"]).T
                s[ids[:, None] == frame["vec_id"].to_numpy()[None, :]] = -np.inf
                k = min(cfg.k, len(frame))
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield pd.DataFrame({"q": np.repeat(np.arange(len(ids)), k), "score": np.take_along_axis(s, at, axis=1).ravel(), "part": frame["part"].to_numpy()[at].ravel()})

    best = Window.partitionBy("q").orderBy(F.desc("score"), "part")
    found = rows.select("vec_id", "v", "part").mapInPandas(top, "q int, score double, part int").where("score > -2").withColumn("r", F.row_number().over(best)).where(F.col("r") <= cfg.k).select("q", "part").toPandas()
    if not len(found):
        return 1.0
    order, before = _visited(x, weights)
    place = np.argsort(order, axis=1)[found["q"], found["part"]]
    return float(np.nextafter(np.quantile(before[found["q"], place], cfg.recall, method="higher"), 2))


def build_index(vectors: DataFrame, cfg: AnnConfig | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> AnnIndex:
    """Every vector that takes part, under its most probable part."""
    cfg = cfg or AnnConfig()
    rows = materialize(usable(vectors, id_col, vec_col), "vectors")
    n = rows.count()
    weights = fit(rows, n, cfg)
    if weights is None:
        return AnnIndex(rows.withColumn("part", F.lit(0)), None, 1.0, cfg)

    def place(frames):
        for frame in frames:
            yield frame.assign(part=route(_unit(frame["v"]), weights).argmax(axis=1).astype(np.int32) if len(frame) else np.zeros(0, np.int32))

    placed = materialize(rows.mapInPandas(place, "vec_id long, v array<double>, norm double, part int"), "placed")
    return AnnIndex(placed, weights, _mass(placed, weights, n, cfg), cfg)


def routed(index: AnnIndex, is_query) -> DataFrame:
    """(vec_id, v, norm, part): a row for each part that each query visits."""
    queries = index.rows.where(is_query).select("vec_id", "v", "norm")
    if index.weights is None:
        return queries.withColumn("part", F.lit(0))
    weights, mass = index.weights, index.mass  # the tasks get these alone

    def visit(frames):
        for frame in frames:
            if len(frame):
                order, before = _visited(_unit(frame["v"]), weights)
                yield frame.assign(visits=[o[b < mass].astype(np.int32) for o, b in zip(order, before, strict=True)])

    return queries.mapInPandas(visit, "vec_id long, v array<double>, norm double, visits array<int>").select("vec_id", "v", "norm", F.explode("visits").alias("part"))


def scanned_share(index: AnnIndex, is_query) -> float:
    """The share of the table that a query is compared with, on average."""
    sizes = index.rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    visits = routed(index, is_query).groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    met = sizes.join(visits, "part").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    return (met or 0) / max(1, index.rows.count() * index.rows.where(is_query).count())


def nearest(vectors: DataFrame, is_query, cfg: AnnConfig | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the nearest other rows found.

    Nearness is the cosine in double precision, ties go to the smaller id. Vectors that are null, zero, of another
    length, or hold null or non-finite components take no part, nor do rows without an id. Rows that repeat an id
    count as one vector each, but a query never finds its own id. With fewer than k other rows all of them come. An
    empty table gives no rows; other columns are ignored."""
    return search(build_index(vectors, cfg, id_col, vec_col), is_query)


def search(index: AnnIndex, is_query) -> DataFrame:
    """``nearest`` in an index that is there."""
    cfg, placed, queries = index.cfg, index.rows, routed(index, is_query)
    sizes = placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / cfg.block).cast("int").alias("blocks"))
    asked = queries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / cfg.block).cast("int").alias("askers"))
    grid = F.broadcast(sizes.join(asked, "part"))  # one row a part
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(grid, "part").withColumn("blk", own("blocks")).withColumn("ask", every("askers"))
    right = queries.join(grid, "part").withColumn("ask", own("askers")).withColumn("blk", every("blocks"))

    def meet(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(want):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        have = have.sort_values("vec_id")
        ids, x, norm = have["vec_id"].to_numpy(), np.stack(have["v"]), have["norm"].to_numpy()
        rough = _unit(want["q_v"]) @ (x / norm[:, None]).T
        found = []
        for i, (q, v, length) in enumerate(zip(want["q_vec_id"], want["q_v"], want["q_norm"], strict=True)):
            s = np.where(ids == q, -np.inf, rough[i])
            last = np.partition(s, -cfg.k)[-cfg.k] if len(s) > cfg.k else -np.inf
            at = np.flatnonzero((s >= last - 1e-9) & (ids != q))  # all ties of the last one too
            score = (x[at] * v).sum(axis=1) / (norm[at] * length)
            best = np.lexsort((ids[at], -score))[: cfg.k]
            found.append(pd.DataFrame({"query_id": q, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(found)

    right = right.toDF(*(f"q_{c}" for c in right.columns))
    hits = left.groupBy("part", "blk", "ask").cogroup(right.groupBy("q_part", "q_blk", "q_ask")).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
