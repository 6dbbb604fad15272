"""Ranks, running sums and what is made of them, against plain Python; hot keys are spread over tasks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairolake.operators import ranks as R
from kairolake.operators import stats as A

ROWS = "k string, i long, x double, y double"


def table(rng, n, keys=("hot", "hot", "hot", "cold", None)):
    return [(keys[int(rng.integers(len(keys)))], i, float(rng.integers(0, 12)), [None, float(rng.integers(0, 4)) / 2][int(rng.random() < 0.95)]) for i in range(n)]


def mean_ranks(values):
    return [sum(v < w for v in values) + (sum(v == w for v in values) + 1) / 2 for w in values]


def pearson(x, y):
    x, y = np.array(x, float), np.array(y, float)
    if len(x) == 0 or x.std() <= 1e-12 or y.std() <= 1e-12:
        return None
    return float(np.mean((x - x.mean()) * (y - y.mean())) / (x.std() * y.std()))


def test_running_sums(spark):
    rows = table(np.random.default_rng(1), 700)
    got = R.running(spark.createDataFrame(rows, ROWS), ["k"], [F.desc("x"), F.asc("i")], {"r": F.lit(1), "s": F.col("y")}).collect()
    want, seen = {}, {}
    for k, i, _x, y in sorted(rows, key=lambda r: (-r[2], r[1])):
        r, s = seen.get(k, (0, 0.0))
        seen[k] = want[i] = (r + 1, s + (y or 0))
    assert {r["i"]: (r["r"], r["s"]) for r in got} == want


def test_a_hot_key_lies_in_many_pieces(spark):
    rows = spark.range(40_000).select(F.lit("only").alias("k"), F.col("id").alias("i"), (F.col("id") % 3).cast("double").alias("x"))
    pieces = rows.repartitionByRange(4, F.col("k").asc_nulls_first(), F.desc("x"), F.asc("i")).groupBy(F.spark_partition_id()).count().collect()
    assert len(pieces) == 4 and max(r["count"] for r in pieces) < 20_000  # also with three values only
    out = R.running(rows, ["k"], [F.desc("x"), F.asc("i")], {"r": F.lit(1)})
    assert out.agg(F.min("r"), F.max("r"), F.count_distinct("r")).first() == (1, 40_000, 40_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("__piece" in line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition(k" in line)


@pytest.fixture(params=[(200_000, 100_000, 100_000), (100, 100_000, 5), (0, 0, 100_000)], ids=["windows", "large keys apart", "all by ranges"])
def sizes(request, monkeypatch):
    """Every way that the size of a key can take."""
    local, keys, least = request.param
    monkeypatch.setattr(R, "LOCAL_ROWS", local)
    monkeypatch.setattr(R, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(R.join_apart, "__defaults__", (least,))


def test_correlations(spark, sizes):
    rows = table(np.random.default_rng(2), 500) + [("flat", 900 + i, 1.0, float(i)) for i in range(4)] + [("one", 950, 1.0, 2.0), ("bad", 951, math.nan, 1.0), ("bad", 952, math.inf, 1.0), ("bad", 953, 1.0, 1.0), ("bad", 954, 2.0, 3.0)]
    got = {r["k"]: (r["n"], r["pearson"], r["spearman"]) for r in A.correlations(spark.createDataFrame(rows, ROWS), ["k"], "x", "y").collect()}
    assert set(got) == {"hot", "cold", None, "flat", "one", "bad"}
    for k, (n, p, s) in got.items():
        own = [(x, y) for q, _, x, y in rows if q == k and y is not None and math.isfinite(x)]
        x, y = [v for v, _ in own], [v for _, v in own]
        assert n == len(own) and p == pytest.approx(pearson(x, y)) and s == (None if p is None else pytest.approx(pearson(mean_ranks(x), mean_ranks(y)))), k
    whole = A.correlations(spark.createDataFrame(rows, ROWS), [], "i", "x").first()
    own = [(i, x) for _, i, x, _ in rows if math.isfinite(x)]
    assert whole["n"] == len(own) and whole["spearman"] == pytest.approx(pearson(mean_ranks([i for i, _ in own]), mean_ranks([x for _, x in own])))


def test_average_ranks(spark, sizes):
    rows = table(np.random.default_rng(3), 300)
    got = {r["i"]: r["rank"] for r in A.average_ranks(spark.createDataFrame(rows, ROWS), "y", "rank", ["k"]).collect()}
    for k in {r[0] for r in rows}:
        own = [(i, -1.0 if y is None else y) for q, i, _, y in rows if q == k]
        assert [got[i] for i, _ in own] == mean_ranks([v for _, v in own])


def test_average_precision(spark, sizes):
    rng = np.random.default_rng(4)
    rows = [(["a", "a", "a", "b", "none"][int(rng.integers(5))], i, int(rng.random() < 0.3), float(rng.integers(0, 6))) for i in range(400)]
    rows = [(c, i, 0 if c == "none" else y, s) for c, i, y, s in rows] + [("a", 900, None, 9.0), ("a", 901, 1, None)]
    got = {r["class"]: r["ap"] for r in A.average_precision(spark.createDataFrame(rows, "class string, item long, y int, score double")).collect()}
    assert set(got) == {"a", "b"}
    for c in got:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[3] is None, -(r[3] or 0), r[1]))
        hits, at = 0, []
        for place, (_, _, y, _) in enumerate(own, 1):
            if y == 1:
                hits += 1
                at.append(hits / place)
        assert got[c] == pytest.approx(np.mean(at))


def test_coverage_matrix_needs_a_dimension(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a")], "i long, m string")
    assert [tuple(r) for r in A.coverage_matrix(rows, "i", "m").collect()] == [(1, "b")]
    monkeypatch.setattr(A, "MATRIX_VALUES", 1)
    with pytest.raises(ValueError):
        A.coverage_matrix(rows, "i", "m")
