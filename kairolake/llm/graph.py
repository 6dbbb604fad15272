"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize


def _stored(edges: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """The edges written once, with their number and checksum."""
    seen = Observation()
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 40)), F.lit(0)).alias("h")), name)
    return table, (seen.get["n"], seen.get["h"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below it are linked to the smallest of these."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    below = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)`` with a <> b; component is the smallest node reachable.

    Alternates large-star and small-star rounds until every node points at its component's minimum: a
    logarithmic number of rounds in practice. Each round is aggregations with map-side combine and equi-joins,
    so a node with very many neighbours is split like any skewed key. Repeated edges and either direction are
    fine; an empty edge list gives no rows."""
    now, before = _stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while before[0]:
        now, after = _stored(_small_star(_large_star(now)), name)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())
