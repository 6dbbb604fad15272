"""Ranks and running sums over an order, without a task that holds all rows of a key.

Rows are partitioned by ranges of (keys, order), so that a hot key is spread over many partitions and each holds a
contiguous piece of the order. A piece's sums are few rows; their prefix sums give every piece its start, and inside a
piece the running sums are local. Ties need no border rule: equal values are counted before they are ordered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import stored

#: Rows of a key that one task orders by a window; a larger key goes by ranges.
LOCAL_ROWS = 200_000
#: Large keys that are broadcast to tell their rows from the others'; more are joined.
BROADCAST_KEYS = 100_000


def by_size(rows: DataFrame, keys: list[str], local: Callable[[DataFrame], DataFrame], ranged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``local`` of the rows of keys with up to ``LOCAL_ROWS`` rows and ``ranged`` of the others, which must mean the
    same; keys are counted first. Without keys all rows are one."""
    if not keys:
        return ranged(rows) if rows.count() > LOCAL_ROWS else local(rows)
    large = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > LOCAL_ROWS).select(*keys), "large")
    n = large.count()
    if n == 0:
        return local(rows)
    large = F.broadcast(large) if n <= BROADCAST_KEYS else large
    return local(join_same(rows, large, keys, "left_anti")).unionByName(ranged(join_same(rows, large, keys, "left_semi")))


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the running sums named by ``sums``, each row included, along ``order`` within the keys.

    ``order`` should be total: rows that are equal in it come in any order. Null keys are a key like any other, null
    summands count as 0. The pieces follow ``spark.sql.shuffle.partitions``; only rows equal in all of keys and order
    can't be told apart by ranges."""
    added = {f"__{name}": F.coalesce(value, F.lit(0)) for name, value in sums.items()}
    by = [F.col(k).asc_nulls_first() for k in keys] + order
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumns(added).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranges").withColumn("__piece", F.shiftright("__at", 33))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy(*keys, "__piece").agg(*[F.sum(c).alias(c) for c in added])
    starts = pieces.select(*keys, "__piece", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start") for c in added])
    inside = Window.partitionBy(*keys, "__piece").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"{c}_local": F.sum(c).over(inside) for c in added})
    return join_same(local, starts, [*keys, "__piece"]).select(*rows.columns, *[(F.col(f"__{name}_local") + F.col(f"__{name}_start")).alias(name) for name in sums])


def value_ranks(counted: DataFrame, keys: list[str], value: str, count: str, out: str) -> DataFrame:
    """(keys, value, out): the mean rank, from 1, of the ``count`` equal rows that each row of ``counted`` stands for."""
    upto = running(counted.select(*keys, value, count), keys, [F.col(value).asc()], {"__upto": F.col(count)})
    return upto.select(*keys, value, (F.col("__upto") - (F.col(count) - 1) / 2).alias(out))


def join_same(rows: DataFrame, keyed: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` on keys of which nulls equal one another."""
    other = keyed.withColumnsRenamed({k: f"__same_{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__same_{i}"))
    return rows.join(other, same, how).drop(*[f"__same_{i}" for i in range(len(keys))])


def join_apart(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, least: int = 100_000) -> DataFrame:
    """``rows`` inner-joined with ``keyed``, one row a key with the number of rows that have it in ``size``. Keys of
    ``least`` rows, or of a thousandth of all if that is more, are at most 1,000 and are broadcast; the others are
    shuffled."""
    total = keyed.agg(F.sum(size)).first()[0] or 0
    bound = max(least, -(-total // 1000))
    if total < bound:
        return join_same(rows, keyed.drop(size), keys)
    heavy = F.broadcast(keyed.where(F.col(size) >= bound).drop(size))
    rest = join_same(join_same(rows, heavy.select(*keys), keys, "left_anti"), keyed.where(F.col(size) < bound).drop(size), keys)
    return join_same(rows, heavy, keys).select(*rest.columns).unionAll(rest)


def pair_ranks(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, x, y, c, rx, ry): the distinct pairs with how often they occur and both values' mean ranks in the key."""
    pairs = stored(rows.groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("c")), "pairs")
    for value in ("x", "y"):
        counted = pairs.groupBy(*keys, value).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("held"))
        ranks = join_same(value_ranks(counted, keys, value, "n", f"r{value}"), counted.select(*keys, value, "held"), [*keys, value])
        pairs = join_apart(pairs, ranks, [*keys, value], "held")
    return pairs
