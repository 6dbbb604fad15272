"""Joins on clips, seconds and intervals; band and interval joins are equi-joins on exploded seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in ``order``."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def with_metadata(rows: DataFrame, meta: DataFrame, key: str, column: str, unknown: str = "UNKNOWN") -> DataFrame:
    return rows.join(meta.select(key, column), key, "left").withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(unknown)))


def paired(rows: DataFrame, key: str, method: str, value: str, a: str, b: str) -> DataFrame:
    """(key, a, b): the values of two methods for the keys that have both; one pass, no self-join."""
    pick = lambda m: F.max(F.when(F.col(method) == m, F.col(value)))
    return rows.where(F.col(method).isin(a, b)).groupBy(key).agg(pick(a).alias("a"), pick(b).alias("b")).where("a is not null and b is not null")


def hits(truth: DataFrame, anchors: DataFrame, delta: int, n: int) -> DataFrame:
    """Seconds of ``truth(clip_id, t)`` within ``delta`` of an anchor (clip_id, t): anchors are dilated, then an
    equi semi-join."""
    near = anchors.select("clip_id", F.explode(F.sequence(F.col("t") - delta, F.col("t") + delta)).alias("t")).where((F.col("t") >= 0) & (F.col("t") < n)).distinct()
    return truth.join(near, ["clip_id", "t"], "left_semi")


def iou(a0, a1, b0, b1) -> Column:
    common = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    whole = (a1 - a0) + (b1 - b0) - common
    return F.when(whole > 0, common / whole).otherwise(0.0)


def window_iou(predicted: DataFrame, evidence: DataFrame, cell: float = 8.0) -> DataFrame:
    """(clip_id, evidence_id, window_id, iou) of overlapping windows and evidence (.., start_s, end_s).

    Both sides are sent to the cells of time they touch, so the join is on (clip, cell); a pair counts in the
    first cell that both touch."""
    cells = lambda d, p: d.select("clip_id", f"{p}_id", F.col("start_s").alias(f"{p}0"), F.col("end_s").alias(f"{p}1"), F.explode(F.sequence(F.floor(F.col("start_s") / cell), F.floor(F.col("end_s") / cell))).alias("cell"))
    both = cells(predicted, "window").join(cells(evidence, "evidence"), ["clip_id", "cell"])
    both = both.where(F.col("cell") == F.floor(F.greatest("window0", "evidence0") / cell)).where("window0 < evidence1 and evidence0 < window1")
    return both.select("clip_id", "evidence_id", "window_id", iou(F.col("window0"), F.col("window1"), F.col("evidence0"), F.col("evidence1")).alias("iou"))


def words_to_seconds(words: DataFrame, n: int) -> DataFrame:
    """(video_id, t, text): words (video_id, i, word, start, end) of each second by their midpoint, in order."""
    t = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    rows = words.withColumn("t", t).where((F.col("t") >= 0) & (F.col("t") < n))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "i", "word"))), lambda w: w["word"]), " ")
    return rows.groupBy("video_id", "t").agg(text.alias("text"))


def sweep(rows: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """Rows times small dimension tables, which are broadcast."""
    for d in dimensions:
        rows = rows.crossJoin(F.broadcast(d))
    return rows


def merge_windows(windows: DataFrame) -> DataFrame:
    """(clip_id, start_s, end_s): overlapping or touching windows merged."""
    order = Window.partitionBy("clip_id").orderBy("start_s", "end_s")
    reach = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start_s") > F.col("reach")), 1).otherwise(0)).over(order)
    return windows.withColumn("reach", reach).withColumn("island", island).groupBy("clip_id", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("island")
