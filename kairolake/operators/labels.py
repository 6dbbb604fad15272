"""Labels, keys and set reports: projections and predicates on clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_labels(clips: DataFrame, n: int, background: str = "background") -> DataFrame:
    """(clip_id, t, label): a second has the clip's label iff [t, t+1) overlaps [start_s, end_s) by more than 0."""
    rows = clips.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    overlap = F.least(F.col("t") + 1, "end_s") - F.greatest("t", "start_s")
    return rows.select("clip_id", "t", F.when(overlap > 0, F.col("label")).otherwise(background).alias("label"))


def covered_seconds(intervals: DataFrame) -> DataFrame:
    """(clip_id, label, t) of the seconds that an interval overlaps; empty intervals cover none."""
    last = F.ceil("end_s") - 1
    rows = intervals.where("end_s > start_s").withColumn("t", F.explode(F.sequence(F.floor("start_s"), F.greatest(last, F.floor("start_s")))))
    return rows.where(F.least(F.col("t") + 1, "end_s") > F.greatest("t", "start_s")).select("clip_id", "label", F.col("t").cast("int").alias("t"))


def label_dictionary(clips: DataFrame, background: str = "background") -> DataFrame:
    """(label, label_id): background 0, the others sorted from 1. One row a label."""
    labels = clips.select("label").where(F.col("label") != background).distinct()
    numbered = labels.select("label", F.row_number().over(Window.orderBy("label")).alias("label_id"))
    return numbered.unionAll(numbered.sparkSession.range(1).select(F.lit(background), F.lit(0)))


def dense_classes(*sides: DataFrame) -> DataFrame:
    """(class_id, dense_id): the sorted union of the sides' class ids from 0. One row a class."""
    out = sides[0].select("class_id")
    for side in sides[1:]:
        out = out.union(side.select("class_id"))
    return out.distinct().select("class_id", (F.row_number().over(Window.orderBy("class_id")) - 1).alias("dense_id"))


def multi_hot(pairs: DataFrame) -> DataFrame:
    """(clip_id, label, hot) for every clip and label; the labels are a small dimension."""
    grid = pairs.select("clip_id").distinct().crossJoin(pairs.select("label").distinct())
    return grid.join(pairs.distinct().withColumn("hot", F.lit(1)), ["clip_id", "label"], "left").fillna(0, ["hot"])


def keep_available(rows: DataFrame, available: DataFrame, key: str) -> DataFrame:
    return rows.join(available.select(key).distinct(), key, "left_semi")


def missing_report(rows: DataFrame, available: DataFrame, key: str, reason: str, least: int = 0) -> DataFrame:
    """(key, reason) of the rows without a match; with ``least`` it raises if fewer than that many rows match."""
    if least and keep_available(rows, available, key).limit(least).count() < least:
        raise ValueError(f"fewer than {least} usable items")
    return rows.join(available.select(key).distinct(), key, "left_anti").select(key, F.lit(reason).alias("reason"))


def ok_fail(rows: DataFrame, available: DataFrame, key: str) -> DataFrame:
    seen = available.select(key).distinct().withColumn("__seen", F.lit(True))
    return rows.join(seen, key, "left").select(key, F.when(F.col("__seen"), "ok").otherwise("fail").alias("status"))


def item_key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def first_number(*columns: Column) -> Column:
    """The first of the columns that is a number; what isn't one counts as missing."""
    return F.coalesce(*[c.try_cast("double") for c in columns])
