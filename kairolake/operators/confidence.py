"""Confidence of a score sequence and the features that gates are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import by_clip, minmax

METRICS = ("std", "std_norm", "top1_med", "top1_med_norm", "top12_gap", "top12_gap_norm", "top3_bottom3", "gini")


def confidence(scores: DataFrame) -> DataFrame:
    """All metrics of each clip as columns, in one pass over ranked rows."""
    up, down = by_clip().orderBy("score", "t"), by_clip().orderBy(F.desc("score"), "t")
    rows = minmax(scores, out="x").withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down)).withColumn("y", F.col("score") - F.least(F.min("score").over(by_clip()), F.lit(0.0)))
    n = F.count(F.lit(1))
    at = lambda c, k: F.max(F.when(F.col("down") == k, F.col(c)))
    gap = lambda c: F.when(n < 2, F.lit(0.0)).otherwise(at(c, 1) - at(c, 2))
    gini = 2 * F.sum(F.col("up") * F.col("y")) / (n * F.sum("y")) - (n + 1) / n
    return rows.groupBy("clip_id").agg(
        F.stddev_pop("score").alias("std"),
        F.stddev_pop("x").alias("std_norm"),
        (F.max("score") - F.median("score")).alias("top1_med"),
        (F.max("x") - F.median("x")).alias("top1_med_norm"),
        gap("score").alias("top12_gap"),
        gap("x").alias("top12_gap_norm"),
        (F.avg(F.when(F.col("down") <= 3, F.col("x"))) - F.avg(F.when(F.col("up") <= 3, F.col("x")))).alias("top3_bottom3"),
        F.when(F.sum("y") <= 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), gini))).alias("gini"),
    )


def metric(name: Column | str) -> Column:
    """The metric that a column or literal names; an unknown one raises."""
    name = F.lit(name) if isinstance(name, str) else name
    out = F.when(F.lit(False), F.lit(0.0))
    for m in METRICS:
        out = out.when(name == m, F.col(m))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown metric "), name)).cast("double"))


def reliability_alpha(q: Column, low: float, high: float) -> Column:
    """low + (1 - q)(high - low), q clamped to [0, 1]; the bounds must be ordered in [0, 1]."""
    if not 0 <= low <= high <= 1:
        raise ValueError("need 0 <= low <= high <= 1")
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))
    return F.greatest(F.lit(low), F.least(F.lit(high), low + (1 - q) * (high - low)))


def second_anchor_features(scores: DataFrame) -> DataFrame:
    """Features that judge a clip's second anchor against its first: peaks, gap, spread, distance, surroundings."""
    time = by_clip().orderBy("t")
    rows = minmax(scores, out="x").withColumn("near", F.avg("x").over(time.rowsBetween(-1, 1))).withColumn("down", F.row_number().over(by_clip().orderBy(F.desc("score"), "t")))
    at = lambda c, k: F.max(F.when(F.col("down") == k, F.col(c)))
    out = rows.groupBy("clip_id").agg(at("x", 1).alias("peak1"), at("x", 2).alias("peak2"), at("x", 3).alias("peak3"), at("near", 1).alias("near1"), at("near", 2).alias("near2"), F.abs(at("t", 1) - at("t", 2)).alias("distance"), F.avg("x").alias("mean"), F.median("x").alias("median"))
    return out.withColumns({"gap12": F.col("peak1") - F.col("peak2"), "gap23": F.col("peak2") - F.col("peak3")}).join(confidence(scores).select("clip_id", "std", "gini"), "clip_id")


GATE_FEATURES = ("top1", "top2", "top3", "gap12", "gap13", "top1_med", "top1_mean", "std", "gini", "above_median", "above_08", "near1", "near2", "distance", "bottom1", "bottom12_gap")


def gate_features(scores: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(clip_id, GATE_FEATURES): sixteen scale-free features that judge a clip's first anchor.

    The first anchor is that of ``anchors(clip_id, t)``, one row a clip, where it names a second of the clip, else
    the best second; ``near`` are means over a second and its neighbours, ``distance`` to the second-best second is
    divided by the clip's length less one. What a short clip lacks is 0."""
    time = by_clip().orderBy("t")
    rows = minmax(scores, out="x").withColumn("near", F.avg("x").over(time.rowsBetween(-1, 1))).withColumn("down", F.row_number().over(by_clip().orderBy(F.desc("score"), "t")))
    named = anchors.select("clip_id", F.col("t").alias("named")) if anchors is not None else scores.select("clip_id", F.lit(None).cast("int").alias("named")).distinct()
    rows = rows.join(named, "clip_id", "left").withColumn("med", F.median("x").over(Window.partitionBy("clip_id"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("clip_id")))
    at = lambda c, k: F.coalesce(F.max(F.when(F.col("down") == k, F.col(c))), F.lit(0.0))
    up = lambda k: F.max(F.when(F.col("down") == F.col("n") - k + 1, F.col("x")))
    first = lambda c: F.coalesce(F.max(F.when(F.col("t") == F.col("named"), F.col(c))), F.max(F.when(F.col("down") == 1, F.col(c))))
    second = lambda c: F.coalesce(F.max(F.when(F.col("down") == 2, F.col(c))), first(c))
    by = rows.groupBy("clip_id").agg(
        first("x").alias("top1"), at("x", 2).alias("top2"), at("x", 3).alias("top3"), F.max("med").alias("med"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.avg((F.col("x") > F.col("med")).cast("double")).alias("above_median"), F.avg((F.col("x") >= 0.8).cast("double")).alias("above_08"),
        first("near").alias("near1"), second("near").alias("near2"), (F.abs(first("t") - second("t")) / F.greatest(F.max("n") - 1, F.lit(1))).alias("distance"), up(1).alias("bottom1"), F.coalesce(up(2), F.lit(0.0)).alias("bottom2"),
    ).join(confidence(minmax(scores, out="score")).select("clip_id", "gini"), "clip_id")
    more = {"gap12": F.col("top1") - F.col("top2"), "gap13": F.col("top1") - F.col("top3"), "top1_med": F.col("top1") - F.col("med"), "top1_mean": F.col("top1") - F.col("mean"), "bottom12_gap": F.col("bottom2") - F.col("bottom1")}
    return by.withColumns(more).select("clip_id", *GATE_FEATURES)
