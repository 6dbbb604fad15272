"""Anchor selection: ranked, suppressed, gated picks of seconds from (clip_id, t, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .confidence import confidence, metric
from .series import by_clip, local_maxima, minmax, smooth

def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(clip_id, rank, t): the k best seconds, ties to the earlier one."""
    return scores.withColumn("rank", F.row_number().over(by_clip().orderBy(F.desc("score"), "t"))).where(F.col("rank") <= k).select("clip_id", "rank", "t")


def ranked(scores: DataFrame) -> DataFrame:
    """(clip_id, ts): a clip's seconds from best to worst, as an array; unknown scores come last."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("score").isNull().alias("unknown"), (-F.col("score")).alias("s"), F.col("t").cast("int").alias("t"))))
    return scores.groupBy("clip_id").agg(pairs.alias("pairs")).select("clip_id", F.transform("pairs", lambda p: p["t"]).alias("ts"))


def suppress_near(ts: Column, k: int, radius: int, start: Column | None = None) -> Column:
    """Greedy pick of k seconds in the order of ``ts``, none within ``radius`` of one picked before."""
    start = start if start is not None else F.array().cast("array<int>")
    return F.aggregate(ts, start, lambda kept, t: F.when((F.size(kept) < k) & ~F.exists(kept, lambda u: F.abs(u - t) <= radius), F.array_append(kept, t)).otherwise(kept))


def top_k_nms(scores: DataFrame, k: int, radius: int) -> DataFrame:
    """(clip_id, anchors): greedy top k with suppression of neighbours."""
    return ranked(scores).select("clip_id", suppress_near(F.col("ts"), k, radius).alias("anchors"))


def local_max_nms(scores: DataFrame, k: int, radius: int) -> DataFrame:
    """The same on local maxima; on all seconds in clips without any."""
    peaks = ranked(local_maxima(scores)).select("clip_id", F.col("ts").alias("peaks"))
    both = ranked(scores).join(peaks, "clip_id", "left")
    return both.select("clip_id", suppress_near(F.coalesce("peaks", "ts"), k, radius).alias("anchors"))


def _second(scores: DataFrame, k: int, radius: int, max_gap: float, far: bool) -> DataFrame:
    """First the best second; then the best one far from it (or near it) if its gap to the best is small, else the
    overall second; further ones by suppression; in the order of score."""
    first = scores.groupBy("clip_id").agg(F.max_by(F.struct("t", "score"), F.struct("score", -F.col("t"))).alias("a"))
    rows = scores.join(first, "clip_id")
    away = F.abs(F.col("t") - F.col("a.t"))
    fits = (away > radius) if far else (away <= radius)
    key = F.struct("score", -F.col("t"))
    pick = rows.where(away > 0).groupBy("clip_id").agg(F.max_by(F.struct("t", "score"), F.when(fits, key)).alias("want"), F.max_by("t", key).alias("next"))
    # max_by skips null keys, so "want" is null where no second fits
    chosen = first.join(pick, "clip_id", "left").select("clip_id", F.col("a.t").alias("t1"), F.when(F.col("want").isNotNull() & (F.col("a.score") - F.col("want.score") <= max_gap), F.col("want.t")).otherwise(F.col("next")).alias("t2"))
    start = F.filter(F.array(F.col("t1"), F.col("t2")), lambda t: t.isNotNull()).cast("array<int>")
    rest = F.filter("ts", lambda t: ~F.array_contains(start, t))
    grown = F.when(F.lit(k) <= 2, F.slice(start, 1, k)).otherwise(suppress_near(rest, k, radius, start))
    return ranked(scores).join(chosen, "clip_id").select("clip_id", grown.alias("g"), "ts").select("clip_id", F.filter("ts", lambda t: F.array_contains("g", t)).alias("anchors"))


def nms_strong(scores: DataFrame, k: int, radius: int, max_gap: float) -> DataFrame:
    return _second(scores, k, radius, max_gap, far=True)


def adjacent_top2(scores: DataFrame, k: int, radius: int, max_gap: float) -> DataFrame:
    return _second(scores, k, radius, max_gap, far=False)


def window_top_k(scores: DataFrame, k: int, window: int, radius: int) -> DataFrame:
    return top_k_nms(smooth(scores, window), k, radius)


def in_range(anchors: Column, n: int) -> Column:
    """Distinct anchors inside the clip, in their order."""
    return F.array_distinct(F.filter(anchors, lambda t: (t >= 0) & (t < n)))


def shifted(anchors: Column, by: int, n: int) -> Column:
    """Anchors moved by some seconds; those that leave the clip or repeat are dropped."""
    return in_range(F.transform(anchors, lambda t: (t + by).cast("int")), n)


def select_anchors(scores: DataFrame, k: int, n: int, select: str = "topk", radius: int = 1, max_gap: float = 0.5, window: int = 3, smoothing: int = 1, shift: int = 0, conf_metric: str = "std", threshold: float = 0.0) -> DataFrame:
    """(clip_id, anchors, conf_value, fallback_used, fallback_reason): gate on the raw scores, smooth, select, shift.

    A threshold of 0 or less switches the gate off; a clip below it has no anchors."""
    inside = scores.where(F.col("t") < n)
    ready = smooth(inside, smoothing) if smoothing > 1 else inside
    picks = {
        "topk": lambda: ranked(ready).select("clip_id", F.slice("ts", 1, k).alias("anchors")),
        "nms": lambda: top_k_nms(ready, k, radius),
        "local_max_nms": lambda: local_max_nms(ready, k, radius),
        "nms_strong": lambda: nms_strong(ready, k, radius, max_gap),
        "adjacent_top2": lambda: adjacent_top2(ready, k, radius, max_gap),
        "window_topk": lambda: window_top_k(ready, k, window, radius),
    }[select]()
    gated = (F.col("conf_value") < threshold) & F.lit(threshold > 0)
    out = picks.join(confidence(inside).select("clip_id", metric(conf_metric).alias("conf_value")), "clip_id")
    return out.select(
        "clip_id",
        F.when(gated, F.array().cast("array<int>")).otherwise(shifted(F.col("anchors"), shift, n) if shift else F.col("anchors")).alias("anchors"),
        "conf_value",
        gated.alias("fallback_used"),
        F.when(gated, F.lit("conf_below_threshold")).alias("fallback_reason"),
    )


def anchor_windows(dense: DataFrame, stride_s: float, win_s: float, delta_s: float, k: int, radius: int) -> DataFrame:
    """(clip_id, rank, start_s, end_s): windows around the centres of the best local maxima of a dense sequence."""
    picked = local_max_nms(dense.select("clip_id", F.col("i").cast("int").alias("t"), "score"), k, radius)
    centre = F.col("i") * stride_s + win_s / 2
    return picked.select("clip_id", F.posexplode("anchors").alias("rank", "i")).select("clip_id", "rank", F.greatest(F.lit(0.0), centre - delta_s).alias("start_s"), (centre + delta_s).alias("end_s"))


def veto_second(sel: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Keeps only the first anchor where the second's normalised score is under median + threshold."""
    x = minmax(scores, out="x").withColumn("margin", F.col("x") - F.median("x").over(Window.partitionBy("clip_id")))
    second = sel.select("clip_id", "anchors", F.get("anchors", F.lit(1)).alias("t")).join(x.select("clip_id", "t", "margin"), ["clip_id", "t"], "left")
    return second.select("clip_id", F.when(F.col("margin") < threshold, F.slice("anchors", 1, 1)).otherwise(F.col("anchors")).alias("anchors"))


def veto_by_probability(sel: DataFrame, p: Column, threshold: float) -> DataFrame:
    return sel.withColumn("anchors", F.when(p < threshold, F.slice("anchors", 1, 1)).otherwise(F.col("anchors")))


def far_rule(anchors: Column, limit: int, keep_first: bool) -> Column:
    """Two anchors further apart than ``limit``: none stays, or only the first."""
    far = (F.size(anchors) >= 2) & (F.abs(F.get(anchors, F.lit(0)) - F.get(anchors, F.lit(1))) > limit)
    return F.when(far, F.slice(anchors, 1, 1) if keep_first else F.array().cast("array<int>")).otherwise(anchors)


def learned_gate(base: Column, gate: Column, mode: str) -> tuple[Column, Column]:
    """(accepted, reason): rescue accepts if either does, veto if both do."""
    if mode == "rescue":
        return base | gate, F.when(base, "base").when(gate, "rescued").otherwise("rejected")
    return base & gate, F.when(~base, "base_rejected").when(~gate, "vetoed").otherwise("accepted")


def visual_fallback(audio: DataFrame, visual: DataFrame) -> DataFrame:
    """Audio anchors; where the audio gate failed, the visual ones if those are confident."""
    v = visual.select("clip_id", F.col("anchors").alias("v"), F.col("fallback_used").alias("vf"))
    use = F.col("fallback_used") & ~F.coalesce("vf", F.lit(True))
    return audio.join(v, "clip_id", "left").select("clip_id", F.when(use, F.col("v")).otherwise(F.col("anchors")).alias("anchors"), F.when(use, "visual").when(F.col("fallback_used"), "uniform").otherwise("audio").alias("source"))


def hash_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the SHA-1 of the parts joined by '|': its first 12 hex digits, exact as a double."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha1(key), 1, 12), 16, 10).cast("double") / float(1 << 48)


def random_anchors(scores: DataFrame, k: int, seed: int) -> DataFrame:
    """k seconds of each clip in the order of a hash."""
    order = by_clip().orderBy(hash_uniform(str(seed), F.col("clip_id"), F.col("t")), "t")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("clip_id", "rank", "t")


def oracle_anchors(labels: DataFrame, k: int) -> DataFrame:
    """The first k event seconds of (clip_id, t, gt)."""
    return labels.where("gt <> 0").withColumn("rank", F.row_number().over(by_clip().orderBy("t"))).where(F.col("rank") <= k).select("clip_id", "rank", "t")


def oracle_segment_anchors(segments: DataFrame, n: int, k: int) -> DataFrame:
    """Centres of the longest segments (segment_id, clip_id, start_s, end_s), unique and inside the clip, first k."""
    t = F.least(F.greatest(F.floor((F.col("start_s") + F.col("end_s")) / 2), F.lit(0)), F.lit(n - 1)).cast("int")
    order = [F.desc(F.col("end_s") - F.col("start_s")), "start_s", "segment_id"]
    rows = segments.withColumn("t", t)
    unique = rows.withColumn("r", F.row_number().over(Window.partitionBy("clip_id", "t").orderBy(*order))).where("r = 1")
    return unique.withColumn("rank", F.row_number().over(by_clip().orderBy(*order))).where(F.col("rank") <= k).select("clip_id", "rank", "t")


def extremes(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n best and the n worst rows."""
    best = rows.orderBy(F.desc(by), key).limit(n).withColumn("end", F.lit("best"))
    return best.unionByName(rows.orderBy(by, key).limit(n).withColumn("end", F.lit("worst")))


def explode_anchors(sel: DataFrame) -> DataFrame:
    return sel.select("clip_id", F.posexplode("anchors").alias("pos", "t")).select("clip_id", (F.col("pos") + 1).alias("rank"), "t")
