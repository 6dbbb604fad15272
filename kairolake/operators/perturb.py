"""Perturbations for the robustness grid; all randomness comes from hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchors import hash_uniform
from .series import EPS, by_clip, minmax


def gaussian(*key: Column | str) -> Column:
    """A standard normal number from a hash (Box-Muller)."""
    u, v = F.greatest(hash_uniform(*key, "u"), F.lit(1e-12)), hash_uniform(*key, "v")
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def shift_samples(samples: DataFrame, seconds: float, rate: int) -> DataFrame:
    """Moves (clip_id, idx, amp) by some seconds; the length stays, gaps are 0."""
    by = round(seconds * rate)
    moved = samples.select("clip_id", (F.col("idx") + by).alias("idx"), F.col("amp").alias("moved"))
    return samples.select("clip_id", "idx").join(moved, ["clip_id", "idx"], "left").select("clip_id", "idx", F.coalesce("moved", F.lit(0.0)).alias("amp"))


def add_noise(samples: DataFrame, snr_db: float, seed: int) -> DataFrame:
    """Gaussian noise at a signal-to-noise ratio against the clip's root mean square."""
    rms = F.sqrt(F.avg(F.col("amp") * F.col("amp")).over(Window.partitionBy("clip_id")) + 1e-12)
    return samples.withColumn("amp", F.col("amp") + rms / 10 ** (snr_db / 20) * gaussian(str(seed), F.col("clip_id"), F.col("idx")))


def silence(samples: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Zeroes one run of that share of each clip at a hash-chosen start; 1 or more silences all of it."""
    n = F.count(F.lit(1)).over(Window.partitionBy("clip_id"))
    length = F.least(n, F.round(n * ratio).cast("long"))
    start = F.floor(hash_uniform(str(seed), F.col("clip_id")) * (n - length + 1))
    return samples.withColumn("amp", F.when((F.col("idx") >= start) & (F.col("idx") < start + length), 0.0).otherwise(F.col("amp")))


def perturb_scores(scores: DataFrame, shift: int, snr_db: float, silence_ratio: float, seed: int) -> DataFrame:
    """Shift with 0, noise of power / 10^(snr/10), and a hash mask, clamped to [0, 1]."""
    time = by_clip().orderBy("t")
    moved = F.lag("score", shift).over(time) if shift >= 0 else F.lead("score", -shift).over(time)
    rows = scores.withColumn("score", F.coalesce(moved, F.lit(0.0)))
    power = F.avg(F.col("score") * F.col("score")).over(Window.partitionBy("clip_id"))
    noisy = F.col("score") + F.sqrt(power / 10 ** (snr_db / 10)) * gaussian(str(seed), F.col("clip_id"), F.col("t"))
    kept = hash_uniform(str(seed), "mask", F.col("clip_id"), F.col("t")) >= silence_ratio
    return rows.withColumn("score", F.when(kept, F.greatest(F.lit(0.0), F.least(F.lit(1.0), noisy))).otherwise(0.0))


def degraded_picks(scores: DataFrame, cells: DataFrame, k: int, n: int, seed: int) -> DataFrame:
    """(shift, snr, silence, clip_id, picks, truth) of ``scores(clip_id, t, score, gt)``: the k best seconds of every
    clip with events under every cell of ``cells(shift int, snr double, silence double)``, as ``perturb_scores`` and
    the ranking give them cell by cell.

    Clips are gathered once, each into one row of its seconds in order with their noise and mask; the cells, a small
    dimension, multiply these rows, and everything else happens inside a row."""
    second = F.struct("t", "score", gaussian(str(seed), F.col("clip_id"), F.col("t")).alias("noise"), hash_uniform(str(seed), "mask", F.col("clip_id"), F.col("t")).alias("mask"))
    truth = F.sort_array(F.collect_set(F.when((F.col("gt") != 0) & (F.col("t") < n), F.col("t"))))
    clips = minmax(scores).groupBy("clip_id").agg(F.array_sort(F.collect_list(second)).alias("s"), truth.alias("truth")).where(F.size("truth") > 0)
    grid = clips.crossJoin(F.broadcast(cells))
    moved = F.transform("s", lambda x, i: F.struct(x["t"].alias("t"), F.coalesce(F.when(i - F.col("shift") >= 0, F.get("s", i - F.col("shift"))["score"]), F.lit(0.0)).alias("v"), x["noise"].alias("noise"), x["mask"].alias("mask")))
    power = F.aggregate("m", F.lit(0.0), lambda a, x: a + x["v"] * x["v"]) / F.size("m")
    grid = grid.withColumn("m", moved).withColumn("level", F.sqrt(power / F.pow(F.lit(10.0), F.col("snr") / 10)))
    value = lambda x: F.when(x["mask"] >= F.col("silence"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["v"] + F.col("level") * x["noise"]))).otherwise(0.0)
    picks = F.transform(F.slice(F.array_sort(F.transform("m", lambda x: F.struct((-value(x)).alias("v"), x["t"].alias("t")))), 1, k), lambda x: x["t"])
    return grid.select("shift", "snr", "silence", "clip_id", picks.alias("picks"), "truth")


def recall_grid(scores: DataFrame, cells: DataFrame, k: int, deltas: list[int], n: int, seed: int) -> DataFrame:
    """(shift, snr, silence, delta, clips, recall) over the cells: the mean share of a clip's event seconds that lie
    within delta of a pick."""
    grid = degraded_picks(scores, cells, k, n, seed)
    found = lambda d: F.aggregate("truth", F.lit(0.0), lambda a, t: a + F.exists("picks", lambda u: F.abs(u - t) <= d).cast("double")) / F.size("truth")
    rows = F.inline(F.array(*[F.struct(F.lit(d).alias("delta"), found(d).alias("r")) for d in deltas]))
    return grid.select("shift", "snr", "silence", rows).groupBy("shift", "snr", "silence", "delta").agg(F.count(F.lit(1)).alias("clips"), F.avg("r").alias("recall"))


def degraded_shares(scores: DataFrame, cells: DataFrame, k: int, n: int, seed: int) -> DataFrame:
    """(shift, snr, silence, anchored, uniform): over clips with events, the share of the picks and of all n seconds
    that are events."""
    grid = degraded_picks(scores, cells, k, n, seed)
    hit = F.size(F.array_intersect("picks", "truth")) / F.size("picks")
    return grid.groupBy("shift", "snr", "silence").agg(F.avg(hit).alias("anchored"), F.avg(F.size("truth") / n).alias("uniform"))


def degraded_energy(samples: DataFrame, cells: list[tuple[float, float, float]], rate: int, n: int, seed: int) -> DataFrame:
    """(cell, clip_id, t, score): the log-energy of the first ``n`` seconds of every clip after a shift by some seconds,
    noise at a signal-to-noise ratio and a run of silence, for each (shift, snr, silence) of ``cells``, ``cell`` being
    its place in the list; what ``shift_samples``, ``add_noise``, ``silence`` and the energy give cell by cell.

    ``samples(clip_id, idx, amp)`` have each idx from 0 once; a null amplitude counts as 0. Samples are read once: a
    second's energy is sum x^2 + 2 s sum x z + s^2 sum z^2 with noise z of deviation s, so three sums a shift and a
    silence ratio, added up before anything is shuffled, serve every ratio of signal to noise. Only the distinct shifts
    multiply the samples; no clip has to fit in a task."""
    shifts, ratios = sorted({0, *(round(c[0] * rate) for c in cells)}), sorted({c[2] for c in cells})
    size = samples.groupBy("clip_id").agg(F.count(F.lit(1)).alias("size"))
    length = lambda r: F.least(F.col("size"), F.round(F.col("size") * r).cast("long"))
    first = size.withColumn("draw", hash_uniform(str(seed), F.col("clip_id")))
    runs = first.select("clip_id", "size", *[F.floor(F.col("draw") * (F.col("size") - length(r) + 1)).alias(f"from{i}") for i, r in enumerate(ratios)], *[length(r).alias(f"len{i}") for i, r in enumerate(ratios)])
    moved = samples.join(runs, "clip_id").withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("at", F.col("idx") + F.col("shift")).where((F.col("at") >= 0) & (F.col("at") < F.col("size")))
    x = F.coalesce("amp", F.lit(0.0))
    ready = moved.select("clip_id", "shift", "size", F.floor(F.col("at") / rate).cast("int").alias("t"), x.alias("x"), gaussian(str(seed), F.col("clip_id"), F.col("at")).alias("z"), *[((F.col("at") < F.col(f"from{i}")) | (F.col("at") >= F.col(f"from{i}") + F.col(f"len{i}"))).cast("double").alias(f"heard{i}") for i in range(len(ratios))])
    product = lambda a, b, i: F.sum(F.col(a) * F.col(b) * F.col(f"heard{i}"))
    heard = F.array(*[F.struct(product("x", "x", i).alias("xx"), product("x", "z", i).alias("xz"), product("z", "z", i).alias("zz")) for i in range(len(ratios))])
    sums = ready.groupBy("clip_id", "shift", "t").agg(heard.alias("heard"), F.sum(F.col("x") * F.col("x")).alias("power"), F.first("size").alias("size"))
    # a clip's few sums become one row, in which the cells, a small dimension, look theirs up
    clips = sums.groupBy("clip_id").agg(F.first("size").alias("size"), F.map_from_entries(F.collect_list(F.struct(F.struct("shift", "t").alias("k"), F.struct("heard", "power").alias("v")))).alias("sums"))
    table = samples.sparkSession.createDataFrame([(i, round(c[0] * rate), float(c[1]), ratios.index(c[2])) for i, c in enumerate(cells)], "cell int, shift int, snr double, ratio int")
    powers = F.filter(F.map_entries("sums"), lambda e: e["key"]["shift"] == F.col("shift"))
    level = F.sqrt(F.aggregate(powers, F.lit(0.0), lambda s, e: s + e["value"]["power"]) / F.col("size") + 1e-12) / F.pow(F.lit(10.0), F.col("snr") / 20)
    grid = clips.crossJoin(F.broadcast(table)).withColumn("level", level).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    part = lambda shift, name: F.coalesce(F.get(F.element_at("sums", F.struct(shift.alias("shift"), F.col("t").alias("t")))["heard"], F.col("ratio"))[name], F.lit(0.0))
    energy = part(F.col("shift"), "xx") + 2 * F.col("level") * part(F.col("shift"), "xz") + F.col("level") * F.col("level") * part(F.lit(0), "zz")
    return grid.select("cell", "clip_id", "t", F.log(F.greatest(energy, F.lit(0.0)) / rate + EPS).alias("score"))


def forced_uniform(clips: DataFrame, alpha: float, salt: str) -> DataFrame:
    """(clip_id, forced): which clips are made to use the uniform plan."""
    return clips.select("clip_id", (hash_uniform(F.col("clip_id"), salt) < alpha).alias("forced"))


def window_hit(windows: DataFrame, events: DataFrame) -> DataFrame:
    """(clip_id, hit): whether any window holds the clip's event time."""
    inside = F.col("at_s").between(F.col("start_s"), F.col("end_s"))
    return events.join(windows, "clip_id", "left").groupBy("clip_id").agg(F.coalesce(F.max(inside.cast("int")), F.lit(0)).alias("hit"))
