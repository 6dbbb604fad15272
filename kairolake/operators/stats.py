"""Recall, coverage, paired tests, bootstrap, bucket reports and rankings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import stored
from . import ranks as R
from .anchors import hash_uniform
from .joins import hits


def recall(truth: DataFrame, anchors: DataFrame, deltas: list[int], n: int) -> DataFrame:
    """(delta, clips, recall): mean over clips of the share of truth seconds near an anchor; clips without truth
    don't count, clips without anchors have 0. The anchors are dilated once, to the largest delta."""
    top = max(deltas)
    grid = F.explode(F.sequence(F.lit(-top), F.lit(top)))
    near = anchors.select("clip_id", "t", grid.alias("d")).select("clip_id", (F.col("t") + F.col("d")).alias("t"), F.abs("d").alias("d")).where((F.col("t") >= 0) & (F.col("t") < n)).groupBy("clip_id", "t").agg(F.min("d").alias("d"))
    seen = truth.where(F.col("t") < n).select("clip_id", "t").distinct().join(near, ["clip_id", "t"], "left")
    by = seen.groupBy("clip_id").agg(*[F.avg((F.coalesce("d", F.lit(top + 1)) <= k).cast("double")).alias(f"r{k}") for k in deltas])
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("delta"), F.col(f"r{k}").alias("r")) for k in deltas]))
    return by.select("clip_id", pairs).groupBy("delta").agg(F.count(F.lit(1)).alias("clips"), F.avg("r").alias("recall"))


def coverage(best_iou: DataFrame, taus: list[float]) -> DataFrame:
    """(clip_id, tau, coverage) of (clip_id, evidence_id, iou): share of the evidence with an IoU of tau or more."""
    pairs = F.inline(F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"c{i}").alias("coverage")) for i, t in enumerate(taus)]))
    return best_iou.groupBy("clip_id").agg(*[F.avg((F.round("iou", 9) >= t).cast("double")).alias(f"c{i}") for i, t in enumerate(taus)]).select("clip_id", pairs)


def mean_std(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, std): sample standard deviation, 0 for one row."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


#: Degrees of freedom up to which the sum for Student's t is taken term by term.
T_TERMS = 400


def _normal_two_sided(z: Column) -> Column:
    """P(|Z| > z), z >= 0, of the standard normal law, by the rational formula 26.2.17 of Abramowitz and Stegun
    (error under 1.5e-7)."""
    k = 1 / (1 + 0.2316419 * z)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite trigonometric sum; above ``T_TERMS``
    by Wallace's transformation to the normal law, whose error is far under 1e-6 there."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    c, s = F.cos(theta), F.sin(theta)
    # odd df: 2/pi (theta + sin * sum of even products); even df: sin * sum; terms grow by (k-1)/k * cos^2
    even = df % 2 == 0
    steps = F.when((df >= 3) & (df <= T_TERMS), F.sequence(F.when(even, F.lit(2)).otherwise(F.lit(3)), F.greatest(df - 2, F.lit(3)).cast("int"), F.lit(2)))
    first = F.when(even, F.lit(1.0)).otherwise(c)
    state = F.struct(first.alias("term"), first.alias("sum"))
    grow = lambda acc, k: F.struct((acc["term"] * c * c * (k - 1) / k).alias("term"), (acc["sum"] + acc["term"] * c * c * (k - 1) / k).alias("sum"))
    total = F.when(df <= 2, F.when(even, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.aggregate(F.filter(steps, lambda k: k <= df - 2), state, grow)["sum"])
    inside = F.when(even, s * total).otherwise(2 / math.pi * (theta + s * total))
    z = (8 * df + 1) / (8 * df + 3) * F.sqrt(df * F.log1p(t * t / df))
    return F.when(df > T_TERMS, _normal_two_sided(z)).otherwise(F.greatest(F.lit(0.0), 1 - inside))


def paired_t(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, delta, t, p) of y - x; without variance t = 0, p = 1 (no difference) or t null, p = 0; one pair
    has neither."""
    d = F.col(y).cast("double") - F.col(x).cast("double")
    by = pairs.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd"))
    flat = F.col("sd") <= 1e-12
    t = F.when(flat, F.when(F.abs("delta") <= 1e-12, 0.0)).otherwise(F.col("delta") / (F.col("sd") / F.sqrt("n")))
    p = F.when(F.col("n") < 2, None).when(flat, F.when(F.abs("delta") <= 1e-12, 1.0).otherwise(0.0)).otherwise(t_two_sided(F.col("t"), (F.col("n") - 1).cast("int")))
    return by.withColumn("t", t).withColumn("p", p).select(*keys, "n", "delta", "t", "p")


def bootstrap(values: DataFrame, keys: list[str], id_col: str, value: str, replicates: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(keys, n, mean, low, high, p): bootstrap of the mean, each replicate weighting rows by hash-seeded Poisson(1)
    counts, so it is a distributed sum. p = 2 min(P(mean <= 0), P(mean >= 0)), at most 1."""
    u = hash_uniform(str(seed), F.col("b"), F.col(id_col))
    weight, cdf, step = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, 9):  # Poisson(1) beyond 8 has probability 1e-6
        cdf += step
        step /= k
        weight = weight + (u >= cdf).cast("int")
    rows = values.where(F.col(value).isNotNull()).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = rows.groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ci = means.groupBy(*keys).agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("m") <= 0).cast("double")), F.avg((F.col("m") >= 0).cast("double")))).alias("p"))
    return values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).join(ci, keys)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, ps: list[float], bins: int = 256) -> DataFrame:
    """(keys, p, q): linearly interpolated quantiles, exact, without a task that holds all values of a key.

    Equal values are counted first; a sketch cuts a key's values into bins of about equal counts, prefix sums over
    the bins and inside each bin give every value its ranks."""
    named = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    counted = named.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    edges = named.groupBy(*keys).agg(F.percentile_approx("v", F.array(*[F.lit(i / bins) for i in range(1, bins)]), 10 * bins).alias("edges"), F.count(F.lit(1)).alias("n"))
    both = counted.join(edges, keys) if keys else counted.crossJoin(edges)
    binned = stored(both.select(*keys, "v", "c", "n", F.size(F.filter("edges", lambda e: e <= F.col("v"))).alias("bin")), "bins")
    base = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = binned.groupBy(*keys, "bin").agg(F.sum("c").alias("in_bin")).withColumn("base", F.coalesce(F.sum("in_bin").over(base), F.lit(0))).drop("in_bin")
    inside = Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.withColumn("upto", F.sum("c").over(inside)).join(bases, [*keys, "bin"]).withColumn("upto", F.col("upto") + F.col("base"))
    asked = ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).withColumn("at", F.col("p") * (F.col("n") - 1))
    holds = lambda r: (F.col("upto") - F.col("c") <= r) & (r < F.col("upto"))
    low, high = holds(F.floor("at")), holds(F.ceil("at"))
    found = asked.where(low | high).groupBy(*keys, "p").agg(F.max(F.when(low, F.col("v"))).alias("a"), F.max(F.when(high, F.col("v"))).alias("b"), F.first("at").alias("at"))
    return found.select(*keys, "p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("q"))


def quantile_columns(rows: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """(keys, a column for each of ``ps``): the exact quantiles side by side."""
    at = exact_quantiles(rows, keys, value, list(ps.values()))
    return at.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(name) for name, p in ps.items()])


def quantile_buckets(rows: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """Adds ``bucket``: low, mid_1, .., high by exact linear quantiles, edges belonging to the lower bucket. The
    edges are as many numbers as quantiles."""
    found = {r["p"]: r["q"] for r in exact_quantiles(rows, [], value, quantiles).collect()}
    names = ["low", *[f"mid_{i}" for i in range(1, len(quantiles))], "high"]
    out = F.lit(names[-1])
    for i in reversed(range(len(quantiles))):
        out = F.when(F.col(value) <= found.get(float(quantiles[i]), 0.0), names[i]).otherwise(out)
    return rows.withColumn("bucket", F.when(F.col(value).isNotNull(), out))


def bucket_table(rows: DataFrame, bucket: str, method: str, value: str, key: str, uniform: str) -> DataFrame:
    """(bucket, method, n_items, n_paired, acc, delta) against the uniform method, over items that have both;
    n_items counts all of the bucket's items."""
    base = rows.where(F.col(method) == uniform).select(key, F.col(value).alias("base"))
    both = rows.where(F.col(method) != uniform).join(base, key)
    items = rows.groupBy(bucket).agg(F.countDistinct(key).alias("n_items"))
    by = both.groupBy(bucket, method).agg(F.count(F.lit(1)).alias("n_paired"), F.avg(value).alias("acc"), F.avg(F.col(value) - F.col("base")).alias("delta"))
    return by.join(items, bucket)


def conflicts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one different value."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("values")).where("values > 1")


#: Values that the second column of a coverage matrix may have.
MATRIX_VALUES = 10_000


def coverage_matrix(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) combinations of the seen values that are missing; ``b`` is a dimension (methods, say) of at most
    ``MATRIX_VALUES`` values, which is checked, and ``a`` of any size."""
    few = stored(rows.select(b).distinct(), "dimension")
    if few.count() > MATRIX_VALUES:
        raise ValueError(f"{b} has more than {MATRIX_VALUES} values")
    grid = rows.select(a).distinct().crossJoin(F.broadcast(few))
    return grid.join(rows.select(a, b).distinct(), [a, b], "left_anti")


def answer_prior(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """(answer, n, share, top): distribution of the first answer of each item, and which answer is the most common."""
    first = rows.groupBy(key).agg(F.min_by(answer, "row_id").alias("answer"))
    by = first.groupBy("answer").agg(F.count(F.lit(1)).alias("n"))
    whole = by.agg(F.sum("n").alias("all"), F.max_by("answer", F.struct("n", "answer")).alias("best"))
    return by.crossJoin(F.broadcast(whole)).select("answer", "n", (F.col("n") / F.col("all")).alias("share"), (F.col("answer") == F.col("best")).alias("top"))


def prior_report(train: DataFrame, evaluated: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, acc, top_answer, prior_acc, sampling_acc, delta): each method against the prior of the answers.

    ``train(answer)`` and ``evaluated(answer)`` have one row an item; ``prior_acc`` is the share of evaluated items
    whose answer is the training rows' most common one (ties to the smaller), ``sampling_acc`` the expected accuracy
    of drawing answers by the prior: the sum of prior times evaluated share. Answers are a small dimension."""
    side = lambda d, n: d.groupBy("answer").agg(F.count(F.lit(1)).alias(n))
    both = side(train, "a").join(side(evaluated, "b"), "answer", "full").fillna(0, ["a", "b"])
    p, q = F.col("a") / F.nullif(F.col("na"), F.lit(0)), F.col("b") / F.nullif(F.col("nb"), F.lit(0))
    whole = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.min_by("answer", F.struct(-F.col("a"), F.col("answer"))).alias("top_answer"))
    prior = both.crossJoin(F.broadcast(whole)).agg(F.first("top_answer").alias("top_answer"), F.coalesce(F.sum(F.when(F.col("answer") == F.col("top_answer"), q)), F.lit(0.0)).alias("prior_acc"), F.coalesce(F.sum(p * q), F.lit(0.0)).alias("sampling_acc"))
    return methods.select("method", "acc").crossJoin(F.broadcast(prior)).withColumn("delta", F.col("acc") - F.col("prior_acc"))


def average_ranks(rows: DataFrame, value: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Ranks from 1, ties sharing their mean rank; nulls come first. Keys too large for a window go by ranges."""
    keys = keys or []
    by = Window.partitionBy(*keys)
    local = lambda own: own.withColumn(out, F.rank().over(by.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2)

    def ranged(own: DataFrame) -> DataFrame:
        counted = stored(own.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n")), "values")
        ranks = R.value_ranks(counted, keys, "__v", "__n", out)
        return R.join_apart(own.withColumn("__v", F.col(value)), R.join_same(ranks, counted, [*keys, "__v"]), [*keys, "__v"], "__n").drop("__v")

    return R.by_size(rows, keys, local, ranged)


def _corr(x: str, y: str) -> Column:
    """Pearson's r; null without variance, where ``corr`` would raise."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _ranged_correlations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``correlations`` of x and y for large keys: equal pairs are counted first, ranks come from ranges of values."""
    pairs = R.pair_ranks(rows, keys, "x", "y")
    n, w = F.sum("c"), F.col("c")
    means = stored(pairs.groupBy(*keys).agg(n.alias("n"), (F.sum(w * F.col("x")) / n).alias("mx"), (F.sum(w * F.col("y")) / n).alias("my")), "means")
    joined = R.join_same(pairs, means, keys) if keys else pairs.crossJoin(F.broadcast(means))
    middle = (F.col("n") + 1) / 2
    spread = {"x": F.col("x") - F.col("mx"), "y": F.col("y") - F.col("my"), "rx": F.col("rx") - middle, "ry": F.col("ry") - middle}
    product = lambda a, b: F.sum(w * spread[a] * spread[b])
    r = lambda a, b: F.try_divide(product(a, b), F.sqrt(product(a, a)) * F.sqrt(product(b, b)))
    flat = (F.sqrt(product("x", "x") / n) <= 1e-12) | (F.sqrt(product("y", "y") / n) <= 1e-12)
    return joined.groupBy(*keys).agg(n.alias("n"), F.when(~flat, r("x", "y")).alias("pearson"), F.when(~flat, r("rx", "ry")).alias("spearman"))


def correlations(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, pearson, spearman) over pairs of numbers that are neither null nor NaN nor infinite; null under two
    pairs or without variance. Keys too large for a window go by ranges of values."""
    far = float("inf")
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    fine = rows.where(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < far) & (F.abs(b) < far)).select(*keys, a.alias("x"), b.alias("y"))

    def local(own: DataFrame) -> DataFrame:
        by = Window.partitionBy(*keys)
        rank = lambda c: F.rank().over(by.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2
        flat = (F.stddev_pop("x") <= 1e-12) | (F.stddev_pop("y") <= 1e-12)
        ranked = own.withColumns({"rx": rank("x"), "ry": rank("y")})
        return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(~flat, _corr("x", "y")).alias("pearson"), F.when(~flat, _corr("rx", "ry")).alias("spearman"))

    return R.by_size(fine, keys, local, lambda own: _ranged_correlations(own, keys))


def percentiles(rows: DataFrame, keys: list[str], value: str, ps: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    return quantile_columns(rows, keys, value, {f"p{round(p * 100)}": p for p in ps})


def histograms(rows: DataFrame, columns: list[str], value: str) -> DataFrame:
    """(dim, bin, n, mean) of several columns in one pass."""
    dims = F.inline(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("bin")) for c in columns]))
    return rows.select(F.col(value).alias("v"), dims).groupBy("dim", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


def average_precision(rows: DataFrame) -> DataFrame:
    """(class, ap) of (class, item, y, score): mean precision at the positives, ties by item; classes without
    positives are left out. Classes too large for a window go by ranges of (score, item)."""
    found = F.coalesce((F.col("y") == 1).cast("long"), F.lit(0))
    order = Window.partitionBy("class").orderBy(F.desc("score"), "item")
    local = lambda own: own.withColumn("r", F.row_number().over(order)).withColumn("tp", F.sum(found).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranged = lambda own: R.running(own, ["class"], [F.desc("score"), F.asc("item")], {"r": F.lit(1), "tp": found})
    ranked = R.by_size(rows.select("class", "item", "y", "score"), ["class"], local, ranged)
    return ranked.where("y = 1").groupBy("class").agg(F.avg(F.col("tp") / F.col("r")).alias("ap"))


def macro_f1(rows: DataFrame, threshold: float) -> DataFrame:
    """One row: the mean F1 of the classes at a threshold; a class with nothing true or predicted counts 0."""
    hot = F.col("score") >= threshold
    count = lambda c: F.sum(c.cast("int"))
    by = rows.groupBy("class").agg(count(hot & (F.col("y") == 1)).alias("tp"), count(hot & (F.col("y") == 0)).alias("fp"), count(~hot & (F.col("y") == 1)).alias("fn"))
    whole = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return by.agg(F.avg(F.when(whole > 0, 2 * F.col("tp") / whole).otherwise(0.0)).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def pareto(points: DataFrame, cost: str, gain: str) -> DataFrame:
    """The points that no cheaper or equally cheap point beats, by a running maximum over cost."""
    order = Window.orderBy(cost, F.desc(gain))
    return points.withColumn("__m", F.max(gain).over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("__m").isNull() | (F.col(gain) > F.col("__m"))).drop("__m")


def pick_config(rows: DataFrame, top: int = 3, max_p: float = 0.05) -> DataFrame:
    """(config, delta, p, pick): positive deltas with a small p first, then positive ones, then the rest, by delta.
    Both are compared to nine digits, so that configurations that do the same are tied whatever order their sums had."""
    tier = F.when((F.col("delta") > 0) & (F.col("p") < max_p), 0).when(F.col("delta") > 0, 1).otherwise(2)
    return rows.withColumn("pick", F.row_number().over(Window.orderBy(tier, F.round("delta", 9).desc(), F.round("p", 9), "config"))).where(F.col("pick") <= top)


def alpha_floor(rows: DataFrame, alpha: float) -> DataFrame:
    """Adds margin = anchored - alpha * uniform and ok."""
    return rows.withColumn("margin", F.col("anchored") - alpha * F.col("uniform")).withColumn("ok", F.col("margin") >= 0)


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order; an unknown value holds no rule."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))


def root_causes(facts: DataFrame, delta: float = 0.02, p: float = 0.05, gap: float = 0.02, fallback: float = 0.6, coverage: float = 0.2, corr: float = 0.2) -> DataFrame:
    """(config, reasons, proven): which of eight causes explain a missing gain, in their order of priority.

    ``facts(config, delta, p, oracle_gap, fallback, coverage, corr, alpha_fails, transfer)``; a fact that is null
    gives no cause. Proven: the gain reaches its target and is significant."""
    rules = {
        "gain_below_target": F.col("delta") < delta,
        "not_significant": F.col("p") >= p,
        "oracle_gap_large": F.col("oracle_gap") > gap,
        "fallback_frequent": F.col("fallback") > fallback,
        "coverage_low": F.col("coverage") < coverage,
        "alignment_weak": F.col("corr") < corr,
        "alpha_floor_broken": F.col("alpha_fails") > 0,
        "transfer_not_positive": F.col("transfer") <= 0,
    }
    return facts.select("config", reasons(rules).alias("reasons"), F.coalesce((F.col("delta") >= delta) & (F.col("p") < p), F.lit(False)).alias("proven"))


def sizes_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    whole = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("total"))
    return whole.join(quantile_columns(rows, keys, value, {"p10": 0.1, "median": 0.5, "p90": 0.9}), keys, "left")


def duration_audit(required: DataFrame, available: DataFrame, margin: float) -> DataFrame:
    """(video_id, need, have, status): missing, short (by more than the margin) or ok."""
    need = required.groupBy("video_id").agg(F.max("stop_s").alias("need"))
    status = F.when(F.col("have").isNull(), "missing").when(F.col("have") < F.col("need") - margin, "short").otherwise("ok")
    return need.join(available.select("video_id", "have"), "video_id", "left").withColumn("status", status)


def recall_of_grid(truth: DataFrame, anchors: DataFrame, delta: int, n: int) -> DataFrame:
    """(clip_id, recall) with 0 for clips without truth."""
    found = hits(truth, anchors, delta, n).groupBy("clip_id").agg(F.count(F.lit(1)).alias("hit"))
    all_ = truth.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    return anchors.select("clip_id").distinct().join(all_, "clip_id", "left").join(found, "clip_id", "left").select("clip_id", F.coalesce(F.col("hit") / F.col("n"), F.lit(0.0)).alias("recall"))
