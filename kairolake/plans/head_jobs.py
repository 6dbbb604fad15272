"""Composite jobs with fitted heads: plans of many variants, one grouped fit, accuracy by seed and clip.

A variant is a baseline under a configuration and a resolution triad. All variants share the ranking of the seconds,
the confidence of the clips and the passes of one fit; only a clip's row of ranked seconds is multiplied by them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import spread, stored
from ..operators import anchors as K
from ..operators import budget as B
from ..operators import confidence as C
from ..operators import heads as H
from ..operators import joins as J
from ..operators import perturb as D
from ..operators import stats as A

#: Share of the fitting clips that each seed draws.
DRAWN = 0.9


class Variant(NamedTuple):
    """``kind``: uniform, uniform_low, random, anchored or oracle; ``extra``: side features are appended; a threshold
    of 0 or less switches the gate of the anchors off."""

    name: str
    kind: str
    k: int = 2
    threshold: float = 0.0
    triad: tuple[int, int, int] = (160, 224, 352)
    extra: bool = False


def whole_triads(resolutions: list[int]) -> list[tuple[int, int, int]]:
    """The triads low < base < high in which whole base seconds pay for a high one."""
    out, known = [], sorted(resolutions)
    for i, low in enumerate(known):
        for j, base in enumerate(known[i + 1 :], i + 1):
            out += [(low, base, high) for high in known[j + 1 :] if (B.tokens(high) - B.tokens(low)) % (B.tokens(base) - B.tokens(low)) == 0]
    return out


def variant_plans(scores: DataFrame, truth: DataFrame, variants: list[Variant], n: int, seed: int) -> DataFrame:
    """(g, clip_id, t, resolution, tokens): the plan of every variant, ``g`` being its place in the list.

    ``scores(clip_id, t, score)``, ``truth(clip_id, t, gt)``; clips without truth have no oracle anchors."""
    spark = scores.sparkSession
    in_order = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key.alias("o"), F.col("t").cast("int").alias("t")))), lambda p: p["t"])
    ranked = scores.groupBy("clip_id").agg(in_order(-F.col("score")).alias("best"), in_order(K.hash_uniform(str(seed), F.col("clip_id"), F.col("t"))).alias("drawn"))
    oracle = truth.where("gt <> 0").groupBy("clip_id").agg(in_order(F.col("t")).alias("events"))
    clips = ranked.join(spread(C.confidence(scores).select("clip_id", F.col("std").alias("conf"))), "clip_id").join(spread(oracle), "clip_id", "left")
    dimension = spark.createDataFrame([(g, v.kind, v.k, float(v.threshold), *v.triad) for g, v in enumerate(variants)], "g int, kind string, k int, threshold double, low int, base int, high int")
    none = F.array().cast("array<int>")
    trusted = (F.col("threshold") <= 0) | (F.col("conf") >= F.col("threshold"))
    picks = F.when((F.col("kind") == "anchored") & trusted, F.slice("best", 1, F.col("k"))).when(F.col("kind") == "random", F.slice("drawn", 1, F.col("k"))).when(F.col("kind") == "oracle", F.slice(F.coalesce("events", none), 1, F.col("k"))).otherwise(none)
    keyed = J.sweep(clips, dimension).select(F.struct("g", "clip_id").alias("clip_id"), picks.alias("anchors"), "low", "base", "high")
    triads = sorted({v.triad for v in variants})
    keyed = stored(keyed, "picks") if len(triads) > 1 else keyed
    plans = None
    for low, base, high in triads:
        own = keyed.where((F.col("low") == low) & (F.col("base") == base) & (F.col("high") == high))
        plan = B.equal_budget_plan(own.select("clip_id", "anchors"), n, low, base, high).withColumn("low", F.lit(low))
        plans = plan if plans is None else plans.unionByName(plan)
    cheap = [g for g, v in enumerate(variants) if v.kind == "uniform_low"]
    resolution = F.when(F.col("clip_id.g").isin(cheap), F.col("low")).otherwise(F.col("resolution")) if cheap else F.col("resolution")
    return plans.select("clip_id.g", "clip_id.clip_id", "t", resolution.alias("resolution")).withColumn("tokens", B.tokens_of(F.col("resolution")))


def variant_rows(plans: DataFrame, features: DataFrame, truth: DataFrame, variants: list[Variant], extra: DataFrame | None = None) -> DataFrame:
    """(g, clip_id, t, tokens, features, label), written once: each planned second with the features of its resolution
    (clip_id, t, resolution, features), for variants with ``extra`` followed by ``extra(clip_id, t, extra)``."""
    wide = [g for g, v in enumerate(variants) if v.extra]
    if wide and extra is None:
        raise ValueError("variants with side features need them")
    rows = plans.join(spread(features), ["clip_id", "t", "resolution"]).join(spread(truth.select("clip_id", "t", F.col("gt").alias("label"))), ["clip_id", "t"])
    if wide:
        rows = rows.join(spread(extra.select("clip_id", "t", "extra")), ["clip_id", "t"], "left")
        rows = rows.where(~F.col("g").isin(wide) | F.col("extra").isNotNull()).withColumn("features", F.when(F.col("g").isin(wide), F.concat("features", "extra")).otherwise(F.col("features")))
    return stored(rows.select("g", "clip_id", "t", "tokens", "features", "label"), "variants")


def head_accuracy(rows: DataFrame, variants: list[Variant], seeds: int, train: Column, test: Column) -> DataFrame:
    """(variant, seed, clip_id, acc): share of a clip's seconds that the variant's head gets right.

    Every variant and seed has a head of its own, fitted on the clips of ``train`` that the seed draws by hash, and
    answers for the clips of ``test``; all are fitted together."""
    member = F.array(*[(K.hash_uniform(str(s), F.col("clip_id")) < DRAWN).cast("double") for s in range(seeds)])
    heads = H.fit_heads(rows.where(train).select("g", "features", F.col("label").alias("y"), member.alias("member")), seeds)
    right = F.transform("p", lambda p: ((p >= 0.5).cast("int") == F.col("label")).cast("double"))
    answered = H.scored(rows.where(test), heads).select("g", "clip_id", right.alias("right"))
    by = answered.groupBy("g", "clip_id").agg(F.array(*[F.avg(F.col("right")[s]) for s in range(seeds)]).alias("acc"))
    names = rows.sparkSession.createDataFrame([(g, v.name) for g, v in enumerate(variants)], "g int, variant string")
    return by.join(F.broadcast(names), "g").select("variant", F.posexplode("acc").alias("seed", "acc"), "clip_id").select("variant", "seed", "clip_id", "acc")


def by_seed(results: DataFrame) -> DataFrame:
    """(variant, seed, acc): means over the clips, to twelve digits, so that variants that do the same are tied whatever
    order their sums had."""
    return results.groupBy("variant", "seed").agg(F.round(F.avg("acc"), 12).alias("acc"))


def against(means: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(variant, base, n, delta, t, p): for each (variant, base) how much better the variant is, paired by seed. The
    means have a row for each variant and seed, so they are small enough to be broadcast."""
    wanted = means.sparkSession.createDataFrame(pairs, "variant string, base string")
    base = means.select(F.col("variant").alias("base"), "seed", F.col("acc").alias("base_acc"))
    return A.paired_t(means.join(F.broadcast(wanted), "variant").join(F.broadcast(base), ["base", "seed"]), ["variant", "base"], "base_acc", "acc")


BASELINES = [
    Variant("uniform", "uniform"), Variant("uniform_low", "uniform_low"), Variant("random", "random"), Variant("anchored", "anchored"), Variant("oracle", "oracle"),
    Variant("concat_uniform", "uniform", extra=True), Variant("concat_anchored", "anchored", extra=True),
]


def planned_rows(scores: DataFrame, truth: DataFrame, features: DataFrame, variants: list[Variant], n: int, extra: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """``variant_rows`` of the variants' plans; ``extra`` is by default the score."""
    extra = scores.select("clip_id", "t", F.array("score").alias("extra")) if extra is None else extra
    return variant_rows(variant_plans(scores, truth, variants, n, seed), features, truth, variants, extra)


def equal_budget(scores: DataFrame, truth: DataFrame, features: DataFrame, n: int, seeds: int, train: Column, test: Column, variants: list[Variant] = BASELINES) -> DataFrame:
    """(variant, seed, clip_id, acc) of the baselines at an equal token budget."""
    return head_accuracy(planned_rows(scores, truth, features, variants, n), variants, seeds, train, test)


def config_variants(configs: list[tuple[int, int, float]]) -> list[Variant]:
    """The uniform baseline and one anchored variant for each (config, k, threshold)."""
    return [Variant("uniform", "uniform"), *(Variant(str(c), "anchored", k, threshold) for c, k, threshold in configs)]


def _configs(means: DataFrame, configs: list[int]) -> DataFrame:
    return against(means, [(str(c), "uniform") for c in configs]).select(F.col("variant").try_cast("int").alias("config"), "n", "delta", "t", "p")


def sweep(scores: DataFrame, truth: DataFrame, features: DataFrame, configs: list[tuple[int, int, float]], n: int, seeds: int, train: Column, test: Column) -> DataFrame:
    """(config, n, delta, t, p): each configuration's head against the uniform one, paired by seed."""
    means = by_seed(equal_budget(scores, truth, features, n, seeds, train, test, config_variants(configs)))
    return _configs(stored(means, "means"), [c for c, _, _ in configs])


def promote(scores: DataFrame, truth: DataFrame, features: DataFrame, configs: list[tuple[int, int, float]], n: int, few: int, seeds: int, train: Column, val: Column, test: Column, top: int = 3) -> DataFrame:
    """(config, pick, few_delta, val_delta, val_p, best, test_delta, test_p): successive promotion.

    All configurations are fitted with ``few`` seeds and ranked on ``val``; the ``top`` ones are fitted with all
    seeds; the one that is then best on ``val`` is marked, and all promoted ones are reproduced on ``test``. Plans and
    features are made once; the second fit reads only the promoted variants' rows."""
    variants = config_variants(configs)
    rows = planned_rows(scores, truth, features, variants, n)
    first = _configs(stored(by_seed(head_accuracy(rows, variants, few, train, val)), "means"), [c for c, _, _ in configs])
    picked = A.pick_config(first, top).select("config", "pick", F.col("delta").alias("few_delta"))
    chosen = [(r["config"], r["pick"], r["few_delta"]) for r in picked.collect()]  # ``top`` rows
    places = {v.name: g for g, v in enumerate(variants)}
    kept = rows.where(F.col("g").isin(places["uniform"], *(places[str(c)] for c, _, _ in chosen)))
    results = stored(head_accuracy(kept, variants, seeds, train, val | test), "promoted")
    on_val, on_test = (_configs(stored(by_seed(results.where(split)), "means"), [c for c, _, _ in chosen]) for split in (val, test))
    best = A.pick_config(on_val.select("config", "delta", "p"), 1).select("config", F.lit(True).alias("best"))
    out = on_val.select("config", F.col("delta").alias("val_delta"), F.col("p").alias("val_p")).join(on_test.select("config", F.col("delta").alias("test_delta"), F.col("p").alias("test_p")), "config")
    listed = rows.sparkSession.createDataFrame(chosen, "config int, pick int, few_delta double")
    return out.join(F.broadcast(listed), "config").join(F.broadcast(best), "config", "left").withColumn("best", F.coalesce("best", F.lit(False)))


def triad_grid(triads: list[tuple[int, int, int]], kinds: list[str], k: int = 2) -> list[Variant]:
    return [Variant(f"{'-'.join(map(str, triad))}/{kind}", kind, k, 0.0, triad) for triad in triads for kind in kinds]


def pareto_grid(scores: DataFrame, truth: DataFrame, features: DataFrame, triads: list[tuple[int, int, int]], kinds: list[str], n: int, seeds: int, train: Column, test: Column) -> DataFrame:
    """(variant, tokens, n, acc, std, low, high, frontier): accuracy over seeds with its bootstrap interval and mean
    tokens a clip of every triad and baseline; ``frontier`` marks those that no cheaper one reaches."""
    variants = triad_grid(triads, kinds)
    rows = planned_rows(scores, truth, features, variants, n)
    means = stored(by_seed(head_accuracy(rows, variants, seeds, train, test)), "means")
    names = rows.sparkSession.createDataFrame([(g, v.name) for g, v in enumerate(variants)], "g int, variant string")
    cost = rows.where(test).groupBy("g", "clip_id").agg(F.sum("tokens").alias("tokens")).groupBy("g").agg(F.avg("tokens").alias("tokens")).join(F.broadcast(names), "g").drop("g")
    points = A.mean_std(means, ["variant"], "acc").select("variant", F.round("mean", 9).alias("acc"), "std").join(cost, "variant")
    best = A.pareto(points.select("variant", "tokens", "acc"), "tokens", "acc").select("variant", F.lit(True).alias("frontier"))
    interval = A.bootstrap(means, ["variant"], "seed", "acc").select("variant", "n", "low", "high")
    return points.join(interval, "variant").join(best, "variant", "left").withColumn("frontier", F.coalesce("frontier", F.lit(False)))


def _seed_means(answered: DataFrame, keys: list[str], seeds: int) -> DataFrame:
    """Means of ``right``, one a seed, by the keys."""
    return answered.groupBy(*keys).agg(F.array(*[F.avg(F.col("right")[s]) for s in range(seeds)]).alias("acc"))


def sample_degradation(samples: DataFrame, truth: DataFrame, features: DataFrame, cells: list[tuple[float, float, float]], alphas: list[float], k: int, n: int, rate: int, seeds: int, train: Column, test: Column, threshold: float = 0.0, deltas: tuple[int, ...] = (0, 1, 2), triad: tuple[int, int, int] = (160, 224, 352), salt: str = "alpha", seed: int = 7) -> DataFrame:
    """(cell, alpha, seed, acc_uniform, acc_random, acc_anchored, forced, fallback, recall_0, ...): what anchors are worth
    when the samples they come from are shifted, noisy and partly silent.

    Uniform, random and anchored heads are fitted on clean clips of ``train``. On the clips of ``test`` the anchors of
    each cell come from its degraded samples; a clip whose degraded scores deviate less than ``threshold`` falls back to
    the uniform plan, and so does the share ``alpha`` of all clips, drawn by hash. Recall counts the clips with events.
    All figures come from one set of degraded scores; an alpha only picks between two accuracies of a clip."""
    spark = samples.sparkSession
    low, base, high = triad
    scores = stored(D.degraded_energy(samples, [(0.0, float("inf"), 0.0), *cells], rate, n, seed), "degraded")
    clean = scores.where("cell = 0").drop("cell")
    variants = [Variant("uniform", "uniform", k, 0.0, triad), Variant("random", "random", k, 0.0, triad), Variant("anchored", "anchored", k, threshold, triad)]
    rows = planned_rows(clean, truth, features, variants, n, seed=seed)
    member = F.array(*[(K.hash_uniform(str(s), F.col("clip_id")) < DRAWN).cast("double") for s in range(seeds)])
    heads = H.fit_heads(rows.where(train).select("g", "features", F.col("label").alias("y"), member.alias("member")), seeds)

    in_order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("t").alias("t")))), lambda p: p["t"])
    best = scores.where(test & (F.col("cell") > 0)).groupBy("cell", "clip_id").agg(F.slice(in_order, 1, k).alias("anchors"), (F.stddev_pop("score") < threshold).alias("low"))
    picks = stored(best.select("cell", "clip_id", F.when(F.col("low") & F.lit(threshold > 0), F.array().cast("array<int>")).otherwise(F.col("anchors")).alias("anchors"), (F.col("low") & F.lit(threshold > 0)).alias("fallback")), "picks")
    plan = B.equal_budget_plan(picks.select(F.struct("cell", "clip_id").alias("clip_id"), "anchors"), n, low, base, high).select("clip_id.cell", "clip_id.clip_id", "t", "resolution")
    degraded = plan.join(spread(features), ["clip_id", "t", "resolution"]).join(spread(truth.select("clip_id", "t", F.col("gt").alias("label"))), ["clip_id", "t"])
    known = rows.where(test).select("g", "clip_id", "features", "label")
    uniform = known.where("g = 0")
    asked = known.select("g", F.lit("own").alias("plan"), F.lit(0).alias("cell"), "clip_id", "features", "label")
    asked = asked.unionByName(uniform.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("g"), F.lit("uniform").alias("plan"), F.lit(0).alias("cell"), "clip_id", "features", "label"))
    asked = asked.unionByName(degraded.select(F.lit(2).alias("g"), F.lit("degraded").alias("plan"), "cell", "clip_id", "features", "label"))
    right = F.transform("p", lambda p: ((p >= 0.5).cast("int") == F.col("label")).cast("double"))
    acc = stored(_seed_means(H.scored(asked, heads).select("g", "plan", "cell", "clip_id", right.alias("right")), ["g", "plan", "cell", "clip_id"], seeds), "accuracy")
    fixed = acc.where("plan <> 'degraded'").groupBy("clip_id").agg(*[F.first(F.when((F.col("g") == g) & (F.col("plan") == p), F.col("acc")), ignorenulls=True).alias(f"{v}_{p}") for g, v, p in ((0, "uniform", "own"), (1, "random", "own"), (1, "random", "uniform"), (2, "anchored", "uniform"))])

    events = truth.where("gt <> 0").groupBy("clip_id").agg(F.collect_set(F.col("t").cast("int")).alias("events"))
    share = lambda d: F.aggregate("events", F.lit(0.0), lambda a, t: a + F.exists("anchors", lambda u: F.abs(u - t) <= d).cast("double")) / F.size("events")
    clips = picks.join(spread(acc.where("plan = 'degraded'").select("cell", "clip_id", "acc")), ["cell", "clip_id"]).join(spread(fixed), "clip_id").join(spread(events), "clip_id", "left").select("*", *[share(d).alias(f"recall_{d}") for d in deltas])
    grid = J.sweep(clips, spark.createDataFrame([(float(a),) for a in alphas], "alpha double"))
    forced = K.hash_uniform(F.col("clip_id"), salt) < F.col("alpha")
    grid = grid.select("cell", "alpha", forced.alias("forced"), "fallback", F.col("uniform_own").alias("u"), F.when(forced, F.col("random_uniform")).otherwise(F.col("random_own")).alias("r"), F.when(forced, F.col("anchored_uniform")).otherwise(F.col("acc")).alias("a"), *[F.when(forced & F.col(f"recall_{d}").isNotNull(), 0.0).otherwise(F.col(f"recall_{d}")).alias(f"recall_{d}") for d in deltas])
    means = [F.array(*[F.struct(*[F.round(F.avg(F.col(c)[s]), 12).alias(f"acc_{name}") for c, name in (("u", "uniform"), ("r", "random"), ("a", "anchored"))]) for s in range(seeds)]).alias("seeds")]
    by = grid.groupBy("cell", "alpha").agg(*means, F.avg(F.col("forced").cast("double")).alias("forced"), F.avg((F.col("fallback") & ~F.col("forced")).cast("double")).alias("fallback"), *[F.avg(f"recall_{d}").alias(f"recall_{d}") for d in deltas])
    dims = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(cells, 1)], "cell int, shift double, snr double, silence double")
    return by.join(F.broadcast(dims), "cell").select("shift", "snr", "silence", "alpha", F.posexplode("seeds").alias("seed", "s"), "forced", "fallback", *[f"recall_{d}" for d in deltas]).select("shift", "snr", "silence", "alpha", "seed", "s.*", "forced", "fallback", *[f"recall_{d}" for d in deltas])


def degradation_report(rows: DataFrame) -> DataFrame:
    """``sample_degradation`` by cell and alpha: mean accuracies over the seeds, deviation of the anchored one, and the
    floor check: margin = anchored - alpha * uniform, ok if it isn't below 0."""
    keys, kept = ["shift", "snr", "silence", "alpha"], [c for c in rows.columns if c in ("forced", "fallback") or c.startswith("recall_")]
    by = rows.groupBy(*keys).agg(*[F.avg(f"acc_{v}").alias(v) for v in ("uniform", "random", "anchored")], F.coalesce(F.stddev_samp("acc_anchored"), F.lit(0.0)).alias("std"), *[F.first(c).alias(c) for c in kept])
    margin = F.col("anchored") - F.col("alpha") * F.col("uniform")
    return by.withColumn("margin", margin).withColumn("ok", margin >= -1e-8)


def floor_summary(report: DataFrame, worst: int = 5) -> DataFrame:
    """One row: rows, passes, fails, min_margin, and the ``worst`` failing cells by margin."""
    failing = F.when(~F.col("ok"), F.struct("margin", "shift", "snr", "silence", "alpha"))
    return report.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("ok").cast("long")).alias("passes"), F.sum((~F.col("ok")).cast("long")).alias("fails"), F.min("margin").alias("min_margin"), F.slice(F.array_sort(F.collect_list(failing)), 1, worst).alias("worst"))
