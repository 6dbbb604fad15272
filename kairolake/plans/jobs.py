"""Composite jobs: whole evaluations as one DataFrame plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import anchors as K
from ..operators import budget as B
from ..operators import confidence as C
from ..operators import joins as J
from ..operators import perturb as D
from ..operators import seconds as S
from ..operators import series as T
from ..operators import stats as A
from ..operators import text as X


def score_methods(audio: DataFrame, visual: DataFrame) -> DataFrame:
    """(method, clip_id, t, score) of the cheap score methods."""
    return S.by_method(
        energy=audio, energy_delta=T.delta(audio), visual=visual, fuse_max=T.fuse(T.minmax(audio), T.minmax(visual)), fuse_prod=T.fuse(T.minmax(audio), T.minmax(visual), "prod"),
        suppressed=T.suppress(audio, T.minmax(visual)), by_variance=T.pick_by_variance(audio, visual), auto_shift=T.apply_lags(audio, T.best_lag(visual, audio, [-2, -1, 0, 1, 2])), smoothed=T.smooth(audio, 3),
    )


#: The score methods that a selection can be asked for by name.
METHODS = ("uniform", "random", "audio", "visual", "fused", "bm25", "tfidf", "embedding")


def build_scores(method: str, audio: DataFrame, visual: DataFrame, texts: DataFrame, query: DataFrame, vectors: DataFrame, asked: DataFrame, seed: int) -> DataFrame:
    """(clip_id, t, score) of one of ``METHODS``; an unknown name raises.

    ``audio`` and ``visual`` are (clip_id, t, score); ``texts(clip_id, t, text)`` and ``query(clip_id, text)`` feed the
    text relevances, ``vectors(clip_id, t, emb)`` and ``asked(clip_id, q)`` the embedding relevance."""
    docs, q = texts.select(F.col("clip_id").alias("grp"), F.col("t").alias("doc"), "text"), query.select(F.col("clip_id").alias("grp"), "text")
    by_text = lambda rows: rows.select(F.col("grp").alias("clip_id"), F.col("doc").alias("t"), "score")
    return {
        "uniform": lambda: audio.select("clip_id", "t", F.lit(1.0).alias("score")),
        "random": lambda: audio.select("clip_id", "t", K.hash_uniform(str(seed), F.col("clip_id"), F.col("t")).alias("score")),
        "audio": lambda: audio.select("clip_id", "t", "score"),
        "visual": lambda: visual.select("clip_id", "t", "score"),
        "fused": lambda: T.fuse(T.minmax(audio), T.minmax(visual)),
        "bm25": lambda: by_text(X.bm25_relevance(docs, q)),
        "tfidf": lambda: by_text(X.tfidf_relevance(docs, q)),
        "embedding": lambda: X.embedding_relevance(vectors, asked),
    }[method]()


def picks_by_method(scores: DataFrame, k: int, budget: int, alpha: float, radius: int, n: int) -> DataFrame:
    """(method, clip_id, picks) of (method, clip_id, t, score): anchors and the mixture of background, anchors and best
    scores for every method at once, as an array of (t, role). One shuffle brings a clip's scores of a method into one
    row; nothing is exploded in it."""
    rows = scores.groupBy("method", "clip_id").agg(F.collect_list(F.struct("t", "score")).alias("scores"))
    best = F.sort_array(F.transform("scores", lambda x: F.struct(x["score"].alias("score"), (-x["t"]).alias("earlier"))), asc=False)
    anchors = F.transform(F.slice(best, 1, k), lambda x, i: F.struct(i.alias("rank"), (-x["earlier"]).alias("t")))
    return S.mixed(rows.withColumn("anchors", anchors), budget, alpha, radius, n)


def select_by_method(scores: DataFrame, k: int, budget: int, alpha: float, radius: int, n: int) -> DataFrame:
    """(method, clip_id, t, role): the picks of ``picks_by_method``, a row each."""
    return picks_by_method(scores, k, budget, alpha, radius, n).select("method", "clip_id", F.inline("picks"))


def anchor_quality(audio: DataFrame, visual: DataFrame, truth: DataFrame, k: int, deltas: list[int], n: int, seed: int) -> DataFrame:
    """(method, delta, clips, recall) of every score method and a random control, in one job: the method is part of
    the clip's key, so all methods share each shuffle."""
    rows = score_methods(audio, visual).unionByName(audio.select(F.lit("random").alias("method"), "clip_id", "t", K.hash_uniform(str(seed), F.col("clip_id"), F.col("t")).alias("score")))
    keyed = rows.select(F.struct("method", "clip_id").alias("clip_id"), "t", "score")
    picks = K.top_k(keyed, k)
    gt = truth.where("gt <> 0").crossJoin(F.broadcast(rows.select("method").distinct())).select(F.struct("method", "clip_id").alias("clip_id"), "t")
    near = picks.select("clip_id", F.col("t").alias("a"), F.explode(F.sequence(F.lit(-max(deltas)), F.lit(max(deltas)))).alias("d")).select("clip_id", (F.col("a") + F.col("d")).alias("t"), F.abs("d").alias("d")).groupBy("clip_id", "t").agg(F.min("d").alias("d"))
    seen = gt.join(near, ["clip_id", "t"], "left")
    by = seen.groupBy("clip_id").agg(*[F.avg((F.coalesce("d", F.lit(n)) <= x).cast("double")).alias(f"r{x}") for x in deltas])
    pairs = F.inline(F.array(*[F.struct(F.lit(x).alias("delta"), F.col(f"r{x}").alias("r")) for x in deltas]))
    return by.select("clip_id.method", pairs).groupBy("method", "delta").agg(F.count(F.lit(1)).alias("clips"), F.avg("r").alias("recall"))


def plan_records(scores: DataFrame, k: int, n: int, low: int, base: int, high: int, **select) -> DataFrame:
    """(clip_id, anchors, conf_value, fallback_used, resolutions, tokens): selection and equal-budget plan by clip."""
    sel = K.select_anchors(scores, k, n, **select)
    plan = B.equal_budget_plan(sel.select("clip_id", "anchors"), n, low, base, high)
    by = plan.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "resolution"))), lambda x: x["resolution"]).alias("resolutions"), F.sum("tokens").alias("tokens"))
    return sel.join(by, "clip_id").select("clip_id", "anchors", "conf_value", "fallback_used", "resolutions", "tokens")


def long_plan(scores: DataFrame, k: int, n: int, radius: int, stride: int, max_steps: int) -> DataFrame:
    """(clip_id, pos, t, is_anchor): hybrid selection among the seconds that have a score, and those around anchors, with
    the anchors mapped to their positions."""
    anchors = K.top_k(scores, k)
    chosen = S.frame_manifest(S.hybrid_long(scores.select("clip_id").distinct(), anchors, radius, stride, max_steps, n, scores))
    return chosen.join(anchors.select("clip_id", "t", F.lit(True).alias("a")), ["clip_id", "t"], "left").select("clip_id", F.col("order").alias("pos"), "t", F.coalesce("a", F.lit(False)).alias("is_anchor"))


def baseline_plans(scores: DataFrame, truth: DataFrame, k: int, n: int, seed: int, low: int = 160, base: int = 224, high: int = 352, **select) -> DataFrame:
    """(baseline, clip_id, t, resolution, tokens) of the uniform, random, anchored and oracle plans."""
    clips = scores.select("clip_id").distinct()
    as_list = lambda rows: clips.join(rows.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"].cast("int")).alias("anchors")), "clip_id", "left").select("clip_id", F.coalesce("anchors", F.array().cast("array<int>")).alias("anchors"))
    plan = lambda sel: B.equal_budget_plan(sel.select("clip_id", "anchors"), n, low, base, high)
    plans = {"uniform": B.uniform_plan(clips, n, base), "random": plan(as_list(K.random_anchors(scores, k, seed))), "anchored": plan(K.select_anchors(scores, k, n, **select)), "oracle": plan(as_list(K.oracle_anchors(truth, k)))}
    out = None
    for name, p in plans.items():
        rows = p.select(F.lit(name).alias("baseline"), "clip_id", "t", "resolution", "tokens")
        out = rows if out is None else out.unionByName(rows)
    return out


def plan_proxy(plans: DataFrame, truth: DataFrame) -> DataFrame:
    """(baseline, clip_id, acc): share of the clip's tokens that its event seconds get; a cheap stand-in for a head
    in sweeps (clips without events are left out)."""
    rows = plans.join(truth.select("clip_id", "t", "gt"), ["clip_id", "t"])
    return rows.groupBy("baseline", "clip_id").agg(F.sum(F.when(F.col("gt") != 0, F.col("tokens")).otherwise(0)).alias("on"), F.sum("tokens").alias("all"), F.max("gt").alias("any")).where("any <> 0").select("baseline", "clip_id", (F.col("on") / F.col("all")).alias("acc"))


def paired_report(results: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, delta, t, p of baseline a over b, paired by clip."""
    pairs = J.paired(results, "clip_id", "baseline", "acc", a, b)
    return A.paired_t(pairs.withColumn("pair", F.lit(f"{a}_vs_{b}")), ["pair"], "b", "a")


def config_sweep(scores: DataFrame, truth: DataFrame, configs: DataFrame, n: int) -> DataFrame:
    """(config, clips, anchored, delta, p): every config's anchored token share on events against the uniform one.

    ``configs(config, k, threshold)`` is broadcast; scores are ranked and confidence is computed once for all
    configs, and only (clip, t, rank) is multiplied by them."""
    conf = C.confidence(scores).select("clip_id", F.col("std").alias("conf"))
    picks = K.top_k(scores, 8).join(conf, "clip_id")
    swept = J.sweep(picks, configs).where((F.col("rank") <= F.col("k")) & (F.col("conf") >= F.col("threshold")))
    hits = swept.join(truth.where("gt <> 0").select("clip_id", "t"), ["clip_id", "t"]).groupBy("config", "clip_id").agg(F.count(F.lit(1)).alias("hit"))
    events = truth.groupBy("clip_id").agg(F.sum((F.col("gt") != 0).cast("int")).alias("events")).where("events > 0")
    used = swept.groupBy("config", "clip_id").agg(F.count(F.lit(1)).alias("used"))
    grid = J.sweep(events, configs.select("config")).join(used, ["config", "clip_id"], "left").join(hits, ["config", "clip_id"], "left")
    by = grid.select("config", "clip_id", F.coalesce(F.coalesce("hit", F.lit(0)) / F.col("used"), F.col("events") / n).alias("y"), (F.col("events") / n).alias("x"))
    return A.paired_t(by, ["config"], "x", "y")


def degradation(scores: DataFrame, cells: DataFrame, k: int, deltas: list[int], n: int, seed: int) -> DataFrame:
    """(shift, snr, silence, delta, clips, recall) over a perturbation grid, in one pass over the clips."""
    return D.recall_grid(scores, cells, k, deltas, n, seed)


def promoted_on_test(scores: DataFrame, truth: DataFrame, configs: DataFrame, n: int, test) -> DataFrame:
    """(config, val_delta, test_delta, test_n): the configuration that the sweep on the validation clips picks, on the
    clips where ``test`` holds."""
    pick = A.pick_config(config_sweep(scores.where(~test), truth.where(~test), configs, n).select("config", "delta", "p"), top=1).select("config", F.col("delta").alias("val_delta"))
    again = config_sweep(scores.where(test), truth.where(test), configs, n).select("config", F.col("delta").alias("test_delta"), F.col("n").alias("test_n"))
    return again.join(F.broadcast(pick), "config")


def paired_by_clip(results: DataFrame) -> DataFrame:
    """(a, b, n, delta, t, p): every two baselines of (seed, baseline, clip_id, acc), paired by seed and clip."""
    by = results.select("seed", "clip_id", F.col("baseline").alias("a"), F.col("acc").alias("x"))
    pairs = by.join(by.select("seed", "clip_id", F.col("a").alias("b"), F.col("x").alias("y")), ["seed", "clip_id"]).where("a < b")
    return A.paired_t(pairs, ["a", "b"], "y", "x")
