"""Registered queries: learned scores and the composite jobs with fitted heads, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import anchors as K
from ..operators import learned as M
from ..operators import series as T
from ..operators import stats as A
from ..operators.heads import newton_sql
from ..views import SEG, SEGB, seg10, seg10b, table
from . import head_jobs as Q
from .jobs import paired_by_clip
from .queries_series import CONF, R6
from .queries_stats import boot_sql, t_sql

R4 = lambda c: F.round(c, 4)
SEEDS, FEW = 10, 2
N = 10
#: Whole-ratio triads of these resolutions are the grid of the ceiling and the Pareto jobs.
RESOLUTIONS = [96, 112, 160, 192, 224, 352, 384, 448]
CONFIGS = [(c, c % 2 + 1, c // 2 * 0.2) for c in range(24)]
GATES = [(c, 2, c * 0.25) for c in range(12)]


def _features_of(seconds, resolutions):
    """Embedding stand-in by resolution: scores seen through noise that falls with it."""
    rows = seconds.select("clip_id", "t", "score", F.explode(F.array(*map(F.lit, resolutions))).alias("resolution"))
    noise = K.hash_uniform("feat", F.col("clip_id"), F.col("t"), F.col("resolution")) * 400 / F.col("resolution")
    return rows.select("clip_id", "t", "resolution", F.array(F.col("score") + noise, F.col("resolution") / 100.0).alias("features"))


def _inputs(s, d):
    seconds = stored(seg10(s, d), "seconds")
    return seconds.select("clip_id", "t", "score"), seconds.select("clip_id", "t", "gt"), stored(_features_of(seconds, RESOLUTIONS), "features")


#: fitted on even clips; the sweeps use half of the others for choosing and half for reproducing
TRAIN, VAL, TEST = (lambda: F.col("clip_id") % 2 == 0), (lambda: F.col("clip_id") % 4 == 1), (lambda: F.col("clip_id") % 4 == 3)
REST = lambda: F.col("clip_id") % 2 == 1


def _budget(s, d):
    return stored(Q.equal_budget(*_inputs(s, d), N, SEEDS, TRAIN(), REST()), "accuracy")


_TOKS = lambda c: f"(({c} // 16) * ({c} // 16))"
_RATIO = f"(({_TOKS('hi')} - {_TOKS('lo')}) // ({_TOKS('ba')} - {_TOKS('lo')}))"


def _plan_sql(groups: str, anchors: str, pre: str) -> str:
    """CTEs that end in ``{pre}pl`` (the columns of ``groups`` (g, kind, lo, ba, hi, ..), clip_id, t, res): the
    equal-budget plans of ``anchors`` (g, clip_id, r, t, most) for every clip of seg."""
    return f"""{pre}ah as (select g, clip_id, least(count(*), max(most)) as kh from {anchors} group by 1, 2),
    {pre}gd as materialized (select va.*, c.clip_id, u.t, coalesce(kh, 0) as kh from {groups} va cross join (select distinct clip_id from seg) c cross join range({N}) u(t) left join {pre}ah ah on ah.g = va.g and ah.clip_id = c.clip_id),
    {pre}nr as (select gd.g, gd.clip_id, gd.t, min(abs(gd.t - an.t)) as near, coalesce(bool_or(gd.t = an.t and r <= kh), false) as is_high from {pre}gd gd left join {anchors} an on an.g = gd.g and an.clip_id = gd.clip_id group by 1, 2, 3),
    {pre}pc as (select gd.*, is_high, row_number() over (partition by gd.g, gd.clip_id, is_high order by near, gd.t) as place from {pre}gd gd join {pre}nr using (g, clip_id, t)),
    {pre}pl as materialized (select *, case when kind = 'uniform_low' then lo when kh = 0 then ba when is_high then hi when place <= {N} - kh * {_RATIO} then ba else lo end as res from {pre}pc)"""


def _feature_sql(res: str = "res") -> str:
    return f"score + ('0x' || substr(sha1('feat|' || clip_id || '|' || t || '|' || {res}), 1, 12))::ubigint / 281474976710656.0::double * 400 / {res} as x1, {res} / 100.0::double as x2"


def heads_sql(variants: list[Q.Variant], seeds: int, seg: str = SEG) -> str:
    """CTEs that end in ``ac`` (variant, seed, clip_id, acc) over all odd clips, and ``tk`` (variant, clip_id, tokens)."""
    values = ", ".join(f"({g}, '{v.name}', '{v.kind}', {v.k}, {v.threshold}, {v.triad[0]}, {v.triad[1]}, {v.triad[2]}, {str(v.extra).lower()})" for g, v in enumerate(variants))
    widths = sorted({2 + v.extra for v in variants})
    fits, scores = [], []
    for d in widths:
        xs = ", ".join(f"x{i}" for i in range(1, d + 1))
        fits.append(f"fit{d} as materialized (select g, s, {xs}, y from rw join hs using (clip_id) where ex = {str(d == 3).lower()}), {newton_sql(f'hd{d}', f'fit{d}', d, ['g', 's'])}")
        scores.append(f"select rw.g, h.s, clip_id, avg(case when (b + {' + '.join(f'w{i} * x{i}' for i in range(1, d + 1))} >= 0) = (y = 1) then 1.0 else 0.0 end) as acc from rw join hd{d} h on h.g = rw.g where ex = {str(d == 3).lower()} and clip_id % 2 = 1 group by 1, 2, 3")
    return f"""{seg}, {CONF}, va(g, name, kind, k, th, lo, ba, hi, ex) as (values {values}),
    pick as materialized (select 'anchored' as kind, clip_id, t, row_number() over (partition by clip_id order by score desc, t) as r from seg
      union all select 'random', clip_id, t, row_number() over (partition by clip_id order by ('0x' || substr(sha1('7|' || clip_id || '|' || t), 1, 12))::ubigint, t) from seg union all select 'oracle', clip_id, t, row_number() over (partition by clip_id order by t) from seg where gt <> 0),
    an as materialized (select g, p.clip_id, r, t, {N} // {_RATIO} as most from va join pick p on p.kind = va.kind and r <= k join cf on cf.clip_id = p.clip_id where va.kind <> 'anchored' or th <= 0 or std >= th),
    {_plan_sql("va", "an", "")},
    rw as materialized (select g, name, ex, clip_id, t, {_TOKS('res')} as tokens, gt as y, {_feature_sql()}, score as x3 from pl join seg using (clip_id, t)),
    hs as materialized (select clip_id, cast(s as int) as s from (select distinct clip_id from seg where clip_id % 2 = 0) cross join range({seeds}) r(s) where ('0x' || substr(sha1(s || '|' || clip_id), 1, 12))::ubigint / 281474976710656.0::double < {Q.DRAWN}),
    {", ".join(fits)},
    ac as materialized (select name as variant, s as seed, clip_id, acc from ({" union all ".join(scores)}) join va using (g)),
    tk as (select name as variant, clip_id, sum(tokens) as tokens from rw where clip_id % 2 = 1 group by 1, 2)"""


def _tested(source: str, name: str, where: str = "true", base: str = "'uniform'") -> str:
    """CTEs ``name`` (variant, n, delta, t, p) of the variants against their base by seed."""
    return f"""{name}m as (select variant, seed, round(avg(acc), 12) as acc from {source} where {where} group by 1, 2), {name}d as (select a.variant, a.acc - b.acc as d from {name}m a join {name}m b on b.seed = a.seed and b.variant = {base}),
    {t_sql(f'{name}d', 'variant', 'd', name)}"""


ORDER = "case when delta > 0 and p < 0.05 then 0 when delta > 0 then 1 else 2 end, round(delta, 9) desc, round(p, 9), try_cast(variant as int)"
_SWEPT = heads_sql(Q.config_variants(CONFIGS), SEEDS)
_TRIADS = Q.whole_triads(RESOLUTIONS)
_GRID = Q.triad_grid(_TRIADS, ["uniform", "anchored", "oracle"])
_GATED = Q.config_variants(GATES)


def _promoted(s, d):
    return Q.promote(*_inputs(s, d), CONFIGS, N, FEW, SEEDS, TRAIN(), VAL(), TEST())


_PROMOTED = f"""{_SWEPT}, {_tested('ac', 'fw', f'seed < {FEW} and clip_id % 4 = 1')},
    pk as (select try_cast(variant as int) as config, delta as few_delta, cast(row_number() over (order by {ORDER}) as int) as pick from fw where variant <> 'uniform'),
    {_tested('ac', 'vl', 'clip_id % 4 = 1')}, {_tested('ac', 'te', 'clip_id % 4 = 3')},
    pr as (select pk.*, vl.variant, vl.delta, vl.p from pk join vl on vl.variant = cast(pk.config as varchar) where pick <= 3)"""


def _ceiling(s, d):
    """(triad, k, acc, ceiling, t, p): how far the oracle's head is above the uniform one in every triad and k."""
    variants = [v._replace(name=f"{v.name}/{k}", k=k) for k in (1, 2) for v in Q.triad_grid(_TRIADS, ["uniform", "oracle"])]
    means = stored(Q.by_seed(Q.equal_budget(*_inputs(s, d), N, SEEDS, TRAIN(), REST(), variants)), "means")
    names = [v.name for v in variants if v.kind == "oracle"]
    tested = Q.against(means, [(x, x.replace("oracle", "uniform")) for x in names])
    return tested.join(F.broadcast(A.mean_std(means, ["variant"], "acc").select("variant", "mean", "std")), "variant")


_CEILING = heads_sql([v._replace(name=f"{v.name}/{k}", k=k) for k in (1, 2) for v in Q.triad_grid(_TRIADS, ["uniform", "oracle"])], SEEDS)


def _gates(s, d):
    """(threshold, fallback, delta, p, best): every threshold of the gate with the share of clips that fall back."""
    scores, truth, features = _inputs(s, d)
    swept = Q.sweep(scores, truth, features, GATES, N, SEEDS, TRAIN(), REST())
    from ..operators.confidence import confidence

    dims = s.createDataFrame([(c, float(th)) for c, _, th in GATES], "config int, threshold double")
    below = confidence(scores.where(REST())).select("std").crossJoin(F.broadcast(dims)).groupBy("config", "threshold").agg(F.avg((F.col("std") < F.col("threshold")).cast("double")).alias("fallback"))
    joined = stored(swept.join(below, "config").select("threshold", "config", R6("fallback").alias("fallback"), R6("delta").alias("delta"), R6("p").alias("p")), "gates")
    best = joined.agg(F.max_by("config", F.struct("delta", -F.col("p"), -F.col("config"))).alias("config")).withColumn("best", F.lit(True))
    return joined.join(F.broadcast(best), "config", "left").select("threshold", "fallback", "delta", "p", F.coalesce("best", F.lit(False)).alias("best"))


RATE = 8
CELLS = [(shift, snr, silence) for shift in (-0.5, 0.0, 1.0) for snr in (20.0, 0.0) for silence in (0.0, 0.3)]
ALPHAS = [0.0, 0.5]
GATE = 1.0


def _sample_inputs(s, d):
    """Samples of a user's values, eight to a second, with the purchases above 100 as events; features by resolution."""
    e = table(s, d, "events").select(F.col("user_id").alias("clip_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("idx"), F.col("value").alias("amp"), ((F.col("event_type") == "purchase") & (F.col("value") > 100)).cast("int").alias("hit"))
    e = stored(e, "samples")
    seconds = T.scaffold(e.select("clip_id").distinct(), N).join(e.groupBy("clip_id", F.floor(F.col("idx") / RATE).cast("int").alias("t")).agg(F.max("hit").alias("hit"), F.sum(F.col("amp") * F.col("amp")).alias("e")), ["clip_id", "t"], "left")
    seconds = stored(seconds.select("clip_id", "t", F.log(F.coalesce("e", F.lit(0.0)) / RATE + T.EPS).alias("score"), F.coalesce("hit", F.lit(0)).alias("gt")), "seconds")
    return e.select("clip_id", "idx", "amp"), seconds.select("clip_id", "t", "gt"), stored(_features_of(seconds, [160, 224, 352]), "features")


def _degraded(s, d):
    return stored(Q.sample_degradation(*_sample_inputs(s, d), CELLS, ALPHAS, 2, N, RATE, SEEDS, TRAIN(), REST(), GATE), "degradation")


_U = lambda key: f"('0x' || substr(sha1({key}), 1, 12))::ubigint / 281474976710656.0::double"
_SAMPLED = f"""smp as materialized (select user_id as clip_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, value as amp, case when event_type = 'purchase' and value > 100 then 1 else 0 end as hit from events),
    seg as materialized (select clip_id, cast(u.t as int) as t, ln(coalesce(e, 0) / {RATE} + 1e-12) as score, coalesce(gt, 0) as gt from (select distinct clip_id from smp) cross join range({N}) u(t) left join (select clip_id, idx // {RATE} as t, max(hit) as gt, sum(amp * amp) as e from smp group by 1, 2) using (clip_id, t))"""
DEGRADED = f"""with {heads_sql([Q.Variant("uniform", "uniform"), Q.Variant("random", "random"), Q.Variant("anchored", "anchored", 2, GATE)], SEEDS, _SAMPLED)},
    cl(cell, shift, b, snr, sil) as (values {", ".join(f"({i}, {c[0]}::double, {round(c[0] * RATE)}, {c[1]}::double, {c[2]}::double)" for i, c in enumerate(CELLS, 1))}),
    sz as (select clip_id, count(*) as n, {_U("'7|' || clip_id")} as u from smp group by 1),
    mv as (select cell, snr, sil, s.clip_id, s.idx, n, u, coalesce(o.amp, 0) as x from cl cross join smp s join sz on sz.clip_id = s.clip_id left join smp o on o.clip_id = s.clip_id and o.idx = s.idx - b),
    nz as (select *, x + sqrt(sum(x * x) over (partition by cell, clip_id) / n + 1e-12) / pow(10, snr / 20) * sqrt(-2 * ln(greatest({_U("'7|' || clip_id || '|' || idx || '|u'")}, 1e-12))) * cos(2 * pi() * {_U("'7|' || clip_id || '|' || idx || '|v'")}) as v, least(n, round(n * sil)) as len from mv),
    sl as (select cell, clip_id, idx // {RATE} as t, sum(case when idx >= floor(u * (n - len + 1)) and idx < floor(u * (n - len + 1)) + len then 0 else v * v end) as e from nz group by 1, 2, 3),
    ds as materialized (select cell, clip_id, u.t, ln(coalesce(e, 0) / {RATE} + 1e-12) as score from cl cross join (select distinct clip_id from seg where clip_id % 2 = 1) cross join range({N}) u(t) left join sl using (cell, clip_id, t)),
    dr as materialized (select cell, clip_id, t, row_number() over (partition by cell, clip_id order by score desc, t) as r, stddev_pop(score) over (partition by cell, clip_id) < {GATE} as low from ds),
    dv as (select cell as g, 'anchored' as kind, 160 as lo, 224 as ba, 352 as hi from cl), da as materialized (select cell as g, clip_id, r, t, 2 as most from dr where r <= 2 and not low),
    {_plan_sql("dv", "da", "d")},
    dw as (select g as cell, clip_id, t, gt as y, {_feature_sql()} from dpl join seg using (clip_id, t) where clip_id % 2 = 1),
    hit(cell, s, clip_id, plan, h, acc) as (select cell, s, clip_id, 'degraded', 2, avg(case when (b + w1 * x1 + w2 * x2 >= 0) = (y = 1) then 1.0 else 0.0 end) from dw join hd2 on hd2.g = 2 group by 1, 2, 3
      union all select 0, h.s, clip_id, case when h.g = rw.g then 'own' else 'uniform' end, h.g, avg(case when (b + w1 * x1 + w2 * x2 >= 0) = (y = 1) then 1.0 else 0.0 end) from rw join hd2 h on h.g = rw.g or rw.g = 0 where clip_id % 2 = 1 group by 1, 2, 3, 4, 5),
    fx as (select s, clip_id, max(acc) filter (where h = 0) as u, max(acc) filter (where h = 1 and plan = 'own') as r, max(acc) filter (where h = 1 and plan = 'uniform') as ru, max(acc) filter (where h = 2 and plan = 'uniform') as au from hit where plan <> 'degraded' group by 1, 2),
    re as (select cell, s.clip_id, {", ".join(f"avg(case when near <= {x} then 1.0 else 0.0 end) as recall_{x}" for x in range(3))} from (select cl.cell, s.clip_id, s.t, coalesce(min(abs(s.t - da.t)), 99) as near from cl cross join seg s left join da on da.g = cl.cell and da.clip_id = s.clip_id where s.gt <> 0 group by 1, 2, 3) s group by 1, 2),
    gr as (select d.cell, a.alpha, d.s, d.clip_id, {_U("d.clip_id || '|alpha'")} < a.alpha as forced, low, u, r, ru, au, d.acc, {", ".join(f"recall_{x}" for x in range(3))}
      from hit d join (select distinct cell, clip_id, low from dr) using (cell, clip_id) join fx on fx.s = d.s and fx.clip_id = d.clip_id left join re on re.cell = d.cell and re.clip_id = d.clip_id cross join (values {", ".join(f"({a}::double)" for a in ALPHAS)}) a(alpha) where d.plan = 'degraded'),
    sd as (select cell, alpha, s as seed, round(avg(u), 12) as uniform, round(avg(case when forced then ru else r end), 12) as random, round(avg(case when forced then au else acc end), 12) as anchored, avg(case when forced then 1.0 else 0.0 end) as forced, avg(case when low and not forced then 1.0 else 0.0 end) as fallback,
      {", ".join(f"avg(case when recall_{x} is null then null when forced then 0 else recall_{x} end) as recall_{x}" for x in range(3))} from gr group by 1, 2, 3),
    rp as materialized (select shift, snr, sil as silence, alpha, avg(uniform) as uniform, avg(random) as random, avg(anchored) as anchored, coalesce(stddev_samp(anchored), 0) as std, max(forced) as forced, max(fallback) as fallback, {", ".join(f"max(recall_{x}) as recall_{x}" for x in range(3))}, avg(anchored) - alpha * avg(uniform) as margin from sd join cl using (cell) group by 1, 2, 3, 4)"""


FUSION = ["uniform", "anchored", "concat_uniform", "concat_anchored", "oracle"]


def _labelled(s, d):
    """Features and the event flag of each second."""
    return T.delta(seg10(s, d)).select("clip_id", "t", F.col("score").alias("d")).join(seg10(s, d), ["clip_id", "t"]).join(seg10b(s, d).select("clip_id", "t", F.col("score").alias("b")), ["clip_id", "t"]).select("clip_id", "t", F.array("score", "d", "b").alias("features"), F.col("gt").alias("label"))


LABELLED = f"{SEG}, {SEGB}, lb as materialized (select seg.clip_id, seg.t, seg.score as x1, coalesce(abs(seg.score - lag(seg.score) over (partition by seg.clip_id order by seg.t)), 0) as x2, segb.score as x3, gt as y from seg join segb on segb.clip_id = seg.clip_id and segb.t = seg.t)"


def _predicted(rows, fit):
    """(clip_id, t, label, p): fitted on the clips with even ids, answered for all."""
    return M.predict(fit(rows.where("clip_id % 2 = 0")), rows).select("clip_id", "t", "label", R4("p").alias("p"))


def _usefulness(s, d):
    """Features of a second and what the views and clicks alone add to its score."""
    return _labelled(s, d).select("clip_id", "t", "features", (F.col("features")[0] - 0.5 * F.col("features")[2] + 0.1 * F.col("label")).alias("label"))


def ridge_sql(rows: str, d: int, ridge: float = 1e-3) -> str:
    """CTE ``rg`` (w1 to wd, b): least squares of y on standardised x1 to xd with a ridge, by a Cholesky factorisation."""
    n = d + 1
    z = [f"z{i}" for i in range(1, n)] + ["1"]
    sums = [f"avg(y * {z[i]}) as g{i + 1}" for i in range(n)] + [f"avg({z[i]} * {z[j]}){f' + {ridge}' if i == j and i < d else ''} as h{i + 1}_{j + 1}" for i in range(n) for j in range(i + 1)]
    solve = []
    for i in range(1, n + 1):
        for j in range(1, i + 1):
            rest = "".join(f" - l{i}_{q} * l{j}_{q}" for q in range(1, j))
            solve.append(f"sqrt(h{i}_{i}{rest}) as l{i}_{i}" if i == j else f"(h{i}_{j}{rest}) / l{j}_{j} as l{i}_{j}")
    solve += [f"(g{i}{''.join(f' - l{i}_{q} * f{q}' for q in range(1, i))}) / l{i}_{i} as f{i}" for i in range(1, n + 1)]
    solve += [f"(f{i}{''.join(f' - l{q}_{i} * t{q}' for q in range(i + 1, n + 1))}) / l{i}_{i} as t{i}" for i in range(n, 0, -1)]
    moments = ", ".join(f"avg(x{i}) as m{i}, case when stddev_pop(x{i}) > 1e-12 then stddev_pop(x{i}) else 1.0 end as s{i}" for i in range(1, n))
    return f"""rgm as (select {moments} from {rows}), rgz as (select y, {', '.join(f'(x{i} - m{i}) / s{i} as z{i}' for i in range(1, n))} from {rows} cross join rgm),
    rg as materialized (select {', '.join(f't{i} / s{i} as w{i}' for i in range(1, n))}, t{n} - ({' + '.join(f't{i} * m{i} / s{i}' for i in range(1, n))}) as b from (select *, {', '.join(solve)} from (select {', '.join(sums)} from rgz)) cross join rgm)"""


QUERIES = {
    "m01_logistic_eventness": (
        lambda s, d: _predicted(_labelled(s, d), M.logistic),
        f"with {LABELLED}, lf as (select 0 as g, x1, x2, x3, y from lb where clip_id % 2 = 0), {newton_sql('lh', 'lf', 3, ['g'])} select clip_id, t, y as label, round(1 / (1 + exp(-(b + w1 * x1 + w2 * x2 + w3 * x3))), 4) as p from lb cross join lh",
    ),
    "m02_mlp_eventness": (lambda s, d: _predicted(_labelled(s, d), lambda rows: M.mlp(rows, [3, 8, 2])), None),
    "m05_temporal_head": (lambda s, d: _predicted(M.with_context(_labelled(s, d), 1), lambda rows: M.mlp(rows, [9, 8, 2])), None),
    "m07_usefulness_regressor": (
        lambda s, d: M.regress(_usefulness(s, d)).select("clip_id", "t", R4("label").alias("label"), R4("prediction").alias("prediction")),
        f"with {LABELLED}, us as (select clip_id, t, x1, x2, x3, x1 - 0.5 * x3 + 0.1 * y as y from lb), {ridge_sql('us', 3)} select clip_id, t, round(y, 4) as label, round(b + w1 * x1 + w2 * x2 + w3 * x3, 4) as prediction from us cross join rg",
    ),
    "q05_equal_budget": (
        lambda s, d: _budget(s, d).groupBy("seed", F.col("variant").alias("baseline")).agg(F.count(F.lit(1)).alias("n"), R6(F.avg("acc")).alias("acc")),
        f"with {heads_sql(Q.BASELINES, SEEDS)} select seed, variant as baseline, count(*) as n, round(avg(acc), 6) as acc from ac group by 1, 2",
    ),
    "q05_pairs": (
        lambda s, d: paired_by_clip(_budget(s, d).withColumnRenamed("variant", "baseline")).select("a", "b", "n", *[R6(c).alias(c) for c in ("delta", "t", "p")]),
        f"with {heads_sql(Q.BASELINES, SEEDS)}, dd as (select a.variant as a, b.variant as b, a.acc - b.acc as d from ac a join ac b on b.seed = a.seed and b.clip_id = a.clip_id and a.variant < b.variant), {t_sql('dd', 'a, b', 'd')} select a, b, n, round(delta, 6) as delta, round(t, 6) as t, round(p, 6) as p from tt",
    ),
    "q05_seed_pairs": (
        lambda s, d: Q.against(stored(Q.by_seed(_budget(s, d)), "means"), [(a.name, b.name) for a in Q.BASELINES for b in Q.BASELINES if a.name > b.name]).select("variant", "base", "n", *[R6(c).alias(c) for c in ("delta", "t", "p")]),
        f"with {heads_sql(Q.BASELINES, SEEDS)}, me as (select variant, seed, round(avg(acc), 12) as acc from ac group by 1, 2), dd as (select a.variant, b.variant as base, a.acc - b.acc as d from me a join me b on b.seed = a.seed and a.variant > b.variant), {t_sql('dd', 'variant, base', 'd')} select variant, base, n, round(delta, 6) as delta, round(t, 6) as t, round(p, 6) as p from tt",
    ),
    "q06_head_sweep": (
        lambda s, d: Q.sweep(*_inputs(s, d), CONFIGS, N, FEW, TRAIN(), VAL()).select("config", "n", *[R6(c).alias(c) for c in ("delta", "p")]),
        f"with {heads_sql(Q.config_variants(CONFIGS), FEW)}, {_tested('ac', 'sw', 'clip_id % 4 = 1')} select try_cast(variant as int) as config, n, round(delta, 6) as delta, round(p, 6) as p from sw where variant <> 'uniform'",
    ),
    "q06_head_promoted": (
        lambda s, d: _promoted(s, d).select("config", "pick", *[R6(c).alias(c) for c in ("few_delta", "val_delta", "val_p")], "best", *[R6(c).alias(c) for c in ("test_delta", "test_p")]),
        f"""with {_PROMOTED}, pb as (select *, row_number() over (order by {ORDER}) = 1 as best from pr)
        select config, pick, round(few_delta, 6) as few_delta, round(pb.delta, 6) as val_delta, round(pb.p, 6) as val_p, best, round(te.delta, 6) as test_delta, round(te.p, 6) as test_p from pb join te on te.variant = pb.variant""",
    ),
    "q07_head_ceiling": (
        lambda s, d: _ceiling(s, d).select(F.col("variant").alias("config"), "n", R6("mean").alias("oracle"), R6("std").alias("std"), *[R6(c).alias(c) for c in ("delta", "p")]),
        f"""with {_CEILING}, me as (select variant, seed, round(avg(acc), 12) as acc from ac group by 1, 2), dd as (select a.variant, a.acc, a.acc - b.acc as d from me a join me b on b.seed = a.seed and b.variant = replace(a.variant, 'oracle', 'uniform') where a.variant like '%oracle%'), {t_sql('dd', 'variant', 'd')},
        ms as (select variant, avg(acc) as mean, coalesce(stddev_samp(acc), 0) as std from dd group by 1) select variant as config, n, round(mean, 6) as oracle, round(std, 6) as std, round(delta, 6) as delta, round(p, 6) as p from tt join ms using (variant)""",
    ),
    "q08_head_pareto": (
        lambda s, d: Q.pareto_grid(*_inputs(s, d), _TRIADS, ["uniform", "anchored", "oracle"], N, SEEDS, TRAIN(), REST()).select("variant", "tokens", "n", *[R6(c).alias(c) for c in ("acc", "std", "low", "high")], "frontier"),
        f"""with {heads_sql(_GRID, SEEDS)}, me as (select variant, seed, round(avg(acc), 12) as acc from ac group by 1, 2), {boot_sql('me', 'variant', 'seed', 'acc')}, cs as (select variant, avg(tokens) as tokens from tk group by 1),
        po as (select variant, tokens, round(mean, 9) as acc, std from cs join (select variant, avg(acc) as mean, coalesce(stddev_samp(acc), 0) as std from me group by 1) using (variant))
        select a.variant, a.tokens, n, round(a.acc, 6) as acc, round(std, 6) as std, round(low, 6) as low, round(high, 6) as high, not exists (select 1 from po b where (b.tokens < a.tokens or (b.tokens = a.tokens and b.acc > a.acc)) and b.acc >= a.acc) as frontier from po a join bo using (variant)""",
    ),
    "q09_head_gap": (
        lambda s, d: Q.against(stored(Q.by_seed(_budget(s, d)), "means"), [("oracle", "anchored"), ("oracle", "uniform"), ("anchored", "random")]).select("variant", "base", "n", *[R6(c).alias(c) for c in ("delta", "t", "p")]),
        f"with {heads_sql(Q.BASELINES, SEEDS)}, me as (select variant, seed, round(avg(acc), 12) as acc from ac group by 1, 2), dd as (select a.variant, b.variant as base, a.acc - b.acc as d from me a join me b on b.seed = a.seed and (a.variant, b.variant) in (('oracle', 'anchored'), ('oracle', 'uniform'), ('anchored', 'random'))), {t_sql('dd', 'variant, base', 'd')} select variant, base, n, round(delta, 6) as delta, round(t, 6) as t, round(p, 6) as p from tt",
    ),
    "q10_head_gates": (
        _gates,
        f"""with {heads_sql(_GATED, SEEDS)}, {_tested('ac', 'sw')}, th as (select * from va where kind = 'anchored'), fb as (select name as variant, max(th) as threshold, round(avg(case when std < th then 1.0 else 0.0 end), 6) as fallback from th cross join cf where clip_id % 2 = 1 group by 1)
        select cast(threshold as double) as threshold, fallback, round(delta, 6) as delta, round(p, 6) as p, row_number() over (order by round(delta, 6) desc, round(p, 6), try_cast(variant as int)) = 1 as best from sw join fb using (variant)""",
    ),
    "q11_sample_degradation": (
        lambda s, d: Q.degradation_report(_degraded(s, d)).select("shift", "snr", "silence", "alpha", *[R6(c).alias(c) for c in ("uniform", "random", "anchored", "std", "forced", "fallback", "recall_0", "recall_1", "recall_2", "margin")], "ok"),
        f"{DEGRADED} select shift, snr, silence, alpha, {', '.join(f'round({c}, 6) as {c}' for c in ('uniform', 'random', 'anchored', 'std', 'forced', 'fallback', 'recall_0', 'recall_1', 'recall_2', 'margin'))}, margin >= -1e-8 as ok from rp",
    ),
    "q11_sample_floor": (
        lambda s, d: Q.floor_summary(Q.degradation_report(_degraded(s, d))).select("rows", "passes", "fails", R6("min_margin").alias("min_margin"), F.array_join(F.transform("worst", lambda w: F.format_string("%.3f", w["margin"])), ",").alias("worst")),
        f"{DEGRADED} select count(*) as rows, cast(sum(case when margin >= -1e-8 then 1 else 0 end) as bigint) as passes, cast(sum(case when margin < -1e-8 then 1 else 0 end) as bigint) as fails, round(min(margin), 6) as min_margin, coalesce((select string_agg(printf('%.3f', margin), ',' order by margin) from (select margin from rp where margin < -1e-8 order by margin limit 5)), '') as worst from rp",
    ),
    "q17_fusion_confirmation": (
        lambda s, d: Q.against(stored(Q.by_seed(_budget(s, d)), "means"), [(a, b) for i, b in enumerate(FUSION) for a in FUSION[i + 1 :]]).select("variant", "base", "n", *[R6(c).alias(c) for c in ("delta", "t", "p")]),
        f"""with {heads_sql(Q.BASELINES, SEEDS)}, fu(o, variant) as (values {', '.join(f"({i}, '{x}')" for i, x in enumerate(FUSION))}), me as (select o, variant, seed, round(avg(acc), 12) as acc from ac join fu using (variant) group by 1, 2, 3),
        dd as (select a.variant, b.variant as base, a.acc - b.acc as d from me a join me b on b.seed = a.seed and a.o > b.o), {t_sql('dd', 'variant, base', 'd')} select variant, base, n, round(delta, 6) as delta, round(t, 6) as t, round(p, 6) as p from tt""",
    ),
}
