"""Registered queries: composite jobs (section Q) and the streaming form of the score windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import scratch, spread, stored
from ..operators import anchors as K
from ..operators import seconds as S
from ..operators import stats as A
from ..operators.perturb import degraded_shares
from ..streaming import windows as W
from ..views import RESULTS, SEG, SEGB, results, seg10, seg10b, table
from . import jobs as Q
from . import verification as V
from .queries_plans import ANCH, EXPANDED, RANK
from .queries_series import CONF, MM, R6
from .queries_stats import CAUSES_SQL, DELTAS, FACTS_SQL, GRID_SQL, IOU, RECALL, SEEDS, _best_iou, _boot, _facts, _items, _seeds, boot_sql, grid_cells, t_sql
from .queries_text import BM25, DOCS, TFIDF


def _plans(s, d):
    return Q.baseline_plans(seg10(s, d), seg10(s, d), 2, 10, 7)


def _configs(s):
    return s.range(50).select(F.col("id").cast("int").alias("config"), (F.col("id") % 4 + 1).cast("int").alias("k"), (F.col("id") * 0.05).alias("threshold"))


def _sweep(s, d):
    return Q.config_sweep(seg10(s, d), seg10(s, d), _configs(s), 10)


POINTER = 2000
VERIFIED = f"""rq as (select l_returnflag as dataset, cast(l_orderkey as varchar) as id, max(l_quantity) as need_s from lineitem where l_quantity >= 10 group by 1, 2),
fl as (select l_returnflag as dataset, cast(l_orderkey as varchar) as id, cast(floor(l_extendedprice) as bigint) as length from lineitem where l_linestatus = 'F'),
fs as (select dataset, id, count(*) as copies, max(length) as length from fl group by 1, 2),
du as (select l_returnflag as dataset, cast(l_orderkey as varchar) as id, max(l_quantity) as have_s from lineitem where l_discount > 0.02 group by 1, 2),
vf as (select dataset, id, need_s, coalesce(copies, 0) as copies, length, have_s, need_s - have_s - 0.1::double as shortfall_s, case when rq.id is null then 'unasked' when copies is null then 'missing' when length <= {POINTER} then 'pointer' when have_s is null then 'unprobed'
  when need_s - have_s - 0.1::double > 0 then 'short' else 'ok' end as status from rq full join fs using (dataset, id) left join du using (dataset, id))"""


def _recordings(s, d):
    """Line items as recordings: each is annotated up to its quantity, if that is 10 or more; closed lines have a file,
    lines with a discount above 0.02 a probed duration."""
    lines = table(s, d, "lineitem").withColumns({"dataset": F.col("l_returnflag"), "id": F.col("l_orderkey").cast("string")})
    required = lines.where("l_quantity >= 10").select("dataset", "id", F.col("l_quantity").alias("stop_s"))
    files = lines.where("l_linestatus = 'F'").select("dataset", "id", F.floor("l_extendedprice").alias("length"))
    return required, files, lines.where("l_discount > 0.02").select("dataset", "id", F.col("l_quantity").alias("have_s"))


def _dataset_status(required, files, durations):
    rows = V.dataset_status(V.verify_files(required, files, durations, pointer_bytes=POINTER), files, small_bytes=20_000)
    return rows.drop("advice").withColumns({c: R6(c) for c in ("p10", "median", "p90")})


def plans_sql(low: int, base: int, high: int, r: int, name: str = "pz") -> str:
    """CTE (baseline, clip_id, t, tokens) of the uniform, random, anchored and oracle plans; ``r`` base seconds pay
    for one high second."""
    tokens = lambda res: (res // 16) ** 2
    return f"""{name}a as (select 'random' as baseline, clip_id, t, row_number() over (partition by clip_id order by ('0x' || substr(sha1('7|' || clip_id || '|' || t), 1, 12))::ubigint, t) as r from seg
      union all select 'anchored', clip_id, t, row_number() over (partition by clip_id order by score desc, t) from seg union all select 'oracle', clip_id, t, row_number() over (partition by clip_id order by t) from seg where gt <> 0),
    {name}h as (select b.baseline, c.clip_id, max(t) filter (where r = 1) as h1, max(t) filter (where r = 2) as h2 from (select distinct clip_id from seg) c cross join (values ('uniform'), ('random'), ('anchored'), ('oracle')) b(baseline) left join {name}a a on a.baseline = b.baseline and a.clip_id = c.clip_id group by 1, 2),
    {name}p as (select baseline, clip_id, g.t, case when h1 is null then 0 when h2 is null then 1 else 2 end as k, least(abs(g.t - h1), coalesce(abs(g.t - h2), 99)) as near, coalesce(g.t = h1, false) or coalesce(g.t = h2, false) as is_high from {name}h cross join range(10) g(t)),
    {name}q as (select *, row_number() over (partition by baseline, clip_id, is_high order by near, t) as place from {name}p),
    {name} as (select baseline, clip_id, t, case when k = 0 then {tokens(base)} when is_high then {tokens(high)} when place <= 10 - {r} * k then {tokens(base)} else {tokens(low)} end as tokens from {name}q)"""


def proxy_sql(plans: str = "pz", name: str = "pp") -> str:
    """CTE (baseline, clip_id, acc): the share of a plan's tokens on event seconds."""
    return f"{name} as (select baseline, clip_id, sum(case when gt <> 0 then tokens else 0 end) * 1.0::double / sum(tokens) as acc from {plans} join seg using (clip_id, t) group by 1, 2 having max(gt) <> 0)"


PROXY = f"{SEG}, {plans_sql(160, 224, 352, 4)}, {proxy_sql()}"


SWEEP = f"""{CONF}, cg as (select cast(c as int) as config, c % 4 + 1 as k, c * 0.05 as th from range(50) r(c)), {RANK},
us as (select config, rk.clip_id, count(*) as used, sum(case when s.gt <> 0 then 1 else 0 end) as hit from rk join cf using (clip_id) join cg on r <= k and std >= th join seg s on s.clip_id = rk.clip_id and s.t = rk.t group by 1, 2),
ev as (select clip_id, sum(case when gt <> 0 then 1 else 0 end) as events from seg group by 1 having sum(case when gt <> 0 then 1 else 0 end) > 0),
pr as (select cg.config, ev.clip_id, coalesce(1.0 * hit / used, events / 10.0) - events / 10.0 as dlt from ev cross join cg left join us on us.config = cg.config and us.clip_id = ev.clip_id)"""
SWEPT = "select config, count(*) as n, round(avg(dlt), 6) as delta from pr group by 1"

SECONDS = """st as (select user_id as clip_id, cast(floor(date_diff('day', date '2024-01-01', cast(ts as date)) / 3) as int) as t, string_agg(event_type, ' ' order by event_type) as text,
  1 + count(*) filter (where event_type = 'view') as v, 1 + count(*) filter (where event_type = 'click') as c, 1 + count(*) filter (where event_type = 'purchase') as p from events group by 1, 2)"""
_DOCS = "dc as (select clip_id as grp, t as doc, text from st), qy as (select distinct clip_id as grp, 'click purchase' as text from st)"
BY_METHOD = f"""{SEG}, {SEGB}, {SECONDS}, bm as (with {BM25.replace(DOCS, _DOCS)}), ti as (with {TFIDF.replace(DOCS, _DOCS)}),
na as (select clip_id, t, {MM} as s from seg window w as (partition by clip_id)), nb as (select clip_id, t, {MM} as s from segb window w as (partition by clip_id)),
ms as (select 'uniform' as method, clip_id, t, 1.0::double as score from seg union all select 'random', clip_id, t, ('0x' || substr(sha1('7|' || clip_id || '|' || t), 1, 12))::ubigint / 281474976710656.0::double from seg
  union all select 'audio', clip_id, t, score from seg union all select 'visual', clip_id, t, score from segb union all select 'fused', clip_id, t, greatest(coalesce(na.s, 0), coalesce(nb.s, 0)) from na full join nb using (clip_id, t)
  union all select 'bm25', grp, doc, score from bm union all select 'tfidf', grp, doc, score from ti union all select 'embedding', clip_id, t, (c + p) / (sqrt(v * v + c * c + p * p) * sqrt(2)) from st)"""


ALL_METHODS = f"""{SEG}, {SEGB}, na as (select clip_id, t, {MM} as s from seg window w as (partition by clip_id)), nb as (select clip_id, t, {MM} as s from segb window w as (partition by clip_id)),
lg as (select clip_id, lag from (select *, row_number() over (partition by clip_id order by c desc, abs(lag), lag) as r from (select a.clip_id, g.l as lag, case when count(*) < 2 or stddev_pop(a.score) <= 1e-12 or stddev_pop(b.score) <= 1e-12 then 0 else round(corr(a.score, b.score), 9) end as c
  from segb a cross join range(-2, 3) g(l) join seg b on b.clip_id = a.clip_id and b.t + g.l = a.t group by 1, 2)) where r = 1),
am as (select 'energy' as method, clip_id, t, score from seg union all select 'energy_delta', clip_id, t, coalesce(abs(score - lag(score) over (partition by clip_id order by t)), 0) from seg union all select 'visual', clip_id, t, score from segb
  union all select 'fuse_max', clip_id, t, greatest(coalesce(na.s, 0), coalesce(nb.s, 0)) from na full join nb using (clip_id, t) union all select 'fuse_prod', clip_id, t, coalesce(na.s, 0) * coalesce(nb.s, 0) from na full join nb using (clip_id, t)
  union all select 'suppressed', seg.clip_id, seg.t, seg.score * (1 - coalesce(nb.s, 0)) from seg left join nb using (clip_id, t)
  union all select 'by_variance', clip_id, t, case when stddev_pop(seg.score) over (partition by clip_id) < 1.0 then segb.score * 3.5 else seg.score end from seg join segb using (clip_id, t)
  union all select 'auto_shift', seg.clip_id, seg.t, coalesce(m.score, min(seg.score) over (partition by seg.clip_id)) from seg join lg on lg.clip_id = seg.clip_id left join seg m on m.clip_id = seg.clip_id and m.t + lg.lag = seg.t
  union all select 'smoothed', clip_id, t, avg(score) over (partition by clip_id order by t rows between 1 preceding and 1 following) from seg
  union all select 'random', clip_id, t, ('0x' || substr(sha1('7|' || clip_id || '|' || t), 1, 12))::ubigint / 281474976710656.0::double from seg),
ar as (select *, row_number() over (partition by method, clip_id order by score desc, t) as r from am),
nd as (select m.method, s.clip_id, s.t, coalesce(min(abs(s.t - ar.t)), 99) as near from (select distinct method from am) m cross join seg s left join ar on ar.method = m.method and ar.clip_id = s.clip_id and ar.r <= 2 where s.gt <> 0 group by 1, 2, 3)"""


def _by_method(s, d):
    """(method, clip_id, t, score) of every named method; a second's text is its kinds of events, its vector counts them."""
    audio, visual = stored(seg10(s, d), "audio"), stored(seg10b(s, d), "visual")
    e = table(s, d, "events").groupBy(F.col("user_id").alias("clip_id"), F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 3).cast("int").alias("t"))
    kinds = stored(e.agg(F.array_join(F.sort_array(F.collect_list("event_type")), " ").alias("text"), F.array(*[1.0 + F.sum((F.col("event_type") == k).cast("int")) for k in ("view", "click", "purchase")]).alias("emb")), "seconds")
    clips = audio.select("clip_id").distinct()
    query, asked = clips.withColumn("text", F.lit("click purchase")), clips.withColumn("q", F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    return S.by_method(**{m: Q.build_scores(m, audio, visual, kinds, query, kinds, asked, 7) for m in Q.METHODS})


DAY = 86_400

QUERIES = {
    "f13_scores_by_method": (lambda s, d: _by_method(s, d).withColumn("score", R6("score")), f"with {BY_METHOD} select method, clip_id, t, round(score, 6) as score from ms"),
    "q15_answers_by_method": (
        lambda s, d: _answers(s, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("correct")).alias("acc")),
        f"""with {BY_METHOD}, rr as (select *, row_number() over (partition by method, clip_id order by round(score, 6) desc, t) as r from ms), xa as (select method, clip_id, rr.t + g.d - 1 as t, min(r * 100 + abs(g.d - 1) * 10 + sign(g.d - 1)) as o from rr cross join range(3) g(d) where r <= 2 and rr.t + g.d - 1 between 0 and 9 group by 1, 2, 3),
        cc as (select method, clip_id, u.t, 0 as p, cast(u.t as double) as o from (select distinct method, clip_id from ms) cross join (values (0), (4), (9)) u(t) union all select method, clip_id, t, 1, o from xa union all select method, clip_id, t, 2, -round(score, 6) from ms where t < 10),
        f as (select * from (select *, row_number() over (partition by method, clip_id, t order by p, o) as q from cc) where q = 1), z as (select method, clip_id, t from (select *, row_number() over (partition by method, clip_id order by p, o, t) as r from f) where r <= 6),
        h as (select z.method, clip_id, max(coalesce(seg.gt, 0)) as correct from z left join seg using (clip_id, t) where clip_id in (select clip_id from seg where gt <> 0) group by 1, 2) select method, count(*) as n, round(avg(correct), 6) as acc from h group by 1""",
    ),
    "q01_all_methods": (
        lambda s, d: Q.anchor_quality(seg10(s, d).select("clip_id", "t", "score"), seg10b(s, d), seg10(s, d), 2, [0, 1, 2], 10, 7).withColumn("recall", R6("recall")),
        f"with {ALL_METHODS} select method, delta, count(*) as clips, round(avg(r), 6) as recall from (select method, clip_id, g.d as delta, avg(case when near <= g.d then 1.0 else 0.0 end) as r from nd cross join (values (0), (1), (2)) g(d) group by 1, 2, 3) group by 1, 2",
    ),
    "q02_long_quality": (
        lambda s, d: A.recall(seg10(s, d).where("gt <> 0"), K.top_k(seg10(s, d), 3), [0, 1, 2], 10).select("delta", "clips", R6("recall").alias("recall")),
        f"with {SEG}, {RANK} {RECALL.replace('a.r <= 2', 'a.r <= 3')}",
    ),
    "q03_plan_records": (
        lambda s, d: Q.plan_records(seg10(s, d), 2, 10, 160, 224, 352, threshold=1.0).select("clip_id", F.array_join(F.col("anchors").cast("array<string>"), ",").alias("anchors"), "fallback_used", F.array_join(F.col("resolutions").cast("array<string>"), ",").alias("plan"), F.col("tokens").cast("long").alias("tokens")),
        f"""with {SEG}, {CONF}, {plans_sql(160, 224, 352, 4)}, an as (select clip_id, string_agg(cast(t as varchar), ',' order by r) as anchors from pza where baseline = 'anchored' and r <= 2 group by 1),
        pl as (select clip_id, baseline, string_agg(cast(16 * sqrt(tokens)::int as varchar), ',' order by t) as plan, cast(sum(tokens) as bigint) as tokens from pz group by 1, 2)
        select cf.clip_id, case when std < 1.0 then '' else anchors end as anchors, std < 1.0 as fallback_used, plan, tokens from cf join an using (clip_id) join pl on pl.clip_id = cf.clip_id and pl.baseline = case when std < 1.0 then 'uniform' else 'anchored' end""",
    ),
    "q04_long_plan": (
        lambda s, d: Q.long_plan(seg10(s, d), 2, 10, 1, 4, 7),
        f"""with {SEG}, {ANCH}, {EXPANDED}, f as (select clip_id, t, min(p) as p from (select clip_id, t, 0 as p from ex union all select clip_id, t, 1 from seg where t % 4 = 0 union all select clip_id, t, 2 from seg) group by 1, 2),
        c as (select clip_id, t from (select *, row_number() over (partition by clip_id order by p, t) as r from f) where r <= 7)
        select c.clip_id, cast(row_number() over (partition by c.clip_id order by c.t) - 1 as int) as pos, cast(c.t as int) as t, an.t is not null as is_anchor from c left join an on an.clip_id = c.clip_id and an.t = c.t""",
    ),
    "q06_config_sweep": (lambda s, d: _sweep(s, d).select("config", "n", R6("delta").alias("delta")), f"with {SEG}, {SWEEP} {SWEPT}"),
    "q06_promoted": (
        lambda s, d: A.pick_config(_sweep(s, d).select("config", "delta", "p")).select("config", R6("delta").alias("delta"), R6("p").alias("p"), "pick"),
        f"""with {SEG}, {SWEEP}, {t_sql('pr', 'config', 'dlt')} select config, round(delta, 6) as delta, round(p, 6) as p, cast(r as int) as pick
        from (select *, row_number() over (order by case when delta > 0 and p < 0.05 then 0 when delta > 0 then 1 else 2 end, round(delta, 9) desc, round(p, 9), config) as r from tt) where r <= 3""",
    ),
    "q06_reproduced": (
        lambda s, d: Q.promoted_on_test(seg10(s, d), seg10(s, d), _configs(s), 10, F.col("clip_id") % 2 == 1).select("config", R6("val_delta").alias("val_delta"), R6("test_delta").alias("test_delta"), "test_n"),
        f"""with {SEG}, {SWEEP}, va as (select * from pr where clip_id % 2 = 0), {t_sql('va', 'config', 'dlt')},
        pk as (select config, delta from tt order by case when delta > 0 and p < 0.05 then 0 when delta > 0 then 1 else 2 end, round(delta, 9) desc, round(p, 9), config limit 1)
        select pr.config, round(max(pk.delta), 6) as val_delta, round(avg(dlt), 6) as test_delta, count(*) as test_n from pr join pk on pk.config = pr.config where clip_id % 2 = 1 group by 1""",
    ),
    "q07_oracle_ceiling": (
        lambda s, d: Q.plan_proxy(_plans(s, d), seg10(s, d)).where("baseline in ('uniform', 'oracle')").groupBy("baseline").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("acc")).alias("acc")),
        f"with {PROXY} select baseline, count(*) as n, round(avg(acc), 6) as acc from pp where baseline in ('uniform', 'oracle') group by 1",
    ),
    "q08_pareto": (
        lambda s, d: A.pareto(_triads(s, d), "tokens", "acc"),
        f"""with {SEG}, {plans_sql(160, 224, 352, 4)}, {proxy_sql()}, {plans_sql(112, 224, 448, 5, 'qz')}, {proxy_sql('qz', 'qq')},
        po as (select '160-224-352/' || baseline as triad, (select avg(tokens) from pz where pz.baseline = pp.baseline) as tokens, round(avg(acc), 6) as acc from pp where baseline in ('anchored', 'uniform') group by baseline
          union all select '112-224-448/' || baseline, (select avg(tokens) from qz where qz.baseline = qq.baseline), round(avg(acc), 6) from qq where baseline in ('anchored', 'uniform') group by baseline)
        select * from po a where not exists (select 1 from po b where (b.tokens < a.tokens or (b.tokens = a.tokens and b.acc > a.acc)) and b.acc >= a.acc)""",
    ),
    "q09_oracle_gap": (
        lambda s, d: Q.plan_proxy(_plans(s, d), seg10(s, d)).groupBy("clip_id").agg((F.max(F.when(F.col("baseline") == "oracle", F.col("acc"))) - F.max(F.when(F.col("baseline") == "anchored", F.col("acc")))).alias("gap")).agg(F.count(F.lit(1)).alias("n"), R6(F.avg("gap")).alias("gap")),
        f"with {PROXY}, g as (select clip_id, max(acc) filter (where baseline = 'oracle') - max(acc) filter (where baseline = 'anchored') as gap from pp group by 1) select count(*) as n, round(avg(gap), 6) as gap from g",
    ),
    "q10_gate_sweep": (
        lambda s, d: _sweep(s, d).select("config", R6("delta").alias("delta"), R6("p").alias("p")).agg(F.max_by("config", F.struct("delta", -F.col("p"), -F.col("config"))).alias("best"), F.max("delta").alias("delta")),
        f"with {SEG}, {SWEEP}, {t_sql('pr', 'config', 'dlt')} select config as best, round(delta, 6) as delta from tt order by round(delta, 6) desc, round(p, 6), config limit 1",
    ),
    "q11_degradation": (
        lambda s, d: Q.degradation(seg10(s, d), grid_cells(s), 2, [0, 1, 2], 10, 7).withColumn("recall", R6("recall")),
        f"with {SEG}, {GRID_SQL} select shift, snr, silence, delta, count(*) as clips, round(avg(r), 6) as recall from gr group by 1, 2, 3, 4",
    ),
    "q11_alpha_floor": (
        lambda s, d: A.alpha_floor(_degraded_shares(s, d), 0.95).select("shift", "snr", "silence", R6("anchored").alias("anchored"), R6("uniform").alias("uniform"), R6("margin").alias("margin"), "ok"),
        f"""with {SEG}, {GRID_SQL}, z as (select shift, snr, silence, clip_id, avg(case when gt <> 0 then 1.0 else 0.0 end) as y from dg join seg using (clip_id, t) where dg.r <= 2 group by 1, 2, 3, 4), e as (select clip_id, sum(case when gt <> 0 then 1 else 0 end) / 10.0::double as u from seg group by 1 having max(gt) <> 0),
        x as (select shift, snr, silence, avg(y) as a, avg(u) as u from z join e using (clip_id) group by 1, 2, 3) select shift, snr, silence, round(a, 6) as anchored, round(u, 6) as uniform, round(a - 0.95 * u, 6) as margin, a - 0.95 * u >= 0 as ok from x""",
    ),
    "q12_evidence_alignment": (
        lambda s, d: A.correlations(A.coverage(_best_iou(s, d), [0.1, 0.3]).join(Q.plan_proxy(_plans(s, d), seg10(s, d)).where("baseline = 'anchored'").select("clip_id", "acc"), "clip_id"), ["tau"], "coverage", "acc").select("tau", "n", R6("pearson").alias("pearson"), R6("spearman").alias("spearman")),
        f"""with {PROXY}, {RANK}, {IOU}, cv as (select bi.clip_id, v.tau::double as tau, avg(case when round(iou, 9) >= v.tau then 1.0 else 0.0 end) as x from bi cross join (values (0.1), (0.3)) v(tau) group by 1, 2),
        j as (select tau, x, acc as y from cv join pp on pp.clip_id = cv.clip_id and baseline = 'anchored'), k as (select *, rank() over (partition by tau order by x) + (count(*) over (partition by tau, x) - 1) / 2.0 as rx, rank() over (partition by tau order by y) + (count(*) over (partition by tau, y) - 1) / 2.0 as ry from j)
        select tau, count(*) as n, case when stddev_pop(x) > 1e-12 and stddev_pop(y) > 1e-12 then round(corr(x, y), 6) end as pearson, case when stddev_pop(x) > 1e-12 and stddev_pop(y) > 1e-12 then round(corr(rx, ry), 6) end as spearman from k group by 1""",
    ),
    "q12_best_worst": (
        lambda s, d: K.extremes(A.coverage(_best_iou(s, d), [0.3]).select("clip_id", R6("coverage").alias("coverage")), "coverage", "clip_id", 10),
        f"""with {SEG}, {RANK}, {IOU}, c as (select clip_id, round(avg(case when round(iou, 9) >= 0.3 then 1.0 else 0.0 end), 6) as coverage from bi group by 1)
        select * from (select clip_id, coverage, 'best' as "end" from c order by coverage desc, clip_id limit 10) union all select * from (select clip_id, coverage, 'worst' from c order by coverage, clip_id limit 10)""",
    ),
    "q13_diagnosis": (lambda s, d: A.histograms(K.select_anchors(seg10(s, d), 2, 10, threshold=1.0).select(F.size("anchors").alias("anchors"), F.coalesce("fallback_reason", F.lit("none")).alias("reason"), "conf_value"), ["anchors", "reason"], "conf_value").withColumn("mean", R6("mean")),
        f"with {SEG}, {CONF} select 'anchors' as dim, case when std < 1.0 then '0' else '2' end as bin, count(*) as n, round(avg(std), 6) as mean from cf group by 2 union all select 'reason', case when std < 1.0 then 'conf_below_threshold' else 'none' end, count(*), round(avg(std), 6) from cf group by 2"),
    "q13_percentiles": (
        lambda s, d: A.percentiles(_clip_deltas(s, d), ["all"], "delta").select("all", *[R6(c).alias(c) for c in ("p10", "p50", "p90")]),
        f"with {PROXY}, dl as (select clip_id, max(acc) filter (where baseline = 'anchored') - max(acc) filter (where baseline = 'uniform') as delta from pp group by 1) select 'all' as \"all\", round(quantile_cont(delta, 0.1), 6) as p10, round(quantile_cont(delta, 0.5), 6) as p50, round(quantile_cont(delta, 0.9), 6) as p90 from dl",
    ),
    "q13_extremes": (
        lambda s, d: K.extremes(_clip_deltas(s, d).select("clip_id", R6("delta").alias("delta")), "delta", "clip_id", 20),
        f"""with {PROXY}, dl as (select clip_id, round(max(acc) filter (where baseline = 'anchored') - max(acc) filter (where baseline = 'uniform'), 6) as delta from pp group by 1)
        select * from (select clip_id, delta, 'best' as "end" from dl order by delta desc, clip_id limit 20) union all select * from (select clip_id, delta, 'worst' from dl order by delta, clip_id limit 20)""",
    ),
    "q14_root_cause": (
        lambda s, d: A.root_causes(_facts(s, d), delta=0.0, p=0.5, gap=0.01, fallback=0.3).select("config", F.size("reasons").alias("causes"), F.element_at("reasons", 1).alias("first"), "proven"),
        f"""with {SEG}, {SEGB}, {CONF}, {RANK}, {IOU}, {RESULTS}, {SEEDS}, {DELTAS}, {t_sql('dd', 'config', 'd')}, {FACTS_SQL}, ca as ({CAUSES_SQL.replace('delta < 0.02', 'delta < 0.0').replace('p >= 0.05', 'p >= 0.5').replace('oracle_gap > 0.02', 'oracle_gap > 0.01').replace('fallback > 0.6', 'fallback > 0.3').replace('delta >= 0.02 and p < 0.05', 'delta >= 0.0 and p < 0.5')})
        select config, case when reasons = '' then 0 else cast(len(string_split(reasons, ',')) as int) end as causes, nullif(split_part(reasons, ',', 1), '') as first, proven from ca""",
    ),
    "q15_q16_qa_report": (
        lambda s, d: A.bucket_table(_items(s, d), "bucket", "method", "correct", "item_id", "5-LOW").select("bucket", "method", "n_items", "n_paired", R6("acc").alias("acc"), R6("delta").alias("delta")),
        f"""with {RESULTS}, it as (select item_id, item_id % 4 as bucket, method, max(correct) as correct from res group by 1, 2, 3), ni as (select bucket, count(distinct item_id) as n_items from it group by 1)
        select a.bucket, a.method, n_items, count(*) as n_paired, round(avg(a.correct), 6) as acc, round(avg(a.correct - b.correct), 6) as delta from it a join it b on b.item_id = a.item_id and b.method = '5-LOW' join ni on ni.bucket = a.bucket where a.method <> '5-LOW' group by 1, 2, 3""",
    ),
    "q16_multi_seed": (
        lambda s, d: A.mean_std(_seeds(s, d), ["method"], "acc").join(_boot(A.bootstrap(_seeds(s, d), ["method"], "seed", "acc"), ["method"]).select("method", "low", "high"), "method").select("method", "n", R6("mean").alias("mean"), R6("std").alias("std"), "low", "high"),
        f"with {RESULTS}, {SEEDS}, {boot_sql('sd', 'method', 'seed', 'acc')}, x as (select method, coalesce(stddev_samp(acc), 0) as std from sd group by 1) select method, n, round(mean, 6) as mean, round(std, 6) as std, round(low, 6) as low, round(high, 6) as high from bo join x using (method)",
    ),
    "q16_paired_deltas": (
        lambda s, d: _boot(A.bootstrap(_seed_deltas(s, d), ["method"], "seed", "delta"), ["method"]),
        f"with {RESULTS}, {SEEDS}, dd as (select a.method, a.seed, a.acc - b.acc as d from sd a join sd b on b.seed = a.seed and b.method = '5-LOW' where a.method <> '5-LOW'), {boot_sql('dd', 'method', 'seed', 'd')} select method, n, round(mean, 6) as mean, round(low, 6) as low, round(high, 6) as high, round(p, 6) as p from bo",
    ),
    "q17_paired_confirmation": (
        lambda s, d: Q.paired_report(Q.plan_proxy(_plans(s, d), seg10(s, d)), "anchored", "uniform").select("pair", "n", *[R6(c).alias(c) for c in ("delta", "t", "p")]),
        f"with {PROXY}, dd as (select 'anchored_vs_uniform' as pair, a.acc - b.acc as d from pp a join pp b on b.clip_id = a.clip_id and b.baseline = 'uniform' where a.baseline = 'anchored'), {t_sql('dd', 'pair', 'd')} select pair, n, round(delta, 6) as delta, round(t, 6) as t, round(p, 6) as p from tt",
    ),
    "q18_verification": (
        lambda s, d: A.sizes_summary(results(s, d), ["method"], "item_id").select("method", "n", "min", "max"),
        "select o_orderpriority as method, count(o_custkey) as n, min(o_custkey) as min, max(o_custkey) as max from orders group by 1",
    ),
    "q18_verify_files": (
        lambda s, d: V.verify_files(*_recordings(s, d), pointer_bytes=POINTER).select("dataset", "id", "need_s", "copies", "length", "have_s", R6("shortfall_s").alias("shortfall_s"), "status"),
        f"with {VERIFIED} select dataset, id, need_s, copies, length, have_s, round(shortfall_s, 6) as shortfall_s, status from vf",
    ),
    "q18_dataset_status": (
        lambda s, d: _dataset_status(*_recordings(s, d)),
        f"""with {VERIFIED}, sz as (select dataset, count(*) as files, count(*) filter (where length <= 20000) as small, min(length) as min, quantile_cont(length, 0.1) as p10, median(length) as median, quantile_cont(length, 0.9) as p90, max(length) as max, cast(sum(length) as bigint) as total from fl group by 1),
        c as (select dataset, count(*) filter (where status <> 'unasked') as required, {", ".join(f"count(*) filter (where status = '{x}') as {x}" for x in V.STATES)}, count(*) filter (where copies > 1) as duplicates, round(max(greatest(shortfall_s, 0.0)), 6) as worst_s from vf group by 1)
        select dataset, required, {", ".join(V.STATES)}, duplicates, worst_s, coalesce(files, 0) as files, coalesce(small, 0) as small, min, round(p10, 6) as p10, round(median, 6) as median, round(p90, 6) as p90, max, total, required > 0 and missing = 0 and pointer = 0 as ready from c left join sz using (dataset)""",
    ),
    "q18_worst_shortfalls": (
        lambda s, d: V.worst_shortfalls(V.verify_files(*_recordings(s, d), pointer_bytes=POINTER)).withColumn("shortfall_s", R6("shortfall_s")),
        f"with {VERIFIED}, r as (select dataset, row_number() over (partition by dataset order by shortfall_s desc, id) as place, id, shortfall_s from vf where status = 'short') select dataset, cast(place as int) as place, id, round(shortfall_s, 6) as shortfall_s from r where place <= 20",
    ),
    "stream_log_energy": (
        lambda s, d: W.run_once(s, W.tumbling_energy(W.event_stream(s, d), "3 days"), "energy").select("clip_id", "start", "n", R6("score").alias("score")),
        "select user_id as clip_id, time_bucket(interval '3 days', ts, timestamp '1970-01-01') as start, count(*) as n, round(ln(avg(value * value) + 1e-12), 6) as score from events group by 1, 2",
    ),
    "stream_closed_anchors": (
        lambda s, d: W.selected_once(s, W.closing_clips(W.event_stream(s, d), DAY, 10 * DAY), lambda rows: K.explode_anchors(K.select_anchors(rows, 2, 10, "nms", radius=1)), scratch(s, "stream-anchors"))[0].select("clip_id", "start", "rank", "t"),
        f"""with sc as (select user_id as clip_id, time_bucket(interval '10 days', ts, timestamp '1970-01-01') as start, cast(date_diff('day', time_bucket(interval '10 days', ts, timestamp '1970-01-01'), cast(ts as date)) as int) as t, ln(avg(value * value) + 1e-12) as score from events group by 1, 2, 3),
        r1 as (select *, row_number() over (partition by clip_id, start order by score desc, t) as r from sc where start + interval '10 days' <= (select max(ts) - interval '1 day' from events)),
        a1 as (select clip_id, start, t from r1 where r = 1), a2 as (select clip_id, start, arg_min(r1.t, r1.r) as t from r1 join a1 using (clip_id, start) where abs(r1.t - a1.t) > 1 group by 1, 2)
        select clip_id, start, 1 as rank, t from a1 union all select clip_id, start, 2, t from a2""",
    ),
    "stream_sliding_energy": (
        lambda s, d: W.run_once(s, W.sliding_energy(W.event_stream(s, d), "2 days", "1 day"), "sliding").select("clip_id", "start", "n"),
        "select user_id as clip_id, date_trunc('day', ts) - g.k * interval '1 day' as start, count(*) as n from events cross join range(2) g(k) group by 1, 2",
    ),
}


def _answers(s, d):
    """(method, clip_id, correct): whether the seconds that a method selects hold an event of the clip."""
    picked = Q.picks_by_method(_by_method(s, d).withColumn("score", R6("score")), 2, 6, 0.5, 1, 10)
    events = seg10(s, d).where("gt <> 0").groupBy("clip_id").agg(F.collect_list("t").alias("events"))
    hit = F.exists("picks", lambda p: F.array_contains("events", p["t"]))
    return picked.join(spread(events), "clip_id").select("method", "clip_id", hit.cast("int").alias("correct"))


def _clip_deltas(s, d):
    by = Q.plan_proxy(_plans(s, d), seg10(s, d)).groupBy("clip_id").agg(*[F.max(F.when(F.col("baseline") == b, F.col("acc"))).alias(b) for b in ("anchored", "uniform")])
    return by.select(F.lit("all").alias("all"), "clip_id", (F.col("anchored") - F.col("uniform")).alias("delta"))


def _seed_deltas(s, d):
    base = _seeds(s, d).where("method = '5-LOW'").select("seed", F.col("acc").alias("base"))
    return _seeds(s, d).where("method <> '5-LOW'").join(base, "seed").select("method", "seed", (F.col("acc") - F.col("base")).alias("delta"))


def _degraded_shares(s, d):
    """(shift, snr, silence, anchored, uniform): over clips with events, how much of the anchors and of all seconds
    are events, under each cell of the grid."""
    return degraded_shares(seg10(s, d), grid_cells(s), 2, 10, 7)


def _triads(s, d):
    """(triad, tokens, acc): anchored plans of several resolution triads."""
    out = None
    for low, base, high in ((160, 224, 352), (112, 224, 448)):
        p = Q.baseline_plans(seg10(s, d), seg10(s, d), 2, 10, 7, low, base, high).where("baseline in ('anchored', 'uniform')")
        acc = Q.plan_proxy(p, seg10(s, d)).groupBy("baseline").agg(R6(F.avg("acc")).alias("acc"))
        tok = p.groupBy("baseline").agg(F.avg("tokens").alias("tokens"))
        rows = acc.join(tok, "baseline").select(F.concat_ws("/", F.lit(f"{low}-{base}-{high}"), "baseline").alias("triad"), "tokens", "acc")
        out = rows if out is None else out.unionByName(rows)
    return out
