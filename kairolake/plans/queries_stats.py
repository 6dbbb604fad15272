"""Registered queries: joins, statistics, reports, sorts and sets (sections J, A, O) with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import anchors as K
from ..operators import confidence as C
from ..operators import joins as J
from ..operators import stats as A
from ..operators.perturb import recall_grid
from ..views import RESULTS, SEG, SEGB, results, seg10, seg10b, table
from .queries_plans import RANK
from .queries_series import CONF, INTERVALS, MM, R6, _intervals, _sql

RECALL = """select g.d as delta, count(*) as clips, round(avg(r), 6) as recall from (select clip_id, g.d, avg(case when near <= g.d then 1.0 else 0.0 end) as r from
    (select s.clip_id, s.t, min(abs(s.t - a.t)) as near from seg s join rk a on a.clip_id = s.clip_id and a.r <= 2 where s.gt <> 0 group by 1, 2) cross join (values (0), (1), (2)) g(d) group by 1, 2) g group by 1"""
PAIR = "pr as (select item_id, max(correct) filter (where method = '1-URGENT') as a, max(correct) filter (where method = '5-LOW') as b from res group by 1 having max(correct) filter (where method = '1-URGENT') is not null and max(correct) filter (where method = '5-LOW') is not null)"


def p_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t in SQL: products of whole-number ratios as gamma functions; the normal law above 400."""
    th, z = f"atan(abs({t}) / sqrt({df}))", f"((8 * ({df}) + 1) / (8.0 * ({df}) + 3) * sqrt(({df}) * ln(1 + ({t}) * ({t}) / ({df}))))"
    k = f"(1 / (1 + 0.2316419 * {z}))"
    far = f"2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429))))"
    even = f"1 - sin({th}) * list_sum([exp(2 * j * ln(cos({th})) + lgamma(j + 0.5::double) - lgamma(j + 1.0::double)) / sqrt(pi()) for j in range(cast(({df}) // 2 as bigint))])"
    odd = f"1 - 2 / pi() * ({th} + sin({th}) * coalesce(list_sum([exp((2 * j + 1) * ln(cos({th})) + lgamma(j + 1.0::double) - lgamma(j + 1.5::double)) * sqrt(pi()) / 2 for j in range(cast((({df}) - 1) // 2 as bigint))]), 0))"
    return f"case when {df} > 400 then least(1, {far}) else greatest(0, case when ({df}) % 2 = 0 then {even} else {odd} end) end"


def t_sql(source: str, keys: str, d: str, name: str = "tt") -> str:
    """CTE (keys, n, delta, t, p) of the paired test of the differences ``d``."""
    return f"""{name}0 as (select {keys}, count({d}) as n, avg({d}) as delta, stddev_samp({d}) as sd from {source} group by {keys}),
    {name}1 as (select *, case when sd <= 1e-12 then case when abs(delta) <= 1e-12 then 0 end else delta / (sd / sqrt(n)) end as t from {name}0),
    {name} as (select *, case when n < 2 then null when sd <= 1e-12 then case when abs(delta) <= 1e-12 then 1 else 0 end else {p_sql('t', '(n - 1)')} end as p from {name}1)"""


def boot_sql(source: str, keys: str, id_col: str, value: str, name: str = "bo") -> str:
    """CTE (keys, n, mean, low, high, p) of the hash-seeded bootstrap with 200 replicates."""
    cdf, step, weights = 0.0, math.exp(-1), []
    for k in range(1, 9):
        cdf += step
        step /= k
        weights.append(f"(case when u >= {cdf!r} then 1 else 0 end)")
    return f"""{name}0 as (select {keys}, {value} as v, b.b, ('0x' || substr(sha1('0|' || b.b || '|' || {id_col}), 1, 12))::ubigint / 281474976710656.0::double as u from {source} cross join range(1, 201) b(b) where {value} is not null),
    {name}1 as (select {keys}, b, sum(({' + '.join(weights)}) * v) / nullif(sum({' + '.join(weights)}), 0) as m from {name}0 group by {keys}, b),
    {name}2 as (select {keys}, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high, least(1.0, 2 * least(avg(case when m <= 0 then 1.0 when m > 0 then 0.0 end), avg(case when m >= 0 then 1.0 when m < 0 then 0.0 end))) as p from {name}1 group by {keys}),
    {name} as (select * from (select {keys}, count({value}) as n, avg({value}) as mean from {source} group by {keys}) join {name}2 using ({keys}))"""


BOOT = ("n", "mean", "low", "high", "p")


def _boot(rows, keys):
    return rows.select(*keys, "n", *[R6(c).alias(c) for c in BOOT[1:]])


def _evidence(s, d):
    iv = _intervals(s, d)
    return iv.select("clip_id", F.col("label").alias("evidence_id"), "start_s", "end_s")


def _predicted(s, d):
    return K.top_k(seg10(s, d), 2).select("clip_id", F.col("rank").alias("window_id"), F.greatest(F.lit(0.0), F.col("t") - 1.0).alias("start_s"), (F.col("t") + 2.0).alias("end_s"))


IOU = f"""{INTERVALS}, pw as (select clip_id, r as window_id, greatest(0.0, t - 1.0)::double as ws, (t + 2.0)::double as we from rk where r <= 2),
io as (select iv.clip_id, label as evidence_id, cast(window_id as int) as window_id, (least(we, end_s) - greatest(ws, start_s)) / (we - ws + end_s - start_s - (least(we, end_s) - greatest(ws, start_s))) as iou from pw join iv on iv.clip_id = pw.clip_id and ws < end_s and start_s < we),
bi as (select iv.clip_id, iv.label as evidence_id, coalesce(max(iou), 0) as iou from iv left join io on io.clip_id = iv.clip_id and io.evidence_id = iv.label group by 1, 2)"""


def _iou(s, d):
    return J.window_iou(_predicted(s, d), _evidence(s, d))


def _best_iou(s, d):
    best = _iou(s, d).groupBy("clip_id", "evidence_id").agg(F.max("iou").alias("iou"))
    return _evidence(s, d).select("clip_id", "evidence_id").join(best, ["clip_id", "evidence_id"], "left").fillna(0.0, ["iou"])


def _seeds(s, d):
    return results(s, d).groupBy("seed", "method").agg(F.avg("correct").alias("acc"))


SEEDS = "sd as (select seed, method, avg(correct) as acc from res group by 1, 2)"


def _paired(s, d):
    return J.paired(results(s, d), "item_id", "method", "correct", "1-URGENT", "5-LOW")


def _scored(s, d):
    """(class, item, y, score): toxicity labels by source, scored by text length."""
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return docs.select(F.col("lang").alias("class"), F.col("doc_id").alias("item"), F.col("toxic").alias("y"), (F.col("n_chars") % 100 / 100).alias("score"))


SCORED = "sc as (select lang as class, doc_id as item, toxic as y, (n_chars % 100) / 100.0::double as score from documents join labels using (doc_id))"


def _configs(s, d):
    return s.range(8).select(F.col("id").cast("int").alias("config"), ((F.col("id") - 3) * 0.4).alias("threshold"))


DELTAS = "dd as (select a.method as config, a.acc - b.acc as d from sd a join sd b on b.seed = a.seed and b.method = '5-LOW' where a.method <> '5-LOW')"
#: The robustness grid: shift, noise and silence.
GRID = [(shift, snr, silence) for shift in (-1, 0, 1) for snr in (20.0, 0.0) for silence in (0.0, 0.3)]
_H = "('0x' || substr(sha1({}), 1, 12))::ubigint / 281474976710656.0::double"
GRID_SQL = f"""cells as (select a.x as shift, b.x as snr, c.x as silence from (values (-1), (0), (1)) a(x), (values (20.0::double), (0.0)) b(x), (values (0.0::double), (0.3)) c(x)),
mm as (select clip_id, t, {MM} as x, row_number() over (partition by clip_id order by t) as i from seg window w as (partition by clip_id)),
mv as (select shift, snr, silence, m.clip_id, m.t, coalesce(o.x, 0) as v from cells cross join mm m left join mm o on o.clip_id = m.clip_id and o.i = m.i - shift),
nz as (select *, sqrt(avg(v * v) over (partition by shift, snr, silence, clip_id) / pow(10, snr / 10)) * sqrt(-2 * ln(greatest({_H.format("'7|' || clip_id || '|' || t || '|u'")}, 1e-12))) * cos(2 * pi() * {_H.format("'7|' || clip_id || '|' || t || '|v'")}) as noise,
  {_H.format("'7|mask|' || clip_id || '|' || t")} as mask from mv),
dg as (select *, row_number() over (partition by shift, snr, silence, clip_id order by case when mask >= silence then greatest(0, least(1, v + noise)) else 0 end desc, t) as r from nz),
gr as (select shift, snr, silence, g.d as delta, clip_id, avg(case when near <= g.d then 1.0 else 0.0 end) as r from
  (select shift, snr, silence, s.clip_id, s.t, min(abs(s.t - a.t)) as near from seg s join dg a on a.clip_id = s.clip_id and a.r <= 2 where s.gt <> 0 and s.t < 10 group by 1, 2, 3, 4, 5) cross join (values (0), (1), (2)) g(d) group by 1, 2, 3, 4, 5)"""
FACTS_SQL = """fo as (select seed, max(acc) as best from sd group by 1), fc as (select tau, avg(c) as c from (select clip_id, v.tau::double as tau, avg(case when round(iou, 9) >= v.tau then 1.0 else 0.0 end) as c from bi cross join (values (0.1), (0.3), (0.5)) v(tau) group by 1, 2) group by 1),
fr as (select clip_id, case when stddev_pop(seg.score) > 1e-12 and stddev_pop(segb.score) > 1e-12 then abs(corr(seg.score, segb.score)) end as c from seg join segb using (clip_id, t) group by 1),
ft as (select method, avg(case when q_bar > 200000 then correct end) as acc from res group by 1),
fa as (select tt.config, tt.delta, tt.p, (select avg(best) from fo) - (select avg(acc) from sd where sd.method = tt.config) as oracle_gap, (select avg(case when std < 1.0 then 1.0 else 0.0 end) from cf) as fallback, (select avg(c) from fc) as coverage, (select avg(c) from fr) as corr,
  (select count(*) from sd a join sd b on b.seed = a.seed and b.method = '5-LOW' where a.method = tt.config and a.acc < 0.95 * b.acc) as alpha_fails, (select acc from ft where ft.method = tt.config) - (select acc from ft where ft.method = '5-LOW') as transfer from tt)"""
CAUSES_SQL = """select config, concat_ws(',', case when delta < 0.02 then 'gain_below_target' end, case when p >= 0.05 then 'not_significant' end, case when oracle_gap > 0.02 then 'oracle_gap_large' end, case when fallback > 0.6 then 'fallback_frequent' end, case when coverage < 0.2 then 'coverage_low' end,
case when corr < 0.2 then 'alignment_weak' end, case when alpha_fails > 0 then 'alpha_floor_broken' end, case when transfer <= 0 then 'transfer_not_positive' end) as reasons, coalesce(delta >= 0.02 and p < 0.05, false) as proven from fa"""


def grid_cells(s):
    return s.createDataFrame(GRID, "shift int, snr double, silence double")


def _bucket_deltas(s, d):
    return _paired(s, d).select((F.col("item_id") % 4).alias("bucket"), "item_id", (F.col("a") - F.col("b")).alias("delta"))


def _first_answers(s, d):
    return results(s, d).groupBy("item_id").agg(F.min_by("method", "row_id").alias("answer"))


def _facts(s, d):
    """(config, eight facts) for each method against the last one; facts of the whole run are one row, broadcast."""
    seeds = _seeds(s, d)
    base = seeds.where("method = '5-LOW'").select("seed", F.col("acc").alias("base"))
    own = seeds.join(base, "seed").groupBy(F.col("method").alias("config")).agg(F.avg("acc").alias("acc"), F.sum((F.col("acc") < 0.95 * F.col("base")).cast("long")).alias("alpha_fails"))
    rich = results(s, d).groupBy(F.col("method").alias("config")).agg(F.avg(F.when(F.col("q_bar") > 200000, F.col("correct"))).alias("rich"))
    whole = seeds.groupBy("seed").agg(F.max("acc").alias("best")).agg(F.avg("best").alias("best"))
    whole = whole.crossJoin(K.select_anchors(seg10(s, d), 2, 10, threshold=1.0).agg(F.avg(F.col("fallback_used").cast("double")).alias("fallback")))
    whole = whole.crossJoin(A.coverage(_best_iou(s, d), [0.1, 0.3, 0.5]).groupBy("tau").agg(F.avg("coverage").alias("c")).agg(F.avg("c").alias("coverage")))
    linked = A.correlations(seg10(s, d).join(seg10b(s, d).select("clip_id", "t", F.col("score").alias("other")), ["clip_id", "t"]), ["clip_id"], "score", "other")
    whole = whole.crossJoin(linked.agg(F.avg(F.abs("pearson")).alias("corr"))).crossJoin(rich.where("config = '5-LOW'").select(F.col("rich").alias("plain")))
    return _deltas(s, d).join(own, "config").join(rich, "config").crossJoin(F.broadcast(whole)).select("config", "delta", "p", (F.col("best") - F.col("acc")).alias("oracle_gap"), "fallback", "coverage", "corr", "alpha_fails", (F.col("rich") - F.col("plain")).alias("transfer"))


QUERIES = {
    "j01_last_wins": (
        lambda s, d: J.keep_one(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_partkey"),
        "select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_extendedprice desc) as r from lineitem) where r = 1",
    ),
    "j02_metadata_unknown": (
        lambda s, d: J.with_metadata(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id", "quality").groupBy("quality").agg(F.count(F.lit(1)).alias("n")),
        "select coalesce(cast(quality as varchar), 'UNKNOWN') as quality, count(*) as n from documents left join labels using (doc_id) group by 1",
    ),
    "j03_paired_methods": (_paired, f"with {RESULTS}, {PAIR} select * from pr"),
    "j04_seed_pairs": (
        lambda s, d: _seeds(s, d).join(_seeds(s, d).where("method = '5-LOW'").select("seed", F.col("acc").alias("base")), "seed").select("seed", "method", R6(F.col("acc") - F.col("base")).alias("delta")),
        f"with {RESULTS}, {SEEDS} select a.seed, a.method, round(a.acc - b.acc, 6) as delta from sd a join sd b on b.seed = a.seed and b.method = '5-LOW'",
    ),
    "j05_band_join": (
        lambda s, d: J.hits(seg10(s, d).where("gt <> 0").select("clip_id", "t"), K.top_k(seg10(s, d), 2), 1, 10),
        f"with {SEG}, {RANK} select clip_id, t from seg s where gt <> 0 and exists (select 1 from rk a where a.clip_id = s.clip_id and a.r <= 2 and abs(a.t - s.t) <= 1)",
    ),
    "j06_window_iou": (lambda s, d: _iou(s, d).withColumn("iou", R6("iou")), f"with {SEG}, {RANK}, {IOU} select clip_id, evidence_id, window_id, round(iou, 6) as iou from io"),
    "j07_words_to_seconds": (
        lambda s, d: J.words_to_seconds(table(s, d, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("i"), F.col("role").alias("word"), (F.col("turn") * 0.4).alias("start"), (F.col("turn") * 0.4 + 0.4).alias("end")), 10),
        "select conv_id as video_id, cast(floor((turn * 0.4 + turn * 0.4 + 0.4) / 2) as int) as t, string_agg(role, ' ' order by turn * 0.4, turn, role) as text from conversations where floor((turn * 0.4 + turn * 0.4 + 0.4) / 2) between 0 and 9 group by 1, 2",
    ),
    "j09_config_sweep": (
        lambda s, d: J.sweep(seg10(s, d), _configs(s, d)).where("score >= threshold").groupBy("config").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("gt")).alias("precision")),
        f"with {SEG} select cast(c as int) as config, count(*) as n, round(avg(gt), 6) as precision from seg cross join range(8) g(c) where score >= (c - 3) * 0.4 group by 1",
    ),
    "j11_required_available": (
        lambda s, d: table(s, d, "customer").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_anti").select("c_custkey"),
        "select c_custkey from customer where c_custkey not in (select o_custkey from orders)",
    ),
    "j12_merge_windows": (
        lambda s, d: J.merge_windows(_predicted(s, d)),
        f"""with {SEG}, {RANK}, w as (select clip_id, greatest(0.0, t - 1.0)::double as a, (t + 2.0)::double as b from rk where r <= 2), x as (select *, max(b) over (partition by clip_id order by a, b rows between unbounded preceding and 1 preceding) as reach from w),
        y as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by clip_id order by a, b) as isl from x) select clip_id, min(a) as start_s, max(b) as end_s from y group by clip_id, isl""",
    ),
    "j13_aligned_ids": (
        lambda s, d: seg10(s, d).where("gt <> 0").select("clip_id").intersect(seg10b(s, d).where("score > 8").select("clip_id")),
        _sql("select clip_id from seg where gt <> 0 intersect select clip_id from segb where score > 8"),
    ),
    "q01_anchor_quality": (
        lambda s, d: A.recall(seg10(s, d).where("gt <> 0"), K.top_k(seg10(s, d), 2), [0, 1, 2], 10).select("delta", "clips", R6("recall").alias("recall")),
        f"with {SEG}, {RANK} {RECALL}",
    ),
    "a02_recall_variable": (
        lambda s, d: A.recall(seg10(s, d).where("gt <> 0"), K.top_k(seg10(s, d).where("t < 7"), 2), [0, 1, 2], 7).select("delta", "clips", R6("recall").alias("recall")),
        f"with {SEG.replace('seg as', 'seg0 as')}, seg as (select * from seg0 where t < 7), {RANK} {RECALL}",
    ),
    "a03_coverage": (
        lambda s, d: A.coverage(_best_iou(s, d), [0.1, 0.3, 0.5]).select("clip_id", "tau", R6("coverage").alias("coverage")),
        f"with {SEG}, {RANK}, {IOU} select clip_id, v.tau::double as tau, round(avg(case when round(iou, 9) >= v.tau then 1.0 else 0.0 end), 6) as coverage from bi cross join (values (0.1), (0.3), (0.5)) v(tau) group by 1, 2",
    ),
    "a04_coverage_report": (
        lambda s, d: A.mean_std(A.coverage(_best_iou(s, d), [0.1, 0.3, 0.5]), ["tau"], "coverage").select("tau", "n", R6("mean").alias("mean"), R6("std").alias("std")),
        f"with {SEG}, {RANK}, {IOU}, cv as (select clip_id, v.tau::double as tau, avg(case when round(iou, 9) >= v.tau then 1.0 else 0.0 end) as c from bi cross join (values (0.1), (0.3), (0.5)) v(tau) group by 1, 2) select tau, count(*) as n, round(avg(c), 6) as mean, round(coalesce(stddev_samp(c), 0), 6) as std from cv group by 1",
    ),
    "a05_segment_accuracy": (
        lambda s, d: seg10(s, d).withColumn("ok", ((F.col("score") > 8) == (F.col("gt") != 0)).cast("int")).groupBy("clip_id").agg(R6(F.avg("ok")).alias("acc"), R6(F.avg(F.when(F.col("gt") != 0, F.col("ok")))).alias("acc_event")),
        f"with {SEG} select clip_id, round(avg(case when (score > 8) = (gt <> 0) then 1.0 else 0.0 end), 6) as acc, round(avg(case when gt <> 0 then case when score > 8 then 1.0 else 0.0 end end), 6) as acc_event from seg group by 1",
    ),
    "a06_mean_std_seeds": (
        lambda s, d: A.mean_std(_seeds(s, d), ["method"], "acc").select("method", "n", R6("mean").alias("mean"), R6("std").alias("std")),
        f"with {RESULTS}, {SEEDS} select method, count(*) as n, round(avg(acc), 6) as mean, round(coalesce(stddev_samp(acc), 0), 6) as std from sd group by 1",
    ),
    "a07_usage": (
        lambda s, d: A.summary(results(s, d), ["method", "seed"], "q_bar").select("method", "seed", "n", *[R6(c).alias(c) for c in ("mean", "std", "min", "max")]),
        f"with {RESULTS} select method, seed, count(*) as n, round(avg(q_bar), 6) as mean, round(coalesce(stddev_samp(q_bar), 0), 6) as std, round(min(q_bar), 6) as min, round(max(q_bar), 6) as max from res group by 1, 2",
    ),
    "a08_paired_t": (
        lambda s, d: A.paired_t(_paired(s, d).withColumn("all", F.lit("all")), ["all"], "b", "a").select("all", "n", *[R6(c).alias(c) for c in ("delta", "t", "p")]),
        f"with {RESULTS}, {PAIR}, dd as (select 'all' as al, a - b as d from pr), {t_sql('dd', 'al', 'd')} select al as \"all\", n, round(delta, 6) as delta, round(t, 6) as t, round(p, 6) as p from tt",
    ),
    "a09_all_pairs": (
        lambda s, d: _all_pairs(s, d).select("method", "other", "n", *[R6(c).alias(c) for c in ("delta", "t", "p")]),
        f"""with {RESULTS}, it as (select item_id, method, max(correct) as correct from res group by 1, 2), dd as (select a.method, b.method as other, a.correct - b.correct as d from it a join it b on a.item_id = b.item_id and a.method < b.method),
        {t_sql('dd', 'method, other', 'd')} select method, other, n, round(delta, 6) as delta, round(t, 6) as t, round(p, 6) as p from tt""",
    ),
    "a10_bootstrap": (
        lambda s, d: _boot(A.bootstrap(_paired(s, d).withColumn("delta", F.col("a") - F.col("b")).withColumn("all", F.lit("all")), ["all"], "item_id", "delta"), ["all"]),
        f"with {RESULTS}, {PAIR}, dd as (select 'all' as al, item_id, a - b as d from pr), {boot_sql('dd', 'al', 'item_id', 'd')} select al as \"all\", n, round(mean, 6) as mean, round(low, 6) as low, round(high, 6) as high, round(p, 6) as p from bo",
    ),
    "a11_method_summary": (
        lambda s, d: results(s, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("correct")).alias("acc")),
        f"with {RESULTS} select method, count(*) as n, round(avg(correct), 6) as acc from res group by 1",
    ),
    "a12_bucket_table": (
        lambda s, d: A.bucket_table(_items(s, d), "bucket", "method", "correct", "item_id", "5-LOW").select("bucket", "method", "n_items", "n_paired", R6("acc").alias("acc"), R6("delta").alias("delta")),
        f"""with {RESULTS}, it as (select item_id, item_id % 4 as bucket, method, max(correct) as correct from res group by 1, 2, 3), ni as (select bucket, count(distinct item_id) as n_items from it group by 1)
        select a.bucket, a.method, n_items, count(*) as n_paired, round(avg(a.correct), 6) as acc, round(avg(a.correct - b.correct), 6) as delta from it a join it b on b.item_id = a.item_id and b.method = '5-LOW' join ni on ni.bucket = a.bucket where a.method <> '5-LOW' group by 1, 2, 3""",
    ),
    "a13_bucket_significance": (
        lambda s, d: _boot(A.bootstrap(_bucket_deltas(s, d), ["bucket"], "item_id", "delta"), ["bucket"]).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0)),
        f"""with {RESULTS}, {PAIR}, dd as (select item_id % 4 as bucket, item_id, a - b as d from pr), {boot_sql('dd', 'bucket', 'item_id', 'd')}
        select bucket, n, round(mean, 6) as mean, round(low, 6) as low, round(high, 6) as high, round(p, 6) as p, round(low, 6) > 0 or round(high, 6) < 0 as significant from bo""",
    ),
    "a14_quantile_buckets": (
        lambda s, d: A.quantile_buckets(results(s, d), "q_bar", [0.33, 0.66]).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("correct")).alias("acc")),
        f"with {RESULTS}, e as (select quantile_cont(q_bar, 0.33) as a, quantile_cont(q_bar, 0.66) as b from res) select case when q_bar <= a then 'low' when q_bar <= b then 'mid_1' else 'high' end as bucket, count(*) as n, round(avg(correct), 6) as acc from res cross join e group by 1",
    ),
    "a15_conflicts": (
        lambda s, d: A.conflicts(results(s, d), ["item_id", "seed", "method"], "correct").select("item_id", "seed", "method", "values"),
        f"with {RESULTS} select item_id, seed, method, count(distinct correct) as values from res group by 1, 2, 3 having count(distinct correct) > 1",
    ),
    "a15_coverage_matrix": (
        lambda s, d: A.coverage_matrix(results(s, d), "item_id", "method"),
        f"with {RESULTS}, r as (select * from res) select a.item_id, m.method from (select distinct item_id from r) a cross join (select distinct method from r) m where not exists (select 1 from r where r.item_id = a.item_id and r.method = m.method)",
    ),
    "a16_budget_curve": (
        lambda s, d: _curve(s, d),
        f"""with {RESULTS}, b as (select seed, (row_id % 3 + 1) * 4 as budget, method, avg(correct) as acc from res group by 1, 2, 3) select a.budget, a.method, count(*) as n, round(avg(a.acc), 6) as mean, round(coalesce(stddev_samp(a.acc), 0), 6) as std, round(avg(a.acc - u.acc), 6) as delta
        from b a join b u on u.seed = a.seed and u.budget = a.budget and u.method = '5-LOW' group by 1, 2""",
    ),
    "a17_coverage_sensitivity": (
        lambda s, d: _seeds(s, d).groupBy("method").agg(F.avg("acc").alias("before")).join(results(s, d).where("q_bar > 450000").groupBy("method").agg(F.avg("correct").alias("after")), "method", "full").select("method", R6(F.coalesce("before", F.lit(0.0))).alias("before"), R6(F.coalesce("after", F.lit(0.0))).alias("after")),
        f"with {RESULTS}, {SEEDS} select method, round(coalesce(b, 0), 6) as before, round(coalesce(a, 0), 6) as after from (select method, avg(acc) as b from sd group by 1) full join (select method, avg(correct) as a from res where q_bar > 450000 group by 1) using (method)",
    ),
    "a18_answer_prior": (
        lambda s, d: A.answer_prior(results(s, d), "item_id", "method").withColumn("share", R6("share")),
        f"with {RESULTS}, f as (select arg_min(method, row_id) as answer from res group by item_id), c as (select answer, count(*) as n from f group by 1) select answer, n, round(n / sum(n) over (), 6) as share, answer = (select answer from c order by n desc, answer desc limit 1) as top from c",
    ),
    "a18_prior_report": (
        lambda s, d: A.prior_report(_first_answers(s, d).where("item_id % 2 = 0"), _first_answers(s, d).where("item_id % 2 = 1"), results(s, d).groupBy("method").agg(F.avg("correct").alias("acc"))).select("method", "top_answer", *[R6(c).alias(c) for c in ("acc", "prior_acc", "sampling_acc", "delta")]),
        f"""with {RESULTS}, f as (select item_id, arg_min(method, row_id) as answer from res group by 1), c as (select answer, sum(case when item_id % 2 = 0 then 1 else 0 end) as a, sum(case when item_id % 2 = 1 then 1 else 0 end) as b from f group by 1),
        x as (select answer, a / sum(a) over () as p, b / sum(b) over () as q, row_number() over (order by a desc, answer) as r from c), y as (select max(answer) filter (where r = 1) as top_answer, sum(case when r = 1 then q else 0 end) as prior_acc, sum(p * q) as sampling_acc from x)
        select method, top_answer, round(avg(correct), 6) as acc, round(max(prior_acc), 6) as prior_acc, round(max(sampling_acc), 6) as sampling_acc, round(avg(correct) - max(prior_acc), 6) as delta from res cross join y group by 1, 2""",
    ),
    "k17_bucket_extremes": (
        lambda s, d: K.extremes(A.bucket_table(_items(s, d), "bucket", "method", "correct", "item_id", "5-LOW").where("method = '1-URGENT'").select("bucket", R6("delta").alias("delta")), "delta", "bucket", 2).select("bucket", "delta", "end"),
        f"""with {RESULTS}, it as (select item_id, item_id % 4 as bucket, method, max(correct) as correct from res group by 1, 2, 3), b as (select a.bucket, round(avg(a.correct - u.correct), 6) as delta from it a join it u on u.item_id = a.item_id and u.method = '5-LOW' where a.method = '1-URGENT' group by 1)
        select * from (select bucket, delta, 'best' as "end" from b order by delta desc, bucket limit 2) union all select * from (select bucket, delta, 'worst' from b order by delta, bucket limit 2)""",
    ),
    "a19_correlations": (
        lambda s, d: A.correlations(seg10(s, d).join(seg10b(s, d).select("clip_id", "t", F.col("score").alias("other")), ["clip_id", "t"]), ["clip_id"], "score", "other").select("clip_id", "n", R6("pearson").alias("pearson"), R6("spearman").alias("spearman")),
        _sql("""select clip_id, count(*) as n, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from (select *, rank() over (partition by clip_id order by x) + (count(*) over (partition by clip_id, x) - 1) / 2.0 as rx,
        rank() over (partition by clip_id order by y) + (count(*) over (partition by clip_id, y) - 1) / 2.0 as ry from (select clip_id, t, seg.score as x, segb.score as y from seg join segb using (clip_id, t))) group by 1 having stddev_pop(x) > 1e-12 and stddev_pop(y) > 1e-12"""),
    ),
    "a20_percentiles": (
        lambda s, d: A.percentiles(results(s, d), ["method"], "q_bar").select("method", *[R6(c).alias(c) for c in ("p10", "p50", "p90")]),
        f"with {RESULTS} select method, round(quantile_cont(q_bar, 0.1), 6) as p10, round(quantile_cont(q_bar, 0.5), 6) as p50, round(quantile_cont(q_bar, 0.9), 6) as p90 from res group by 1",
    ),
    "a21_histograms": (
        lambda s, d: A.histograms(results(s, d).withColumn("bucket", F.col("item_id") % 4).withColumn("price", F.floor(F.col("q_bar") / 100000)), ["method", "seed", "bucket", "price"], "correct").select("dim", "bin", "n", R6("mean").alias("mean")),
        f"with {RESULTS} " + " union all ".join(f"select '{n}' as dim, cast({e} as varchar) as bin, count(*) as n, round(avg(correct), 6) as mean from res group by 2" for n, e in (("method", "method"), ("seed", "seed"), ("bucket", "item_id % 4"), ("price", "cast(floor(q_bar / 100000) as bigint)"))),
    ),
    "a22_average_precision": (
        lambda s, d: A.average_precision(_scored(s, d)).select("class", R6("ap").alias("ap")),
        f"with {SCORED}, r as (select *, row_number() over w as r, sum(y) over (partition by class order by score desc, item rows unbounded preceding) as tp from sc window w as (partition by class order by score desc, item)) select class, round(avg(tp / r), 6) as ap from r where y = 1 group by 1",
    ),
    "a23_macro_f1": (
        lambda s, d: A.macro_f1(_scored(s, d), 0.5).select(R6("macro_f1").alias("macro_f1"), "classes"),
        f"""with {SCORED}, c as (select class, sum(case when score >= 0.5 and y = 1 then 1 else 0 end) as tp, sum(case when score >= 0.5 and y = 0 then 1 else 0 end) as fp, sum(case when score < 0.5 and y = 1 then 1 else 0 end) as fn from sc group by 1)
        select round(avg(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end), 6) as macro_f1, count(*) as classes from c""",
    ),
    "a24_fallback_share": (
        lambda s, d: K.select_anchors(seg10(s, d), 2, 10, threshold=1.0).agg(R6(F.avg(F.col("fallback_used").cast("int"))).alias("share"), F.count(F.lit(1)).alias("clips")),
        f"with {SEG}, {CONF} select round(avg(case when std < 1.0 then 1.0 else 0.0 end), 6) as share, count(*) as clips from cf",
    ),
    "a25_pareto": (
        lambda s, d: A.pareto(results(s, d).groupBy("method", "seed").agg(R6(F.avg("q_bar")).alias("tokens"), R6(F.avg("correct")).alias("acc")), "tokens", "acc"),
        f"with {RESULTS}, p as (select method, seed, round(avg(q_bar), 6) as tokens, round(avg(correct), 6) as acc from res group by 1, 2) select * from p a where not exists (select 1 from p b where (b.tokens < a.tokens or (b.tokens = a.tokens and b.acc > a.acc)) and b.acc >= a.acc)",
    ),
    "a26_oracle_gap": (
        lambda s, d: _seeds(s, d).groupBy("seed").agg(R6(F.max("acc") - F.max(F.when(F.col("method") == "5-LOW", F.col("acc")))).alias("gap")),
        f"with {RESULTS}, {SEEDS} select seed, round(max(acc) - max(acc) filter (where method = '5-LOW'), 6) as gap from sd group by 1",
    ),
    "a27_gate_sweep": (
        lambda s, d: J.sweep(C.confidence(seg10(s, d)).select("clip_id", "std"), _configs(s, d)).join(seg10(s, d).groupBy("clip_id").agg(F.max("gt").alias("gt")), "clip_id").groupBy("config").agg(R6(F.avg(F.when(F.col("std") >= F.col("threshold"), F.col("gt")).otherwise(0))).alias("value")).agg(F.max_by("config", F.struct("value", -F.col("config"))).alias("best"), F.max("value").alias("value")),
        f"with {SEG}, {CONF}, g as (select clip_id, max(gt) as gt from seg group by 1), v as (select cast(c as int) as config, round(avg(case when std >= (c - 3) * 0.4 then gt else 0 end), 6) as value from cf join g using (clip_id) cross join range(8) r(c) group by 1) select config as best, value from v order by value desc, config limit 1",
    ),
    "a28_config_pick": (
        lambda s, d: A.pick_config(_deltas(s, d)).select("config", R6("delta").alias("delta"), R6("p").alias("p"), "pick"),
        f"""with {RESULTS}, {SEEDS}, {DELTAS}, {t_sql('dd', 'config', 'd')}
        select config, round(delta, 6) as delta, round(p, 6) as p, cast(r as int) as pick from (select *, row_number() over (order by case when delta > 0 and p < 0.05 then 0 when delta > 0 then 1 else 2 end, round(delta, 9) desc, round(p, 9), config) as r from tt) where r <= 3""",
    ),
    "a29_degradation_table": (
        lambda s, d: recall_grid(seg10(s, d), grid_cells(s), 2, [0, 1, 2], 10, 7).select("shift", "snr", "silence", "delta", R6("recall").alias("recall")),
        f"with {SEG}, {GRID_SQL} select shift, snr, silence, delta, round(avg(r), 6) as recall from gr group by 1, 2, 3, 4",
    ),
    "a30_alpha_floor": (
        lambda s, d: A.alpha_floor(_seeds(s, d).groupBy("seed").agg(F.max(F.when(F.col("method") == "1-URGENT", F.col("acc"))).alias("anchored"), F.max(F.when(F.col("method") == "5-LOW", F.col("acc"))).alias("uniform")), 0.95).select("seed", R6("margin").alias("margin"), "ok"),
        f"with {RESULTS}, {SEEDS}, x as (select seed, max(acc) filter (where method = '1-URGENT') as a, max(acc) filter (where method = '5-LOW') as u from sd group by 1) select seed, round(a - 0.95 * u, 6) as margin, a - 0.95 * u >= 0 as ok from x",
    ),
    "a31_root_causes": (
        lambda s, d: A.root_causes(_facts(s, d)).select("config", F.concat_ws(",", "reasons").alias("reasons"), "proven"),
        f"with {SEG}, {SEGB}, {CONF}, {RANK}, {IOU}, {RESULTS}, {SEEDS}, {DELTAS}, {t_sql('dd', 'config', 'd')}, {FACTS_SQL} {CAUSES_SQL}",
    ),
    "a32_gate_decision": (
        lambda s, d: _deltas(s, d).select("config", ((F.col("delta") >= 0.001) & (F.col("p") < 0.5)).alias("promote")),
        f"with {RESULTS}, {SEEDS}, {DELTAS}, {t_sql('dd', 'config', 'd')} select config, delta >= 0.001 and p < 0.5 as promote from tt",
    ),
    "a33_duration_audit": (
        lambda s, d: A.duration_audit(_intervals(s, d).select(F.col("clip_id").alias("video_id"), F.col("end_s").alias("stop_s")), seg10(s, d).where("clip_id % 7 <> 0").groupBy(F.col("clip_id").alias("video_id")).agg((F.max("t") - F.col("video_id") % 3).cast("double").alias("have")), 0.5).select("video_id", R6("need").alias("need"), "have", "status"),
        f"with {SEG}, {INTERVALS}, n as (select clip_id as video_id, max(end_s) as need from iv group by 1), h as (select clip_id as video_id, (max(t) - clip_id % 3)::double as have from seg where clip_id % 7 <> 0 group by clip_id) select video_id, round(need, 6) as need, have, case when have is null then 'missing' when have < need - 0.5 then 'short' else 'ok' end as status from n left join h using (video_id)",
    ),
    "a34_size_summary": (
        lambda s, d: A.sizes_summary(table(s, d, "documents"), ["source"], "n_chars").select("source", "n", "min", R6("p10").alias("p10"), R6("median").alias("median"), R6("p90").alias("p90"), "max", "total"),
        "select source, count(n_chars) as n, min(n_chars) as min, round(quantile_cont(n_chars, 0.1), 6) as p10, round(median(n_chars), 6) as median, round(quantile_cont(n_chars, 0.9), 6) as p90, max(n_chars) as max, cast(sum(n_chars) as bigint) as total from documents group by 1",
    ),
    "a35_integrity": (
        lambda s, d: table(s, d, "pages").select(F.col("html").contains("<html").alias("probe_ok"), F.col("html").contains("</html>").alias("decode_ok")).groupBy("probe_ok", "decode_ok").agg(F.count(F.lit(1)).alias("n")),
        "select contains(html, '<html') as probe_ok, contains(html, '</html>') as decode_ok, count(*) as n from pages group by 1, 2",
    ),
    "a36_faithfulness": (
        lambda s, d: _paired(s, d).agg(R6(F.avg("a")).alias("acc"), R6(F.avg("b")).alias("deleted_acc"), R6(F.avg((F.col("a") != F.col("b")).cast("int"))).alias("changed")),
        f"with {RESULTS}, {PAIR} select round(avg(a), 6) as acc, round(avg(b), 6) as deleted_acc, round(avg(case when a <> b then 1.0 else 0.0 end), 6) as changed from pr",
    ),
    "o01_total_order": (
        lambda s, d: results(s, d).groupBy("method").agg(F.count(F.lit(1)).alias("n")).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "method"))),
        f"with {RESULTS} select method, n, cast(row_number() over (order by n desc, method) as int) as pos from (select method, count(*) as n from res group by 1)",
    ),
    "o02_segment_order": (
        lambda s, d: _intervals(s, d).select("clip_id", "label", F.row_number().over(Window.partitionBy("clip_id").orderBy("start_s", "end_s", "label")).alias("pos")),
        f"with {INTERVALS} select clip_id, label, cast(row_number() over (partition by clip_id order by start_s, end_s, label) as int) as pos from iv",
    ),
    "o03_limit_after_order": (lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice"), "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25"),
    "o04_stable_unique": (
        lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first")),
        "select o_custkey, min(o_orderkey) as first from orders group by 1",
    ),
    "o05_o06_union": (
        lambda s, d: table(s, d, "supplier").select(F.col("s_nationkey").alias("k")).union(table(s, d, "customer").select(F.col("c_nationkey").alias("k"))).distinct(),
        "select s_nationkey as k from supplier union select c_nationkey from customer",
    ),
    "o07_intersect": (lambda s, d: table(s, d, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(s, d, "customer").select(F.col("c_nationkey").alias("k"))), "select s_nationkey as k from supplier intersect select c_nationkey from customer"),
    "o08_difference": (
        lambda s, d: table(s, d, "documents").select("doc_id").exceptAll(table(s, d, "labels").select("doc_id")),
        "select doc_id from documents except all select doc_id from labels",
    ),
}


def _items(s, d):
    return results(s, d).groupBy("item_id", "method").agg(F.max("correct").alias("correct")).withColumn("bucket", F.col("item_id") % 4)


def _deltas(s, d):
    """(config, delta, p): methods against the last one, tested in pairs over seeds."""
    base = _seeds(s, d).where("method = '5-LOW'").select("seed", F.col("acc").alias("base"))
    return A.paired_t(_seeds(s, d).where("method <> '5-LOW'").join(base, "seed").withColumn("config", F.col("method")), ["config"], "base", "acc").select("config", "delta", "p")


def _all_pairs(s, d):
    """Every pair of methods tested over items that have both."""
    it = _items(s, d).select("item_id", "method", "correct")
    other = it.select("item_id", F.col("method").alias("other"), F.col("correct").alias("base"))
    return A.paired_t(it.join(other, "item_id").where("method < other"), ["method", "other"], "base", "correct")


def _curve(s, d):
    by = results(s, d).withColumn("budget", ((F.col("row_id") % 3 + 1) * 4).cast("long")).groupBy("seed", "budget", "method").agg(F.avg("correct").alias("acc"))
    base = by.where("method = '5-LOW'").select("seed", "budget", F.col("acc").alias("base"))
    rows = by.join(base, ["seed", "budget"])
    return rows.groupBy("budget", "method").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("acc")).alias("mean"), R6(F.coalesce(F.stddev_samp("acc"), F.lit(0.0))).alias("std"), R6(F.avg(F.col("acc") - F.col("base"))).alias("delta"))
