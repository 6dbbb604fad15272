"""Registered queries: the remaining scans and sinks (section S), recall by clip, the perturbation grid and the gate
classifier, with their SQL. Each scan reads back what Spark wrote from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import scratch, stored
from ..operators import anchors as K
from ..operators import confidence as C
from ..operators import joins as J
from ..operators import learned as M
from ..sources import readers as R
from ..views import RESULTS, SEG, results, seg10, table
from .queries_plans import RANK
from .queries_series import R6

SPLITS = ("train", "val", "test")
SPLIT_SQL = "case c_custkey % 3 when 0 then 'train' when 1 then 'val' else 'test' end"


def _split_scan(s, d):
    """One annotation file a split."""
    line = F.concat_ws("&", "c_mktsegment", F.col("c_custkey").cast("string"), F.lit("good"), F.lit("0"), F.col("c_nationkey").cast("string"))
    paths = {name: scratch(s, name) for name in SPLITS}
    rows = table(s, d, "customer").select((F.col("c_custkey") % 3).alias("part"), line.alias("value"))
    for part, path in enumerate(paths.values()):
        rows.where(F.col("part") == part).select("value").write.text(path)
    return R.splits(s, paths).select("split", "clip_id", "label", "end_s")


def _split_order(s, d):
    """The same splits as positions into the annotations."""
    clips = table(s, d, "customer").select(F.col("c_custkey").alias("pos"), "c_mktsegment")
    name = F.element_at(F.array(*map(F.lit, SPLITS)), (F.col("c_custkey") % 3 + 1).cast("int"))
    return R.splits_by_order(clips, table(s, d, "customer").select(name.alias("split"), F.col("c_custkey").alias("pos")))


def _clip_list(s, d):
    path = scratch(s, "clips")
    table(s, d, "customer").select(F.concat(F.lit("yt"), "c_custkey"), "c_nationkey", "c_mktsegment", F.lit("test")).write.csv(path)
    return R.clip_list(s, path)


def _wide_qa(s, d):
    path = scratch(s, "qa")
    rows = table(s, d, "customer")
    options = [F.concat(F.col("c_mktsegment"), F.lit(f" {i}")).alias(f"a{i}") for i in range(5)]
    question = F.when(F.col("c_custkey") % 7 == 0, F.lit(" ")).otherwise(F.col("c_name"))
    rows.select(F.col("c_custkey").cast("string").alias("qid"), question.alias("question"), *options, (F.col("c_custkey") % 5).cast("int").alias("answer")).write.option("header", True).csv(path)
    schema = s.createDataFrame([], "qid string, question string, a0 string, a1 string, a2 string, a3 string, a4 string, answer int").schema
    read = R.wide_options(R.csv_rows(s, path, schema, ["qid", "answer"]), [f"a{i}" for i in range(5)], "answer")
    return read.select("qid", "question", F.get("options", F.col("answer")).alias("right"))


def _qa_parquet(s, d):
    path = scratch(s, "qa")
    table(s, d, "customer").select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey").cast("string")).alias("question_idx"), F.col("c_name").alias("question")).write.parquet(path)
    return R.qa_parquet(s, path).select("question", F.when(F.col("question_idx").contains(":"), F.lit("made")).otherwise(F.col("question_idx")).alias("idx"))


def _idempotent_snapshot(s, d):
    """The second write finds a snapshot and leaves it; the third is forced."""
    kept, forced = scratch(s, "kept"), scratch(s, "forced")
    for path, force in ((kept, False), (forced, True)):
        R.materialize_json(table(s, d, "documents").select("doc_id"), path)
        R.materialize_json(table(s, d, "labels").select("doc_id"), path, force)
    read = lambda path, name: s.read.schema("doc_id long").json(path).select(F.lit(name).alias("snapshot"), "doc_id")
    return read(kept, "kept").unionByName(read(forced, "forced"))


def _custom_clips(s, d):
    path = scratch(s, "clips")
    hit = F.sort_array(F.collect_list(F.when(F.col("gt") != 0, F.col("t"))))
    seg10(s, d).groupBy(F.col("clip_id").cast("string").alias("clip_id")).agg(hit.alias("gt_segments"), F.count(F.lit(1)).cast("int").alias("num_segments")).write.json(path)
    return R.custom_clips(s, path).select("clip_id", "num_segments", F.array_join(F.col("gt_segments").cast("array<string>"), ",").alias("gt"))


def _run_metrics(s, d):
    """One file for each seed; the folder is named twice and still read once."""
    path = scratch(s, "runs")
    one = results(s, d).groupBy("seed", "method").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("acc"))
    summary = F.collect_list(F.struct("method", "n", "acc", F.lit(0.0).alias("invalid_rate")))
    one.groupBy("seed").agg(F.lit(16).alias("budget_frames"), F.sum("n").alias("n_items"), summary.alias("summary")).write.option("maxRecordsPerFile", 1).json(path)
    return R.run_metrics(s, [path, path]).select("seed", "budget_frames", "method", "n", R6("acc").alias("acc"))


def _plan_sink(s, d):
    path = scratch(s, "plans")
    R.write_plans(seg10(s, d).select("clip_id", "t", F.when(F.col("gt") != 0, 352).otherwise(160).alias("resolution"), F.lit(196).alias("tokens")), path)
    return s.read.schema("clip_id long, resolutions array<int>, tokens long").json(path).select("clip_id", F.array_join(F.col("resolutions").cast("array<string>"), ",").alias("plan"), "tokens")


def _report_sink(s, d):
    path = scratch(s, "report")
    R.write_report(results(s, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("correct")), path)
    return s.read.schema("method string, n long, correct long").json(path)


def _inventory(s, d):
    """Names and sizes of the table files; their content isn't read."""
    return R.file_inventory(s, d, "*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "is_pointer")


def _recall_by_clip(s, d):
    truth = seg10(s, d).where("gt <> 0").select("clip_id", "t")
    near = J.hits(truth, K.top_k(seg10(s, d), 2), 1, 10).withColumn("hit", F.lit(1))
    return truth.join(near, ["clip_id", "t"], "left").groupBy("clip_id").agg(R6(F.avg(F.coalesce("hit", F.lit(0)))).alias("recall"))


def _grid(s, d):
    """Every clip under every cell of the robustness grid."""
    shifts, ratios, silences = (s.createDataFrame([(x,) for x in values], f"{name} double") for name, values in (("shift", (-1.0, 0.0, 1.0)), ("snr", (20.0, 10.0, 0.0)), ("silence", (0.0, 0.3))))
    return J.sweep(seg10(s, d), shifts, ratios, silences).groupBy("shift", "snr", "silence").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(F.col("score") + F.col("shift"))).alias("mean"))


def _gate_classifier(s, d):
    """(gate, clip_id, label, p): three gates, fitted on the clips with even ids and answered for all. ``top1_hit``:
    is the best second an event, learnt from clips that have events; ``top1_hit_all``: the same from all clips;
    ``second_hit``: is the second anchor an event, learnt from clips whose two anchors disagree. A gate with fewer than
    64 rows has no answer."""
    scores = stored(seg10(s, d), "seg")
    events = scores.groupBy("clip_id").agg(F.sum((F.col("gt") != 0).cast("int")).alias("events"))
    hit = K.top_k(scores, 2).join(scores.select("clip_id", "t", "gt"), ["clip_id", "t"]).groupBy("clip_id").agg(*[F.max(F.when(F.col("rank") == k, F.col("gt"))).alias(f"hit{k}") for k in (1, 2)])
    gate = C.gate_features(scores).select("clip_id", F.array(*[F.coalesce(c, F.lit(0.0)) for c in C.GATE_FEATURES]).alias("features"))
    names = ["peak1", "peak2", "peak3", "near1", "near2", "distance", "mean", "median", "gap12", "gap23", "std", "gini"]
    second = C.second_anchor_features(scores).select("clip_id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]).alias("features"))
    out = None
    for name, features, label, rule in (("top1_hit", gate, "hit1", F.col("events") > 0), ("top1_hit_all", gate, "hit1", F.lit(True)), ("second_hit", second, "hit2", F.col("hit1") != F.col("hit2"))):
        rows = stored(features.join(hit, "clip_id").join(events, "clip_id").where(F.col(label).isNotNull()).withColumn("label", F.col(label)), name)
        train = M.gate_rows(rows, rule & (F.col("clip_id") % 2 == 0), least=64)
        scored = rows.withColumn("p", F.lit(None).cast("double")) if train is None else M.predict(M.logistic(train), rows)
        scored = scored.select(F.lit(name).alias("gate"), "clip_id", "label", "p")
        out = scored if out is None else out.unionByName(scored)
    return out


QUERIES = {
    "s02_split_files": (_split_scan, f"select {SPLIT_SQL} as split, cast(c_custkey as varchar) as clip_id, c_mktsegment as label, c_nationkey::double as end_s from customer"),
    "s02_split_order": (_split_order, f"select c_custkey as pos, c_mktsegment, {SPLIT_SQL} as split from customer"),
    "s04_clip_list": (_clip_list, "select 'yt' || c_custkey as youtube_id, cast(c_nationkey as int) as start_sec, c_mktsegment as label, 'test' as split from customer"),
    "s06_wide_options": (_wide_qa, "select cast(c_custkey as varchar) as qid, c_name as question, c_mktsegment || ' ' || (c_custkey % 5) as right from customer where c_custkey % 7 <> 0"),
    "s07_qa_parquet": (_qa_parquet, "select c_name as question, case when c_custkey % 4 = 0 then 'made' else cast(c_custkey as varchar) end as idx from customer"),
    "s09_idempotent_snapshot": (_idempotent_snapshot, "select 'kept' as snapshot, doc_id from documents union all select 'forced', doc_id from labels"),
    "s10_custom_clips": (_custom_clips, f"with {SEG} select cast(clip_id as varchar) as clip_id, cast(count(*) as int) as num_segments, coalesce(string_agg(cast(t as varchar), ',' order by t) filter (where gt <> 0), '') as gt from seg group by 1"),
    "s12_run_metrics": (_run_metrics, f"with {RESULTS} select seed, 16 as budget_frames, method, count(*) as n, round(avg(correct), 6) as acc from res group by 1, 3"),
    "s15_plan_sink": (_plan_sink, f"with {SEG} select clip_id, string_agg(case when gt <> 0 then '352' else '160' end, ',' order by t) as plan, cast(count(*) * 196 as bigint) as tokens from seg group by 1"),
    "s16_report_sink": (_report_sink, f"with {RESULTS} select method, count(*) as n, cast(sum(correct) as bigint) as correct from res group by 1"),
    "s17_file_inventory": (_inventory, None),
    "a01_recall_by_clip": (_recall_by_clip, f"with {SEG}, {RANK} select clip_id, round(avg(case when near <= 1 then 1.0 else 0.0 end), 6) as recall from (select s.clip_id, s.t, min(abs(s.t - a.t)) as near from seg s join rk a on a.clip_id = s.clip_id and a.r <= 2 where s.gt <> 0 group by 1, 2) group by 1"),
    "j10_perturbation_grid": (_grid, f"with {SEG} select a.x::double as shift, b.x::double as snr, c.x::double as silence, count(*) as n, round(avg(score + a.x), 6) as mean from seg cross join (values (-1.0::double), (0.0), (1.0)) a(x) cross join (values (20.0), (10.0), (0.0)) b(x) cross join (values (0.0), (0.3)) c(x) group by 1, 2, 3"),
    "m03_gate_classifier": (_gate_classifier, None),
}
