"""Registered queries: text relevance, perturbations, sources and learned scores (sections X, D, S, M) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import scratch
from ..operators import learned as M
from ..operators import perturb as D
from ..operators import series as T
from ..operators import text as X
from ..sources import readers as R
from ..views import SEG, seg10, seg10b, table
from .queries_heads import _labelled
from .queries_series import INTERVALS, MM, R6, SAMPLES, VEC, _intervals, _samples, _vectors


def _texts(s, d):
    return table(s, d, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("doc"), "text")


def _query(s, d):
    """One benchmark item a source: the one whose number ends the source's name."""
    return table(s, d, "benchmark").select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("grp"), "text")


TOK = r"regexp_extract_all(lower(text), '([a-z0-9]+)', 1)"
DOCS = "dc as (select source as grp, doc_id as doc, text from documents), qy as (select 'src' || item_id as grp, text from benchmark)"
TFIDF = f"""{DOCS}, cp as (select grp, doc, text, false as q from dc union all select grp, null, text, true from qy),
tk as (select grp, doc, q, unnest({TOK}) as term from cp), tf as (select grp, doc, q, term, count(*) as tf from tk group by 1, 2, 3, 4),
nn as (select grp, count(*) as n from cp group by 1), df as (select grp, term, count(*) as df from tf group by 1, 2),
w as (select tf.grp, doc, q, term, tf * (ln((1.0 + n) / (1 + df)) + 1) as w from tf join df using (grp, term) join nn using (grp)),
nm as (select grp, doc, q, sqrt(sum(w * w)) as norm from w group by 1, 2, 3),
dt as (select a.grp, a.doc, sum(a.w * b.w) as dot from w a join w b on b.q and b.grp = a.grp and b.term = a.term where not a.q group by 1, 2)
select dc.grp, dc.doc, round(coalesce(dot / (a.norm * b.norm), 0), 6) as score from dc left join dt using (grp, doc) left join nm a on a.grp = dc.grp and a.doc = dc.doc and not a.q left join nm b on b.grp = dc.grp and b.q"""
BM25 = f"""{DOCS}, tf as (select grp, doc, term, count(*) as tf from (select grp, doc, unnest({TOK}) as term from dc) group by 1, 2, 3),
dl as (select grp, doc, len({TOK}) as dl from dc), nn as (select grp, count(*) as n, avg(dl) as avgdl from dl group by 1),
df as (select grp, term, n, avgdl, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as idf0 from tf join nn using (grp) group by 1, 2, 3, 4),
mi as (select grp, avg(idf0) as m from df group by 1), qt as (select grp, term, count(*) as times from (select grp, unnest({TOK}) as term from qy) group by 1, 2),
id as (select df.grp, df.term, times, avgdl, case when idf0 < 0 then 0.25 * m else idf0 end as idf from df join qt using (grp, term) join mi using (grp)),
sc as (select tf.grp, tf.doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from tf join id using (grp, term) join dl using (grp, doc) group by 1, 2)
select dc.grp, dc.doc, round(coalesce(score, 0), 6) as score from dc left join sc using (grp, doc)"""


def _roundtrip(s, d, name, write, read):
    path = scratch(s, name)
    write(path)
    return read(path)


def _annotations(s, d):
    rows = table(s, d, "customer").select(F.concat_ws("&", F.col("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit("good"), (F.col("c_custkey") % 7).cast("string"), (F.col("c_custkey") % 7 + 2).cast("string")).alias("value"))
    head = s.range(1).select(F.lit("Category&VideoID&Quality&StartTime&EndTime").alias("value"))
    return _roundtrip(s, d, "annotations", lambda p: head.union(rows).write.text(p), lambda p: R.annotations(s, p))


def _segment_head(s, d):
    """(clip_id, t, label, prediction): the class of each second, which is its most frequent kind of event."""
    kinds = table(s, d, "events").groupBy(F.col("user_id").alias("clip_id"), F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 3).cast("int").alias("t"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    wide = kinds.groupBy("clip_id", "t").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("kind"), *[F.sum(F.when(F.col("event_type") == k, F.col("v")).otherwise(0.0)).alias(k) for k in ("view", "click", "purchase")])
    classes = F.array_position(F.array(*[F.lit(k) for k in ("view", "click", "purchase")]), F.col("kind")).cast("int")
    rows = wide.select("clip_id", "t", F.array("view", "click", "purchase").alias("features"), classes.alias("label"))
    model = M.mlp(rows.where("clip_id % 2 = 0"), [3, 8, 4])
    return M.predict_class(model, rows).select("clip_id", "t", "label", F.col("prediction").cast("int").alias("prediction"))


def _json_arrays(rows):
    """(part, value): the rows as JSON arrays of about a thousand objects."""
    parts = rows.count() // 1000 + 2
    return rows.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("item_id", "text")))).alias("value"))


def _clip_labels(s, d):
    """(clip_id, label): the kinds of events that more than a fifth of a clip's events are."""
    kinds = table(s, d, "events").groupBy(F.col("user_id").alias("clip_id"), F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(kinds.groupBy("clip_id").agg(F.sum("n").alias("all")), "clip_id").where("n > 0.2 * all").select("clip_id", "label")


QUERIES = {
    "x01_tokens": (lambda s, d: table(s, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n")), f"select doc_id, cast(len({TOK}) as int) as n from documents"),
    "x02_tfidf": (lambda s, d: X.tfidf_relevance(_texts(s, d), _query(s, d)).withColumn("score", R6("score")), f"with {TFIDF}"),
    "x03_bm25": (lambda s, d: X.bm25_relevance(_texts(s, d), _query(s, d)).withColumn("score", R6("score")), f"with {BM25}"),
    "x04_normalised": (
        lambda s, d: T.minmax(X.bm25_relevance(_texts(s, d), _query(s, d)).select(F.col("grp").alias("clip_id"), F.col("doc").alias("t"), "score")).withColumn("score", R6("score")),
        f"with {BM25.replace('select dc.grp, dc.doc, round(coalesce(score, 0), 6) as score', ', bm as (select dc.grp as clip_id, dc.doc as t, coalesce(score, 0) as score')}) select clip_id, t, round({MM}, 6) as score from bm window w as (partition by clip_id)",
    ),
    "x05_embedding_relevance": (
        lambda s, d: X.embedding_relevance(_vectors(s, d), _vectors(s, d).where("t = 0").select("clip_id", F.col("emb").alias("q"))).withColumn("score", R6("score")),
        f"with {VEC} select a.clip_id, a.t, round(list_cosine_similarity(a.emb, b.emb), 6) as score from vec a join vec b on b.clip_id = a.clip_id and b.t = 0",
    ),
    "x07_answer_index": (
        lambda s, d: table(s, d, "customer").select("c_custkey", X.answer_index(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, (F.col("c_custkey") % 9).cast("string")).otherwise(F.substring(F.lit("ABCDEFGH"), (F.col("c_custkey") % 8 + 1).cast("int"), F.lit(1))), F.array(*map(F.lit, ("BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE")))).alias("idx")),
        """select c_custkey, cast(case when i between 0 and 3 then i end as int) as idx from (select c_custkey, case when c_custkey % 3 = 0 then list_position(['BUILDING', 'MACHINERY', 'FURNITURE', 'AUTOMOBILE'], c_mktsegment) - 1
        when c_custkey % 3 = 1 then c_custkey % 9 else c_custkey % 8 end as i from customer)""",
    ),
    "x08_spoken_letter": (
        lambda s, d: table(s, d, "conversations").select("conv_id", "turn", X.spoken_letter(F.col("text"), 4).alias("idx")),
        r"select conv_id, turn, case when l <> '' and ascii(upper(l)) - 65 < 4 then ascii(upper(l)) - 65 end as idx from (select conv_id, turn, regexp_extract(text, '\b([A-Ea-e])\b', 1) as l from conversations)",
    ),
    "x09_prompt": (
        lambda s, d: table(s, d, "benchmark").select("item_id", X.prompt(F.col("text"), F.array(F.lit("yes"), F.lit("no")), F.array(F.struct(F.lit(1.0).alias("start_s"), F.lit(2.5).alias("end_s")))).alias("prompt")),
        "select item_id, text || chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || 'Windows: 1.0-2.5' as prompt from benchmark",
    ),
    "x10_clip_name": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", *[c.alias(n) for c, n in zip(X.clip_name(F.concat_ws("_", F.col("o_orderpriority"), F.lit("x"), F.col("o_custkey"))), ("video", "start"), strict=True)]),
        "select o_orderkey, o_orderpriority || '_x' as video, cast(o_custkey as int) as start from orders",
    ),
    "x11_clock_seconds": (
        lambda s, d: table(s, d, "events").select("event_id", R6(X.clock_seconds(F.date_format("ts", "HH:mm:ss.SSS"))).alias("sec")),
        "select event_id, round(hour(ts) * 3600 + minute(ts) * 60 + floor(millisecond(ts)) / 1000.0::double, 6) as sec from events",
    ),
    "x12_stable_offset": (
        lambda s, d: table(s, d, "part").select("p_partkey", X.stable_offset(F.col("p_name"), 97).alias("off")),
        "select p_partkey, cast(('0x' || substr(sha1(p_name), 1, 8))::ubigint % 97 as bigint) as off from part",
    ),
    "x13_a37_literal_paths": (
        lambda s, d: table(s, d, "pages").select("page_id", F.size(X.literal_paths(F.col("url"))).alias("n")),
        r"select page_id, cast(len(regexp_extract_all(url, '([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[a-z0-9]+)', 1)) as int) as n from pages",
    ),
    "d01_shift_samples": (
        lambda s, d: D.shift_samples(_samples(s, d), 0.5, 4),
        f"with {SAMPLES} select a.clip_id, a.idx, coalesce(b.amp, 0) as amp from smp a left join smp b on b.clip_id = a.clip_id and b.idx = a.idx - 2",
    ),
    "d02_noise": (
        lambda s, d: D.add_noise(_samples(s, d), 20.0, 3).select("clip_id", "idx", F.round("amp", 4).alias("amp")),
        f"""with {SAMPLES}, u as (select *, sqrt(avg(amp * amp) over (partition by clip_id) + 1e-12) as rms, greatest(('0x' || substr(sha1('3|' || clip_id || '|' || idx || '|u'), 1, 12))::ubigint / 281474976710656.0::double, 1e-12) as a,
        ('0x' || substr(sha1('3|' || clip_id || '|' || idx || '|v'), 1, 12))::ubigint / 281474976710656.0::double as b from smp) select clip_id, idx, round(amp + rms / 10 * sqrt(-2 * ln(a)) * cos(2 * pi() * b), 4) as amp from u""",
    ),
    "d03_silence": (
        lambda s, d: D.silence(_samples(s, d), 0.25, 3).groupBy("clip_id").agg(F.sum((F.col("amp") == 0).cast("int")).alias("silent")),
        f"with {SAMPLES}, n as (select clip_id, count(*) as n, least(count(*), cast(round(count(*) * 0.25) as bigint)) as len, ('0x' || substr(sha1('3|' || clip_id), 1, 12))::ubigint / 281474976710656.0::double as u from smp group by 1) select smp.clip_id, cast(sum(case when amp = 0 or (idx >= floor(u * (n - len + 1)) and idx < floor(u * (n - len + 1)) + len) then 1 else 0 end) as bigint) as silent from smp join n using (clip_id) group by 1",
    ),
    "d04_score_space": (
        lambda s, d: D.perturb_scores(T.minmax(seg10(s, d)).select("clip_id", "t", "score"), 1, 1000.0, 0.3, 9).select("clip_id", "t", R6("score").alias("score")),
        f"""with {SEG}, x as (select clip_id, t, {MM} as s from seg window w as (partition by clip_id)), y as (select clip_id, t, coalesce(lag(s) over (partition by clip_id order by t), 0) as s from x)
        select clip_id, t, round(case when ('0x' || substr(sha1('9|mask|' || clip_id || '|' || t), 1, 12))::ubigint / 281474976710656.0::double >= 0.3 then s else 0 end, 6) as score from y""",
    ),
    "d05_forced_uniform": (
        lambda s, d: D.forced_uniform(seg10(s, d).select("clip_id").distinct(), 0.4, "force"),
        f"with {SEG} select clip_id, ('0x' || substr(sha1(clip_id || '|force'), 1, 12))::ubigint / 281474976710656.0::double < 0.4 as forced from (select distinct clip_id from seg)",
    ),
    "d06_window_hit": (
        lambda s, d: D.window_hit(_intervals(s, d).select("clip_id", "start_s", "end_s").where("start_s > 0.5"), seg10(s, d).select("clip_id").distinct().withColumn("at_s", (F.col("clip_id") % 10).cast("double"))),
        f"with {INTERVALS}, e as (select distinct clip_id, (clip_id % 10)::double as a from iv) select e.clip_id, coalesce(max(case when a between start_s and end_s then 1 else 0 end), 0) as hit from e left join iv on iv.clip_id = e.clip_id and start_s > 0.5 group by 1",
    ),
    "s01_annotations": (_annotations, "select c_mktsegment as label, cast(c_custkey as varchar) as clip_id, 'good' as quality, (c_custkey % 7)::double as start_s, (c_custkey % 7 + 2)::double as end_s from customer"),
    "s03_csv_header": (
        lambda s, d: _roundtrip(s, d, "csv", lambda p: table(s, d, "supplier").withColumn("s_name", F.when(F.col("s_suppkey") % 5 == 0, F.lit("  ")).otherwise(F.col("s_name"))).write.option("header", True).csv(p), lambda p: R.csv_rows(s, p, table(s, d, "supplier").schema, ["s_suppkey"])).select("s_suppkey", "s_name", "s_nationkey"),
        "select s_suppkey, case when s_suppkey % 5 = 0 then null else s_name end as s_name, s_nationkey from supplier",
    ),
    "s05_s08_jsonl_hash_order": (
        lambda s, d: _roundtrip(s, d, "jsonl", lambda p: R.materialize_json(table(s, d, "benchmark"), p), lambda p: R.jsonl_snapshot(s, p, table(s, d, "benchmark").schema, "item_id", seed=5, limit=15)).select("item_id"),
        "select item_id from benchmark order by sha1('5|' || item_id), item_id limit 15",
    ),
    "s05_json_array": (
        lambda s, d: _roundtrip(s, d, "json_array", lambda p: _json_arrays(table(s, d, "benchmark").select("item_id", "text")).write.partitionBy("part").text(p), lambda p: R.json_array(s, f"{p}/*", "item_id long, text string")),
        "select item_id, text from benchmark",
    ),
    "s11_predictions": (
        lambda s, d: _roundtrip(s, d, "pred", lambda p: table(s, d, "conversations").select(F.col("conv_id").alias("item"), F.when(F.col("role") != "system", F.col("role")).alias("method"), F.col("turn").alias("pos")).write.json(p), lambda p: R.predictions(s, p, "item long, method string, pos long", ["item"], "pos")),
        "select item, method, pos from (select conv_id as item, role as method, turn as pos, row_number() over (partition by conv_id, role order by turn desc) as r from conversations where role <> 'system') where r = 1",
    ),
    "s13_score_cache": (
        lambda s, d: _roundtrip(s, d, "cache", lambda p: R.write_scores(seg10(s, d), p), lambda p: R.fill_scores(R.score_cache(s, p).where("clip_id % 2 = 0"), seg10(s, d).select("clip_id", "t", "score"))).select("clip_id", "t", R6("score").alias("score")),
        f"with {SEG} select clip_id, t, round(score, 6) as score from seg",
    ),
    "s14_features_by_resolution": (
        lambda s, d: _roundtrip(s, d, "features", lambda p: seg10(s, d).select("clip_id", "t", "score", F.when(F.col("t") % 2 == 0, 224).otherwise(160).alias("resolution")).write.partitionBy("resolution").parquet(p), lambda p: R.features(s, p, 224)).select("clip_id", "t", "resolution"),
        f"with {SEG} select clip_id, t, 224 as resolution from seg where t % 2 = 0",
    ),
    "s18_largest_per_stem": (
        lambda s, d: R.largest_per_stem(table(s, d, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"), F.col("doc_id") % 20, F.lit(".txt")).alias("path"), F.col("n_chars").alias("length"))),
        "select stem, arg_max(path, struct_pack(l := length, p := path)) as path, max(length) as length from (select lang || '_' || (doc_id % 20) as stem, source || '/' || lang || '_' || (doc_id % 20) || '.txt' as path, n_chars as length from documents) group by 1",
    ),
    "s19_resume": (
        lambda s, d: R.remaining(table(s, d, "documents").select("doc_id", F.lit("m").alias("method")), table(s, d, "labels").select("doc_id", F.lit("m").alias("method")), ["doc_id", "method"], ["m"]).select("doc_id"),
        "select doc_id from documents where doc_id not in (select doc_id from labels)",
    ),
    "m04_segment_head": (_segment_head, None),
    "m06_multilabel_head": (lambda s, d: M.multilabel(M.pooled(_labelled(s, d)), _clip_labels(s, d)).join(_clip_labels(s, d).withColumn("hot", F.lit(1)), ["clip_id", "label"], "left").fillna(0, ["hot"]).select("clip_id", "label", "hot", "p"), None),
}
