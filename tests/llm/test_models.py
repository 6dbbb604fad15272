"""Language ID, toxicity and nearest neighbours: held-out quality, brute force, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from kairolake.llm import ann, langid, toxicity


def test_language_id_held_out(spark, docs, edge, empty):
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out()).toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.9
    named = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(edge, model).collect()}
    assert named[4] == named[5] == named[6] == ("und", 0.0) and named[7][0] == "de" and len(named) == 7
    assert langid.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_language_id_memory_on_many_words():
    import tracemalloc

    import pyarrow as pa

    cfg = langid.LangIdConfig()
    rng = np.random.default_rng(1)
    model = langid.LangIdModel(["de", "en"], [("germanic", "de", "en")], rng.normal(size=(1, cfg.dims + 1)), np.ones(1))
    texts = pa.array([" ".join("".join(map(chr, rng.integers(97, 123, 8))) for _ in range(1000)) for _ in range(100)])
    tracemalloc.start()
    langid.classify(texts, model, cfg)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * sum(map(len, texts.to_pylist()))  # n-grams of all 100,000 words at once: over 150


def test_toxicity(spark, docs, edge, empty):
    calm = [(i, f"the weather is mild today and word{i % 17} follows plain talk number {i}") for i in range(400)]
    rude = [(1000 + i, f"the weather is mild today you {'idiot moron scum'.split()[i % 3]} word{i % 17} {'clown loser'.split()[i % 2]} number {i}") for i in range(200)]
    rows = spark.createDataFrame(calm + rude, "doc_id long, text string")
    labels = rows.select("doc_id", (F.col("doc_id") >= 1000).cast("int").alias("toxic"))
    got = toxicity.fit_and_score(rows, labels, ~toxicity.held_out()).where(toxicity.held_out()).toPandas()
    assert ((got["doc_id"] >= 1000) == (got["predicted"] == 1)).mean() > 0.97
    assert got["score"].between(0, 1).all()
    out = toxicity.fit_and_score(edge, labels.withColumn("text", F.lit("clash")), F.lit(True)).collect()
    assert len(out) == edge.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in toxicity.fit_and_score(edge, labels.where("toxic = 0"), F.lit(True)).collect()} == {0.0}
    assert toxicity.fit_and_score(empty, labels, F.lit(True)).count() == 0


def test_toxicity_joined_and_broadcast_agree(spark, docs, edge):
    labels = docs.select("doc_id", F.when(F.col("text").contains("1"), 1).otherwise(0).alias("toxic"))
    rows = docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    score = lambda cfg: toxicity.fit_and_score(rows, labels, ~toxicity.held_out(), cfg).toPandas().groupby("doc_id", dropna=False)["score"].mean()
    shipped, joined = score(toxicity.ToxicityConfig()), score(toxicity.ToxicityConfig(broadcast_rows=0))
    np.testing.assert_allclose(shipped.to_numpy(), joined.loc[shipped.index].to_numpy(), atol=1e-9)


def kneser_ney_counts(spark, rows, cfg):
    """Counts by order and n-gram key."""
    counts = toxicity.kneser_ney_counts(toxicity.ngrams(spark.createDataFrame(rows, "text string, toxic int"), cfg), cfg).collect()
    assert len({(r["n"], r["gram"]) for r in counts}) == len(counts)
    return {(r["n"], r["gram"]): (r["ordinary"], r["toxic"]) for r in counts}


def gram_key(gram, order, starts):
    """The key of an n-gram, spelled as the end of a word or as its start."""
    word = gram if starts else "..." + gram
    _, place, keys = toxicity._spelled([word], order)
    return int(keys[order][1][place == len(word)].view(np.int64)[0])


def test_toxicity_counts_against_loops(spark):
    """Order 3 counts documents of a class, orders 1 and 2 count preceding characters in all documents."""
    texts = [("ab ab ac", 0), ("Ab", 1), ("ac!", 1), ("bab", None), ("zzab", None)]
    got = kneser_ney_counts(spark, texts, toxicity.ToxicityConfig(order=3, shared_order=2))
    at = lambda gram, starts=False: got.get((len(gram) + starts, gram_key(gram, len(gram) + starts, starts)), (0, 0))
    assert at("ab", True) == (1, 1) and at("ac", True) == (1, 1)
    assert at("a", True) == (4, 4) and at("z", True) == (1, 1) and at("b", True) == (1, 1)
    assert at("ab") == (3, 3)  # behind the bound, b and z
    assert at("a") == (3, 3) and at("b") == (2, 2) and at("c") == (1, 1) and at("z") == (2, 2)


def test_toxicity_backs_off_to_contexts_not_to_counts(spark):
    """q is frequent but only ever met behind f; k is rare and met behind five letters. Plain counts would put q first
    in an unseen context, continuation counts put k first."""
    rows = [("fq", i % 2) for i in range(60)] + [(f"{c}k", i % 2) for i, c in enumerate("abcde")]
    got = kneser_ney_counts(spark, rows, toxicity.ToxicityConfig(order=3, shared_order=1))
    q, k = (got[1, gram_key(c, 1, False)] for c in "qk")
    assert q == (1, 1) and k == (5, 5)
    # in the classes' own order 2 each class counts what it has met itself
    assert got[2, gram_key("f", 2, True)] == (30, 30) and got[2, gram_key("fq", 2, False)] == (1, 1)
    assert got[2, gram_key("ak", 2, False)] == (1, 0) and got[3, gram_key("fq", 3, True)] == (30, 30)


def test_toxicity_without_calibration_rows(spark):
    """Ten short texts, one of them labelled toxic: no curve can be fitted, and the scores still differ."""
    rows = spark.createDataFrame([(i, "you idiot idiot" if i % 5 == 0 else f"mild weather today {i}") for i in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    for seed in range(3):
        got = toxicity.fit_and_score(rows, labels, F.lit(True), toxicity.ToxicityConfig(seed=seed)).toPandas()
        assert got["predicted"].nunique() == 2 or got["score"].nunique() > 1 or (got["score"] == 0.5).all()
    fold = F.pmod(F.xxhash64(F.lit(6), F.col("doc_id")), F.lit(5))
    learnt = rows.where(fold > 0).orderBy("doc_id").limit(8).select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic")).collect()
    if len({r["toxic"] for r in learnt}) == 2:
        got = toxicity.fit_and_score(rows, spark.createDataFrame(learnt, "doc_id long, toxic int"), F.lit(True)).toPandas()
        assert set(got.loc[got["predicted"] == 1, "doc_id"]) == {0, 5}


def brute(x, ids, queries, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = np.round(unit @ unit[ids == q][0], 12)
        s[ids == q] = -np.inf
        out[q] = set(ids[np.lexsort((ids, -s))[:k]])
    return out


def recall_and_share(rows, x, ids, cfg):
    index, asked = ann.build_index(rows, cfg), F.col("vec_id") % 50 == 0
    got = ann.search(index, asked).toPandas()
    want = brute(x, ids, ids[ids % 50 == 0])
    found = got.groupby("query_id")["vec_id"].apply(set)
    assert (got.groupby("query_id")["rank"].max() == 5).all()
    return sum(len(want[q] & found[q]) for q in want) / (5 * len(want)), ann.scanned_share(index, asked)


def test_nearest_recall_where_vectors_cluster(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((60, 16))
    x = centres[rng.integers(0, 60, 4000)] + 0.2 * rng.standard_normal((4000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    recall, share = recall_and_share(rows, x, np.arange(4000), ann.AnnConfig(sample=2000, block=500))
    assert recall >= 0.9 and share < 0.25


def test_nearest_recall_on_the_table(spark):
    """The table's vectors have no structure (flat spectrum), so that most of it has to be scanned."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = rows.toPandas()
    fine = table[[v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v) for v in table["embedding"]]]
    recall, share = recall_and_share(rows, np.stack(fine["embedding"]).astype(float), fine["vec_id"].to_numpy(), ann.AnnConfig())
    print(recall, share)
    assert recall >= 0.9 and share < 1


def test_nearest_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, part int, norm string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert ann.nearest(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_identified_keeps_rows_whole(spark):
    fitted = [(i, t, g) for i, (t, g) in enumerate([("the quick brown fox and the dog", "en"), ("der schnelle braune fuchs und der hund", "de")] * 20)]
    model = langid.fit(spark.createDataFrame(fitted, "doc_id long, text string, lang string"))
    schema = "doc_id long, text string, lang string, lang_pred string"
    rows = [(None, "the brown dog", None, "x"), (1, None, "en", "y"), (2, "123 456", "en", "z"), (3, "the fox", "en", "q"), (3, "the fox", "en", "q"), (4, "", "de", "q"), (5, "hund " * 300_000, None, None)]
    docs = spark.createDataFrame(rows, schema)
    out = langid.identified(docs, model)
    assert out.schema == docs.schema
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert langid.identified(docs.where("false"), model).count() == 0
