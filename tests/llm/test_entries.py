"""Every registered query of the subpackage, called as the driver calls it, against plain Python over the whole table."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kairolake.llm import ann, langid, mixing, near_dedup, sharding, tokens, toxicity
from tests.llm.test_dedup import brute_components
from tests.llm.test_models import brute

TEXTS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def query(spark, sf_dir):
    known = __spark_entry__.queries()
    return lambda n: known[next(k for k in known if k.startswith(f"op{n}_"))](spark, sf_dir)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_tokenizer())
    return {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in texts.items()}


@pytest.fixture(scope="module")
def nameless(spark):
    """Rows without an id: one alone, one equal to a row with an id, two equal to one another; and a null text."""
    rows = [(None, "one two three four five six seven eight", "en", "a"), (1, "nine ten eleven twelve thirteen fourteen", "en", "a"), (None, "nine ten eleven twelve thirteen fourteen", None, None), (None, "twice the same line of words\nand more", "en", "b"), (None, "twice the same line of words\nand more", "en", "b"), (None, None, None, None), (2, "another text of some words in a row", "en", "b")]
    return spark.createDataFrame(rows, TEXTS)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(query, texts):
    want = brute_components(list(texts.items()), 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in query(1).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_op2(query, ids_of):
    start, want = 0, {}
    for d in sorted(ids_of):
        want[d] = (start, len(ids_of[d]), crc(ids_of[d]))
        start += len(ids_of[d])
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in query(2).collect()} == want


@pytest.mark.parametrize("n", [3, 9])
def test_sql(query, sf_dir, n):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df = query(n)
    sql = next(v for k, v in __spark_entry__.oracle_sql().items() if k.startswith(f"op{n}_"))
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(map(tuple, con.execute(f"select {', '.join(sorted(df.columns))} from ({sql})").fetchall()))


def test_op4(query, texts):
    out = query(4).toPandas().set_index("doc_id")
    assert sorted(out.index) == sorted(texts) and out["law"].eq("bytes").all() and out["grown_shard"].isna().all()
    assert all(out.loc[d, "size"] == len((t or "").encode()) + 1 and out.loc[d, "text_crc32"] == zlib.crc32((t or "").encode()) for d, t in texts.items())
    sizes = out.groupby("shard")["size"].agg(["sum", "count"])
    assert len(sizes) == 16 and all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])
    assert sizes["sum"].max() - sizes["sum"].min() <= 2 * out["size"].max()


def kd_by_hand(rows, shards):
    """The tree by plain sorting: rows of (d0, d1, d2, h, k, id, size), each node cut at half its bytes."""
    leaves = [(rows, shards)]
    while any(n > 1 for _, n in leaves):
        fresh = []
        for mine, n in leaves:
            if n == 1:
                fresh.append((mine, 1))
                continue
            dim = max(range(3), key=lambda i: max(r[i] for r in mine) - min(r[i] for r in mine))
            mine = sorted(mine, key=lambda r: (r[dim], *r[3:6]))
            whole, want, at = sum(r[6] for r in mine), sum(r[6] for r in mine) * (n // 2) / n, 0
            sums = np.cumsum([r[6] for r in mine])
            i = int(np.searchsorted(sums, want, "right"))
            group = [j for j, r in enumerate(mine) if (r[dim], r[3]) == (mine[i][dim], mine[i][3])]
            size = sum(mine[j][6] for j in group)
            if size <= whole * sharding.SNAP:
                at = group[-1] + 1 if sums[group[-1]] - want <= want - (sums[group[-1]] - size) else group[0]
            else:
                at = i + 1 if sums[i] - mine[i][6] / 2 < want else i
            fresh += [(mine[:at], n // 2), (mine[at:], n - n // 2)]
        leaves = fresh
    return [{r[5] for r in mine} for mine, _ in leaves]


def test_sharding_against_plain_sorting(docs):
    meta = sharding._agreed(sharding._metadata(docs, "text", "doc_id", "source", "lang").withColumn("node", F.lit(1))).toPandas()
    want = kd_by_hand([tuple(r) for r in meta[["d0", "d1", "d2", "h", "k", "id", "size"]].to_numpy().tolist()], 16)
    got = sharding.kd_shards(docs).toPandas().groupby("shard")["doc_id"].apply(lambda s: {float(x) for x in s})
    assert [got.get(i, set()) for i in range(16)] == want


def test_sharding_keeps_small_groups_whole(spark):
    """Equal texts of other sources and languages: only groups above a hundredth of a node may be cut."""
    rng = np.random.default_rng(1)
    rows = [(i, f"text number {g} " + "w " * int(20 + g % 40), "en de fr".split()[int(rng.integers(3))], f"s{int(rng.integers(5))}") for i, g in enumerate(rng.integers(0, 1500, 4000).tolist())]
    out = sharding.kd_shards(spark.createDataFrame(rows, TEXTS)).toPandas()
    shards = out.groupby(["text_crc32", "size"])["shard"].nunique()
    assert shards.max() == 1 and len(shards) > 1000
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() / sizes.min() < 1.06


def test_op5(query, ids_of):
    out = query(5).toPandas()
    want = {(d, i): (i * 4096, len(ids[i * 4096 : i * 4096 + 4096]), crc(ids[i * 4096 : i * 4096 + 4096])) for d, ids in ids_of.items() for i in range(-(-len(ids) // 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()} == want
    for _, rows in out.sort_values("offset").groupby("sequence_id"):
        assert rows["length"].sum() <= 4096 and rows["offset"].tolist() == [0, *np.cumsum(rows["length"])[:-1]]
    least = -(-sum(map(len, ids_of.values())) // 4096)
    assert out["sequence_id"].nunique() <= least + 1


def edf_by_hand(blocks, weights, slots):
    """At each slot the released block of the earliest deadline, found by looking at every source."""
    total, at, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for slot in range(slots):
        ready = [(-(-(at[s] + 1) * total // w), s) for s, w in weights.items() if at[s] < blocks[s] and at[s] * total // w <= slot]
        _, s = min(ready)
        out.append((s, at[s]))
        at[s] += 1
    return out


def test_op6(query, docs):
    out = query(6).toPandas()
    assert sorted(out["doc_id"]) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    cut = out.drop_duplicates(["source", "block"])
    blocks = cut.groupby("source")["block"].agg(lambda b: int(b.max()) + 1).to_dict()
    weights = mixing.natural_weights(blocks, 0.25)
    quotas = mixing.quotas_of(blocks, weights)
    whole = mixing.whole_weights({s: weights[s] for s in quotas})
    want = {b: slot for slot, b in enumerate(edf_by_hand(blocks, whole, sum(quotas.values())))}
    mine = cut[cut["phase"] == 0]
    assert all(want[r.source, r.block] == r.slot for r in mine.itertuples())
    assert ((out["slot"] >= out["release"]) & (out["slot"] < out["deadline"])).all()


def test_mixing_blocks_stay_few(spark):
    rows = spark.createDataFrame([(i, "x" * 99, None, f"s{i % 3}") for i in range(300)], TEXTS)
    out = mixing.mix(rows, cfg=mixing.MixConfig(block_bytes=100, most_blocks=30)).toPandas()
    assert out.drop_duplicates(["source", "block"]).shape[0] <= 33 and len(out) == 300


def test_op7(query, spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    fine = table[[v is not None and np.isfinite(np.asarray(v, float)).all() and np.any(v) for v in table["embedding"]]]
    x, ids = np.stack(fine["embedding"]).astype(float), fine["vec_id"].to_numpy()
    got = query(7).toPandas().sort_values(["query_id", "rank"])
    want = brute(x, ids, ids[ids % 50 == 0])
    assert sum(len(want[q] & set(g["vec_id"])) for q, g in got.groupby("query_id")) >= 0.9 * 5 * len(want) and set(got["query_id"]) == set(want)
    at = {i: k for k, i in enumerate(ids)}
    for r in got.itertuples():
        a, b = x[at[r.query_id]], x[at[r.vec_id]]
        assert abs(r.score - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12
    assert all(g["rank"].tolist() == list(range(1, len(g) + 1)) and g["score"].is_monotonic_decreasing for _, g in got.groupby("query_id"))


def test_op8(query, texts):
    out = query(8).toPandas()
    assert sorted(out["doc_id"]) == sorted(texts) and out["score"].between(0, 1).all()
    assert ((out["score"] >= 0.5) == (out["predicted"] == 1)).all() and all(h == (fold(d, 5) == 0) for d, h in zip(out["doc_id"], out["held_out"], strict=True))


def test_op10(query, texts, docs):
    out = query(10).toPandas().set_index("doc_id")
    langs = {r["lang"] for r in docs.select("lang").collect()}
    assert sorted(out.index) == sorted(texts) and out["score"].between(0, 1).all() and set(out["lang_pred"]) <= langs | {"und"}
    assert all(out.loc[d, "held_out"] == (fold(d, 3) == 1) and (out.loc[d, "lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) for d, t in texts.items())


def test_language_votes_by_hand(docs):
    """The tasks' answers against margins of whole feature vectors and votes counted pair by pair."""
    import pyarrow as pa

    cfg, model = langid.LangIdConfig(sample_docs=400), langid.fit(docs.where(~langid.held_out()), langid.LangIdConfig(sample_docs=400))
    rows = [r for r in docs.select("doc_id", "text").collect() if any(c.isalpha() for c in r["text"] or "")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model, cfg).collect()}
    family = lambda c: langid.FAMILY_OF.get(c, c)
    for r, (dims, values) in zip(rows, langid.features(pa.array([r["text"] for r in rows]), cfg), strict=True):
        chance = {p: 1 / (1 + np.exp(-(values @ w[dims]) * s)) for p, w, s in zip(model.pairs, model.weights, model.slopes, strict=True)}

        def winner(level, names, chance=chance):
            score = dict.fromkeys(names, 0.0)
            for (at, a, b), p in chance.items():
                if at == level:
                    score[a] += (p >= 0.5) + p / len(names)
                    score[b] += (p < 0.5) + (1 - p) / len(names)
            return max(sorted(names), key=lambda n: score[n])

        top = winner("", {family(c) for c in model.languages})
        assert got[r["doc_id"]] == winner(top, {c for c in model.languages if family(c) == top})


def test_kneser_ney_by_hand(spark):
    """The models' ratios against the recursion on dictionaries of strings."""
    rows = [("good day good people", 0), ("good morning", 0), ("bad bald badger", 1), ("bad day", 1), ("some other words", None)]
    cfg = toxicity.ToxicityConfig(order=4, shared_order=2)
    counts = toxicity.kneser_ney_counts(toxicity.ngrams(spark.createDataFrame(rows, "text string, toxic int"), cfg), cfg)
    model = toxicity.KneserNey.load(counts, toxicity.context_sums(counts), cfg)
    held, before = {}, {}  # by class and n-gram: documents with it, characters in front of it
    for text, toxic in rows:
        for word in set(text.split()):
            s = f"<{word}>"
            for c in (0, 1):
                for n in range(1, 5):
                    for i in range(max(1, n - 1), len(s)):
                        gram = s[i - n + 1 : i + 1]
                        if n <= 2 or toxic == c:
                            held[c, gram] = held.get((c, gram), 0) + 1
                            if i >= n:
                                before.setdefault((c, gram), set()).add(s[i - n])

    def count(c, gram):
        return held.get((c, gram), 0) if len(gram) == 4 or gram[0] == "<" else len(before.get((c, gram), ()))

    def chance(c, s, i):
        p = 1e-5
        for n in range(1, min(4, i + 1) + 1):
            gram = s[i - n + 1 : i + 1]
            after = [k for d, g in held if d == c and len(g) == n and g[:-1] == gram[:-1] and (k := count(c, g))]
            if after:
                p = (max(count(c, gram) - 0.75, 0) + 0.75 * len(after) * p) / sum(after)
        return p

    words = ["bad", "good", "badly", "zebra", "day"]
    want = [np.mean([np.log(chance(1, f"<{w}>", i)) - np.log(chance(0, f"<{w}>", i)) for i in range(1, len(w) + 2)]) for w in words]
    np.testing.assert_allclose(model.ratios(words), want, atol=1e-5)
    assert want[0] > 0 > want[1]


def test_pipeline_run(spark, sf_dir, docs):
    out = __spark_entry__.queries()["pipeline"](spark, sf_dir).toPandas()
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    letters = {r["doc_id"] for r in docs.where("text rlike '\\\\p{L}'").select("doc_id").collect()}
    assert set(out["doc_id"]) <= letters and len(set(out["doc_id"])) > 0.5 * len(letters)
    assert out.groupby("sequence_id")["length"].sum().max() <= 4096


def test_rows_without_an_id(spark, nameless):
    n = nameless.count()
    near = near_dedup.near_duplicates(nameless, near_dedup.NearDedupConfig(shingle=3)).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near), key=repr) == sorted([(None, None, True)] * 4 + [(1, 1, True), (None, 1, False), (2, 2, True)], key=repr)
    assert len(sharding.kd_shards(nameless, 2).collect()) == n and mixing.mix(nameless).count() == n
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit_and_score(nameless, labels, F.lit(True)).where("score between 0 and 1").count() == n
    model = langid.fit(nameless.where("doc_id is not null"))
    assert langid.predict(nameless, model).count() == n
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(vectors, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]
