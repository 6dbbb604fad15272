"""Token files, packing, sharding and mixing: round trips and invariants."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairolake.llm import mixing, packing, sharding, token_output, tokens
from kairolake.llm.common import scratch


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_token_files(spark, request, plain, which):
    df = request.getfixturevalue(which)
    folder = scratch(spark, "t")
    token_output.write_tokens(df, folder, tokens.public_tokenizer(), parts=3)
    got = sorted(tuple(r) for r in token_output.read_tokens(spark, folder).collect())
    want, start = [], 0
    for r in sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0], r[1] or "")):
        ids = plain(r["text"])
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_encoder_odd_words(plain):
    import pyarrow as pa

    odd = ["It's <|endoftext|> don't! A.B,c... <|ENDOFTEXT|>", "́x é.,;   日本語、é. İstanbul Σς", "a\tb\x0bc\x0c", "'s 't ''s,, x's.", "x<|startoftext|>y."]
    offsets, flat = tokens.Encoder(tokens.public_tokenizer())(pa.array(odd))
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [plain(t) for t in odd]


def test_empty_token_files(spark, empty):
    folder = scratch(spark, "t")
    token_output.write_tokens(empty, folder, tokens.public_tokenizer(), parts=2)
    assert token_output.read_tokens(spark, folder).count() == 0


@pytest.mark.parametrize("which", ["docs", "edge"])
@pytest.mark.parametrize("block", [2048, 32])
def test_packing(request, plain, which, block):
    df = request.getfixturevalue(which)
    out = packing.pack(df, tokens.public_tokenizer(), packing.PackConfig(block=block)).toPandas()
    bins = out.groupby("sequence_id")["length"].sum()
    assert bins.max() <= 4096
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = plain(r["text"])
        want += [(r["doc_id"], i, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for i, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    assert len(bins) <= 1.03 * -(-out["length"].sum() // 4096) + 1


def test_packing_empty(empty):
    assert packing.pack(empty, tokens.public_tokenizer()).count() == 0


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_sharding(request, which, monkeypatch):
    df = request.getfixturevalue(which)
    monkeypatch.setattr(sharding, "WINDOW_ROWS", 7)  # every key is narrowed
    out = sharding.kd_shards(df).toPandas()
    assert len(out) == df.count() and out["shard"].between(0, 15).all()
    for _, slots in out.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    if which == "docs":
        sizes = out.groupby("shard")["size"].sum().reindex(range(16), fill_value=0)
        assert sizes.max() - sizes.min() <= 2 * out["size"].max()
    texts = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).toPandas().drop_duplicates("doc_id").set_index("doc_id")["t"]
    assert all(s == len(texts[i].encode()) + 1 and c == zlib.crc32(texts[i].encode()) for i, s, c in zip(out["doc_id"], out["size"], out["text_crc32"], strict=True))


def test_sharding_empty(empty):
    assert sharding.kd_shards(empty).count() == 0


def test_frame_is_pfair():
    quotas = {"a": 7, "b": 3, "c": 1, "d": 12}
    total, done = sum(quotas.values()), dict.fromkeys(quotas, 0)
    for s, j, release, deadline, slot in mixing.frame_schedule(quotas):
        assert release <= slot < deadline and j == done[s]
        done[s] += 1
        assert all(abs(done[x] - quotas[x] * (slot + 1) / total) < 1 for x in quotas)
    assert done == quotas


@pytest.mark.parametrize("frame", [1 << 16, 64])
def test_mixing(docs, edge, empty, frame):
    cfg = mixing.MixConfig(block_bytes=2048, frame=frame)
    weights = {f"src{i}": (4.0 if i == 0 else 1.0) for i in range(20)}
    out = mixing.mix(docs, weights, cfg).toPandas()
    assert sorted(out["doc_id"]) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert ((out["slot"] >= out["release"]) & (out["slot"] < out["deadline"])).all()
    assert out.drop_duplicates(["source", "block"]).groupby("phase")["slot"].apply(lambda s: s.is_unique).all()
    assert len(mixing.mix(edge, cfg=cfg).collect()) == edge.count() and mixing.mix(empty).count() == 0


def test_natural_weights():
    w = mixing.natural_weights({"hot": 60, "a": 20, "b": 20, "c": 20, "d": 20}, 0.25)
    assert abs(w["hot"] - 0.25) < 1e-9 and abs(sum(w.values()) - 1) < 1e-9
    assert mixing.quotas_of({"a": 10, "b": 10}, mixing.natural_weights({"a": 10, "b": 10}, 0.25)) == {"a": 10, "b": 10}


def test_sharding_dense_lengths(spark, monkeypatch):
    """Many lengths in one bin, stretched by one long document: each cut is still right to half a document."""
    monkeypatch.setattr(sharding, "WINDOW_ROWS", 7)
    rows = [(i, "x" * (2000 + i % 4), "s", "l") for i in range(400)] + [(400, "y" * 4_000_000, "s", "l")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    monkeypatch.setattr(sharding, "BINS", 8)  # stands for the 4,096 bins of far more rows
    meta = sharding._metadata(frame, "text", "doc_id", "source", "lang").withColumn("node", F.lit(1).cast("long"))
    for share in (0.05, 0.08, 0.14):
        plan = sharding._plan(meta, {1: share})
        below = sharding._descend(meta, sharding._places(meta, plan)).where("node = 2").agg(F.sum("size")).first()[0]
        assert abs(below - plan[0][5]) <= 1002


def test_sharding_single_dense_half(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WINDOW_ROWS", 7)
    monkeypatch.setattr(sharding, "BINS", 8)
    frame = spark.createDataFrame([(i, "x" * (2000 + i % 7) + str(i).zfill(4)) for i in range(800)] + [(800, "z")], "doc_id long, text string")
    sizes = sharding.kd_shards(frame, 2).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    assert len(sizes) == 2 and abs(sizes.iloc[0] - sizes.iloc[1]) <= 2012


def test_mixing_keeps_to_given_weights(spark):
    """Over the whole mix, many times longer than ``frame``, each source is less than one block from its weight."""
    rng = np.random.default_rng(5)
    weights = {f"s{i}": float(w) for i, w in enumerate(rng.dirichlet(np.ones(12)) * 0.6)} | {"hot": 0.4}
    counts = {s: int(w * 3000) + 3 for s, w in weights.items()}
    rows = [(i, s, "x" * 7) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights, mixing.MixConfig(block_bytes=8, frame=64)).toPandas()
    assert sorted(out["doc_id"]) == list(range(len(rows)))
    first = out[out["phase"] == 0].sort_values("slot")
    assert first["slot"].tolist() == list(range(len(first))) and len(first) >= 2900
    total = sum(weights.values())
    for s, w in weights.items():
        assert np.abs((first["source"] == s).cumsum().to_numpy() - w / total * np.arange(1, len(first) + 1)).max() < 1 + 1e-6


def test_few_sources_keep_natural_shares():
    for shares in ({"a": 50, "b": 40, "c": 10}, {"a": 9, "b": 1}):
        assert mixing.quotas_of(shares, mixing.natural_weights(shares, 0.25)) == shares
