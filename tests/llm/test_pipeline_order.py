"""The order of mixing reaches the packed sequences."""

import pytest
from pyspark.sql import functions as F

from kairolake.llm.common import materialize


@pytest.mark.parametrize("down", [False, True])
def test_packing_keeps_the_order(spark, docs, down):
    import corpus_pipeline

    order = F.xxhash64("doc_id")
    rows = docs.orderBy(order.desc() if down else order)
    place = {r["doc_id"]: i for i, r in enumerate(rows.select("doc_id").collect())}
    out = corpus_pipeline.packing(spark, materialize(rows, "ordered"), None).collect()
    assert {r["doc_id"] for r in out} == set(place)
    sequences = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        sequences.setdefault(r["sequence_id"], []).append((place[r["doc_id"]], r["piece"]))
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(s == sorted(s) for s in sequences.values())
    firsts = [s[0] for s in sequences.values()]
    assert firsts == sorted(firsts)
    tokens = sum(r["length"] for r in out)
    assert len(sequences) <= -(-tokens // 4096) + 2


def test_packing_of_rows_without_files(spark):
    import corpus_pipeline

    rows = [(i, f"some words {i} " * 700, "en", "s", 1) for i in range(40, 0, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.packing(spark, docs, None).collect()
    first = {r["sequence_id"]: r["doc_id"] for r in out if r["offset"] == 0}
    assert first[0] == 40 and [first[i] for i in range(len(first))] == sorted(first.values(), reverse=True)


def test_blocks_are_neighbours(spark, docs):
    """With small blocks a sequence that is full at once comes from one run of the order."""
    from kairolake.llm.packing import PackConfig, pack
    from kairolake.llm.tokens import public_tokenizer

    rows = materialize(docs.orderBy("doc_id"), "ordered")
    out = pack(rows, public_tokenizer(), PackConfig(block=16, slack=64), order=(F.lit(0), F.col("doc_id"))).toPandas()
    spans = out.groupby("sequence_id")["doc_id"].agg(lambda x: x.max() - x.min())
    hashed = pack(rows, public_tokenizer(), PackConfig(block=16, slack=64)).toPandas().groupby("sequence_id")["doc_id"].agg(lambda x: x.max() - x.min())
    assert spans.median() < hashed.median() / 2
