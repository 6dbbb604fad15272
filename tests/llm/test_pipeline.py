"""Stages of the corpus pipeline, each on what the one before kept."""

import pytest

from kairolake.llm.common import materialize
from kairolake.llm.mixing import mix
from tests.llm.test_dedup import brute_components, brute_lines


def test_stages(spark, docs, sf_dir):
    import hashlib

    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    named = materialize(stages["language_id"](spark, docs, sf_dir), "named")
    assert named.columns == docs.columns and named.count() == docs.where("text rlike '\\\\p{L}'").count()
    lines = materialize(stages["line_dedup"](spark, named, sf_dir), "lines")
    assert lines.columns == docs.columns and lines.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    want = {i: h for i, _, _, h in brute_lines([tuple(r) for r in named.select("doc_id", "text").collect()])}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in lines.collect()} == want
    near = materialize(stages["near_dedup"](spark, lines, sf_dir), "near")
    roots = brute_components([tuple(r) for r in lines.select("doc_id", "text").collect()], 5, 80)
    assert sorted(r["doc_id"] for r in near.select("doc_id").collect()) == sorted(i for i, (_, c) in roots.items() if c == i)
    mixed = materialize(stages["mixing"](spark, near, sf_dir), "mixed")
    assert mixed.columns == docs.columns and 0 < mixed.count() <= near.count()
    packed = stages["packing"](spark, mixed, sf_dir)
    assert packed.select("doc_id").distinct().count() == mixed.count()


@pytest.mark.parametrize("counts", [(27, 3), (20, 16, 4), (16, 12, 8, 4), (12, 4, 4, 4, 4, 4, 4)])
def test_mixing_keeps_every_document(spark, counts):
    """Whatever the shares of the sources: the mix comes first, the reserve behind it."""
    import corpus_pipeline

    rows = [(i, "x" * 65535, "en", f"s{s}", 65535) for i, s in enumerate(s for s, n in enumerate(counts) for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = materialize(corpus_pipeline.mixing(spark, docs, None), "mixed")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows
    at = {r["doc_id"]: (r["phase"], r["slot"]) for r in mix(docs).collect()}
    places = [at[r["doc_id"]] for r in corpus_pipeline.mixing(spark, docs, None).collect()]
    assert places == sorted(places)
