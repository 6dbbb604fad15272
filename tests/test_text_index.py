"""The inverted index against plain Python, whole and in segments, and against one-off relevance."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairolake.operators import text as X
from kairolake.operators import text_index as I

WORDS = ["the", "of", "Dog", "cat", "x1", "über", "42", "tree", "house", "rare", "İx"]


def corpus(rng, first, n):
    p = np.array([8, 5, 3, 2, 2, 1, 1, 1, 1, 0.3, 0.2])
    texts = [" ".join(rng.choice(WORDS, int(rng.integers(0, 30)), p=p / p.sum())) for _ in range(n)]
    return [(["a", "a", "a", "b"][i % 4], first + i, None if i == 7 else t + ["", "--", "\n,"][i % 3]) for i, t in enumerate(texts)]


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def bm25(rows, query, k1=1.5, b=0.75, floor=0.25):
    out = {}
    for g in {r[0] for r in rows}:
        docs = {d: Counter(tokens(t)) for q, d, t in rows if q == g}
        n, mean = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
        df = Counter(w for c in docs.values() for w in c)
        idf = {w: math.log(n - v + 0.5) - math.log(v + 0.5) for w, v in df.items()}
        average = sum(idf.values()) / len(idf) if idf else 0
        idf = {w: floor * average if v < 0 else v for w, v in idf.items()}
        for d, c in docs.items():
            dl = sum(c.values())
            out[d] = sum(idf.get(w, 0) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * dl / mean)) for w in tokens(query.get(g)) if c[w])
    return out


def tfidf(rows, query):
    out = {}
    for g in {r[0] for r in rows}:
        docs = {d: Counter(tokens(t)) for q, d, t in rows if q == g}
        asked = Counter(tokens(query[g])) if g in query else None
        n = len(docs) + 1
        df = Counter(w for c in [*docs.values(), asked or {}] for w in c)
        weigh = lambda c: {w: v * (math.log((1 + n) / (1 + df[w])) + 1) for w, v in c.items()}  # noqa: E731,B023
        size = lambda c: math.sqrt(sum(v * v for v in c.values()))
        q = weigh(asked or {})
        for d, c in docs.items():
            c = weigh(c)
            out[d] = sum(v * q.get(w, 0) for w, v in c.items()) / (size(c) * size(q)) if size(c) * size(q) else 0
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    return corpus(rng, 0, 60) + [("empty", 900, "--"), ("empty", 901, None)], corpus(rng, 100, 30)


QUERY = {"a": "the the dog rare unseen", "b": "", "c": "nobody"}


def frames(spark, *parts):
    return [spark.createDataFrame(p, "grp string, doc long, text string") for p in parts], spark.createDataFrame(list(QUERY.items()), "grp string, text string")


def scores(df):
    return {r["doc"]: r["score"] for r in df.collect()}


@pytest.mark.parametrize("named", [1000, 1])
def test_index_in_segments(spark, tmp_path, rows, named, monkeypatch):
    """An appended index answers as one over all documents; also where the query's terms are too many to be named."""
    monkeypatch.setattr(I, "NAMED_TERMS", named)
    (first, second), query = frames(spark, *rows)
    index = I.TextIndex.build(first, f"file://{tmp_path}/index")
    assert scores(index.bm25(query)) == pytest.approx(bm25(rows[0], QUERY)) and scores(index.tfidf(query)) == pytest.approx(tfidf(rows[0], QUERY))
    index.append(second)
    whole = [*rows[0], *rows[1]]
    assert scores(index.bm25(query)) == pytest.approx(bm25(whole, QUERY))
    moments = index.refresh()
    assert scores(index.tfidf(query, moments)) == pytest.approx(tfidf(whole, QUERY))
    again = I.TextIndex(spark, f"file://{tmp_path}/index", 2)  # opened anew
    assert scores(again.tfidf(query)) == pytest.approx(tfidf(whole, QUERY))


def test_one_off_relevance(spark, rows, monkeypatch):
    (docs,), query = frames(spark, [*rows[0], *rows[1]])
    monkeypatch.setattr(I, "BROADCAST_TERMS", 2)  # terms are joined instead of broadcast
    assert scores(X.bm25_relevance(docs, query)) == pytest.approx(bm25([*rows[0], *rows[1]], QUERY))
    assert scores(X.tfidf_relevance(docs, query)) == pytest.approx(tfidf([*rows[0], *rows[1]], QUERY))


def test_only_the_querys_postings_are_read(spark, tmp_path, rows):
    (first,), query = frames(spark, rows[0])
    index = I.TextIndex.build(first, f"file://{tmp_path}/index")
    plan = index.postings(I.query_terms(query))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*In\(term", plan)


def test_counts_and_hot_terms(spark, tmp_path):
    docs = spark.range(3000).select(F.lit("g").alias("grp"), F.col("id").alias("doc"), F.lit("hot hot Cold").alias("text"))
    got = I.document_terms(docs).select("dl", F.inline("terms")).distinct().collect()
    assert sorted(map(tuple, got)) == [(3, "cold", 1), (3, "hot", 2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows together
    try:
        I.TextIndex.build(docs, f"file://{tmp_path}/index")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(f"file://{tmp_path}/index/postings").groupBy(F.input_file_name()).count().collect()
    assert len(files) == 4 and max(r["count"] for r in files) < 3000  # two terms lie in four files
    assert I.document_terms(docs.limit(0)).count() == 0
