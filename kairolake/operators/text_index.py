"""An inverted index for text relevance, and what one-off relevance shares with it.

Terms are counted inside tasks, column by column: the tokens of a batch become dictionary codes, and one sort of
(document, code) counts them. An index stores postings (grp, term, doc, tf, dl) in ranges of (grp, term, doc), so that a
query's terms are found by the files' statistics and a hot term lies in several files, beside the documents and the
terms with their document counts. It grows by segments: appending writes the new documents' rows alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import stored
from .ranks import join_apart

#: Rows of a vocabulary or of query terms that are broadcast; larger ones are joined.
BROADCAST_TERMS = 1_000_000
#: Row groups of counted documents: a split of texts gives several tasks to what follows.
GROUP_BYTES = 4 << 20
#: Different query terms whose postings are asked for by name; more are found by a join.
NAMED_TERMS = 1000


def _counted(words: pa.ListArray) -> pa.ListArray:
    """Each row's terms with their counts, as a list of (term, tf)."""
    flat, ends = words.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))])
    row = np.repeat(np.arange(len(words)), np.diff(ends))
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    codes = flat.filter(pa.array(full)).dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    size = max(1, len(codes.dictionary))
    pairs, tf = np.unique(row[full] * size + codes.indices.to_numpy().astype(np.int64), return_counts=True)
    starts = np.searchsorted(pairs, np.arange(len(words) + 1) * size).astype(np.int32)
    terms = pa.StructArray.from_arrays([codes.dictionary.take(pa.array(pairs % size)), pa.array(tf.astype(np.int32))], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(starts), terms)


def document_terms(docs: DataFrame) -> DataFrame:
    """(grp, doc, dl, terms) of (grp, doc, text): number of tokens (lower-case runs of ASCII letters and digits), and
    each term with its count. A null text has no token; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                terms = _counted(pc.split_pattern_regex(part.column("text"), "[^a-z0-9]+"))
                held = np.concatenate([[0], np.cumsum(terms.values.field("tf").to_numpy())])
                dl = np.diff(held[terms.offsets.to_numpy()]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("grp"), part.column("doc"), pa.array(dl), terms], names=["grp", "doc", "dl", "terms"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("grp", "doc"))
    return docs.select("grp", "doc", F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, f"{kinds}, dl int, terms array<struct<term string, tf int>>")


def term_counts(corpus: DataFrame) -> DataFrame:
    """(grp, term, df) of ``document_terms``."""
    return corpus.select("grp", F.inline("terms")).groupBy("grp", "term").agg(F.count(F.lit(1)).alias("df"))


def join_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (grp, term, ..) inner-joined with stored terms (grp, term, df, ..): by broadcast up to
    ``BROADCAST_TERMS`` terms, beyond with the terms of very many documents apart."""
    if terms.count() <= BROADCAST_TERMS:
        return postings.join(F.broadcast(terms), ["grp", "term"])
    return join_apart(postings, terms.withColumn("__df", F.col("df")), ["grp", "term"], "__df")


def query_terms(query: DataFrame) -> DataFrame:
    """(grp, term, qtf) of queries (grp, text), written once."""
    asked = document_terms(query.select("grp", F.lit(0).alias("doc"), "text"))
    return stored(asked.select("grp", F.inline("terms")).groupBy("grp", "term").agg(F.sum("tf").alias("qtf")), "query")


def _asked_terms(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """(grp, term, df, qtf) of the query's terms that the corpus has."""
    return terms.join(F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked, ["grp", "term"])


def bm25_scores(hits: DataFrame, terms: DataFrame, docs: DataFrame, asked: DataFrame, k1: float, b: float, floor: float) -> DataFrame:
    """(grp, doc, score) from the postings of the query's terms (grp, term, doc, tf, dl), all terms with their df and
    all documents with their dl."""
    sizes = docs.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    idf0 = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    levels = terms.groupBy("grp", "df").agg(F.count(F.lit(1)).alias("held"))  # a group's terms have few different counts
    mean = levels.join(sizes, "grp").groupBy("grp").agg((F.sum(idf0 * F.col("held")) / F.sum("held")).alias("mean_idf"))
    idf = _asked_terms(terms, asked).join(sizes, "grp").join(mean, "grp").select("grp", "term", "df", "qtf", "avgdl", F.when(idf0 < 0, floor * F.col("mean_idf")).otherwise(idf0).alias("idf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = join_terms(hits, stored(idf, "idf")).groupBy("grp", "doc").agg(F.sum(part).alias("score"))
    return docs.select("grp", "doc").join(scores, ["grp", "doc"], "left").fillna(0.0, ["score"])


def document_moments(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(grp, doc, s0, s1, s2): sums of tf^2, tf^2 l and tf^2 l^2 over a document's terms, l = ln(1 + df).

    A TF-IDF norm is the root of sum tf^2 (a - l)^2 with a the same for all terms, that is of a^2 s0 - 2 a s1 + s2, so
    these sums serve every query, although each one changes the number of documents and its terms' df."""
    square, level = F.col("tf") * F.col("tf"), F.log1p(F.col("df"))
    return join_terms(postings, terms).groupBy("grp", "doc").agg(F.sum(square).alias("s0"), F.sum(square * level).alias("s1"), F.sum(square * level * level).alias("s2"))


def tfidf_scores(hits: DataFrame, terms: DataFrame, docs: DataFrame, moments: DataFrame, asked: DataFrame) -> DataFrame:
    """(grp, doc, score): cosine of each document and its group's query, which counts as one document of the corpus."""
    sizes = docs.groupBy("grp").agg((F.log(F.count(F.lit(1)) + 2.0) + 1).alias("a"))  # one document more, and one for smoothing
    known = asked.join(_asked_terms(terms, asked).drop("qtf"), ["grp", "term"], "left").join(sizes, "grp").select("grp", "term", F.coalesce("df", F.lit(0)).alias("df"), "qtf", "a")
    idf = F.col("a") - F.log(F.col("df") + 2.0)
    known = stored(known.withColumn("idf", idf), "idf")
    length = known.groupBy("grp").agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("idf"), 2))).alias("qnorm"))
    square, plain = F.col("tf") * F.col("tf"), F.col("a") - F.log1p(F.col("df"))
    found = join_terms(hits.select("grp", "term", "doc", "tf"), known).groupBy("grp", "doc").agg(F.sum(F.col("tf") * F.col("qtf") * F.col("idf") * F.col("idf")).alias("dot"), F.sum(square * (F.col("idf") * F.col("idf") - plain * plain)).alias("more"))
    all_ = docs.select("grp", "doc").join(moments, ["grp", "doc"], "left").join(found, ["grp", "doc"], "left").join(sizes, "grp").join(length, "grp", "left")
    norm = F.sqrt(F.col("a") * F.col("a") * F.col("s0") - 2 * F.col("a") * F.col("s1") + F.col("s2") + F.coalesce("more", F.lit(0.0)))
    return all_.select("grp", "doc", F.coalesce(F.try_divide(F.col("dot"), norm * F.col("qnorm")), F.lit(0.0)).alias("score"))


class TextIndex:
    """An index of (grp, doc, text) under ``path``; a document belongs to one segment."""

    def __init__(self, spark: SparkSession, path: str, segments: int):
        self.spark, self.path, self.segments = spark, path.rstrip("/"), segments

    @staticmethod
    def build(docs: DataFrame, path: str) -> TextIndex:
        index = TextIndex(docs.sparkSession, path, 0)
        index.append(docs)
        return index

    def append(self, docs: DataFrame) -> None:
        """Adds a segment; document counts and mean lengths follow at the next query."""
        folder = f"{self.path}/{{}}/segment={self.segments}"
        corpus = stored(document_terms(docs), "terms", GROUP_BYTES)
        corpus.select("grp", "doc", "dl").write.parquet(folder.format("docs"))
        by = ["grp", "term", "doc"]
        corpus.select("grp", "doc", "dl", F.inline("terms")).select(*by, "tf", "dl").repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(folder.format("postings"))
        term_counts(corpus).write.parquet(folder.format("counts"))
        self.segments += 1

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{kind}/segment={i}" for i in range(self.segments)])

    def documents(self) -> DataFrame:
        return self._read("docs")

    def terms(self) -> DataFrame:
        """(grp, term, df) over all segments."""
        if self.segments == 1:
            return self._read("counts")
        return stored(self._read("counts").groupBy("grp", "term").agg(F.sum("df").alias("df")), "counts")

    def postings(self, asked: DataFrame | None = None) -> DataFrame:
        """All postings, or those of the terms in ``asked``: named in the scan's filter if they are few."""
        rows = self._read("postings")
        if asked is None:
            return rows
        names = [r["term"] for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
        return rows.where(F.col("term").isin(names)) if len(names) <= NAMED_TERMS else rows

    def refresh(self) -> DataFrame:
        """(grp, doc, s0, s1, s2) for TF-IDF, written once; to be made anew after an append, from the postings alone."""
        return stored(document_moments(self.postings(), self.terms()), "moments")

    def bm25(self, query: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
        """(grp, doc, score) of every document for its group's query (grp, text)."""
        asked = query_terms(query)
        return bm25_scores(self.postings(asked), self.terms(), self.documents(), asked, k1, b, floor)

    def tfidf(self, query: DataFrame, moments: DataFrame | None = None) -> DataFrame:
        """(grp, doc, score); ``moments`` as ``refresh`` gave them."""
        asked = query_terms(query)
        return tfidf_scores(self.postings(asked), self.terms(), self.documents(), self.refresh() if moments is None else moments, asked)
