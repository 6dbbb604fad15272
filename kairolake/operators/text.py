"""Text relevance, answers and string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import stored
from . import text_index as I

LETTERS = "ABCDE"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits (ASCII)."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def tfidf_relevance(docs: DataFrame, query: DataFrame) -> DataFrame:
    """(grp, doc, score): TF-IDF cosine of each document (grp, doc, text) with its group's query (grp, text).

    The query counts as one of the corpus' documents; idf = ln((1 + n) / (1 + df)) + 1; a blank query gives 0."""
    corpus = stored(I.document_terms(docs), "terms", I.GROUP_BYTES)
    terms, asked = stored(I.term_counts(corpus), "counts"), I.query_terms(query)
    postings = corpus.select("grp", "doc", "dl", F.inline("terms"))
    return I.tfidf_scores(postings, terms, corpus, I.document_moments(postings, terms), asked)


def bm25_relevance(docs: DataFrame, query: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(grp, doc, score): Okapi BM25; a negative idf becomes ``floor`` times the group's mean idf; repeated query
    terms count each time; documents without tokens score 0. Only the query's terms are joined with the documents;
    of the others just the number of documents that hold them is counted, for the mean."""
    corpus = stored(I.document_terms(docs), "terms", I.GROUP_BYTES)
    terms, asked = stored(I.term_counts(corpus), "counts"), I.query_terms(query)
    return I.bm25_scores(corpus.select("grp", "doc", "dl", F.inline("terms")), terms, corpus, asked, k1, b, floor)


def answer_index(answer: Column, options: Column) -> Column:
    """0-based option from a digit, a letter, or an option's exact text; null otherwise or out of range."""
    a = F.trim(answer)
    n = F.size(options)
    digit = F.when(a.rlike("^[0-9]+$"), a.try_cast("int"))
    letter = F.when(a.rlike("^[A-Za-z]$"), F.ascii(F.upper(a)) - 65)
    text = F.nullif(F.array_position(options, a), F.lit(0)).cast("int") - 1
    pick = F.coalesce(digit, letter, text)
    return F.when((pick >= 0) & (pick < n), pick)


def spoken_letter(text: Column, options: int) -> Column:
    """0-based option from the first free-standing letter A-E in a text, bounded by the number of options."""
    letter = F.regexp_extract(text, r"(?i)\b([A-E])\b", 1)
    index = F.when(letter != "", F.ascii(F.upper(letter)) - 65)
    return F.when(index < options, index)


def prompt(question: Column, options: Column, windows: Column | None = None) -> Column:
    """Question, lettered options, and merged windows as one text."""
    listed = F.array_join(F.transform(options, lambda o, i: F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (i + 1).cast("int"), F.lit(1)), F.lit(". "), o)), "\n")
    parts = [question, listed]
    if windows is not None:
        parts.append(F.concat(F.lit("Windows: "), F.array_join(F.transform(windows, lambda w: F.format_string("%.1f-%.1f", w["start_s"], w["end_s"])), ", ")))
    return F.concat_ws("\n", *parts)


def clip_name(name: Column) -> tuple[Column, Column]:
    """(id, start second) of ``id_start``; the id may hold underscores itself."""
    return F.nullif(F.regexp_extract(name, r"^(.+)_(\d+)$", 1), F.lit("")), F.regexp_extract(name, r"^(.+)_(\d+)$", 2).try_cast("int")


def clock_seconds(text: Column, strict: bool = True) -> Column:
    """Seconds of HH:mm:ss.SSS; what isn't one raises, or is null if not strict."""
    p = F.split(text, ":")
    value = F.get(p, F.lit(0)).try_cast("int") * 3600 + F.get(p, F.lit(1)).try_cast("int") * 60 + F.get(p, F.lit(2)).try_cast("double")
    value = F.when(F.size(p) == 3, value)
    return F.when(value.isNull() & text.isNotNull(), F.raise_error(F.concat(F.lit("not a clock time: "), text)).cast("double")).otherwise(value) if strict else value


def stable_offset(text: Column, modulus: int) -> Column:
    """The first eight hex digits of the SHA-1, as a number modulo ``modulus``."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long") % modulus


def literal_paths(text: Column) -> Column:
    """Paths with a slash and an extension."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[a-z0-9]+)"), F.lit(1))


def embedding_relevance(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(clip_id, t, score): dot of unit vectors (clip_id, t, emb) with their clip's query vector (clip_id, q)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = vectors.join(query, "clip_id")
    return both.select("clip_id", "t", (dot("emb", "q") / (F.sqrt(dot("emb", "emb")) * F.sqrt(dot("q", "q")))).alias("score"))
