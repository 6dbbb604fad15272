"""Corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, packing.

Each stage works on what the stage before it kept, written as Parquet and read again; all but the last return the
columns of ``documents``. A null document id is never a reason to leave a document out.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolake.llm import langid
from kairolake.llm.common import materialize, table
from kairolake.llm.line_dedup import dedup_lines
from kairolake.llm.mixing import mix
from kairolake.llm.near_dedup import NearDedupConfig, near_duplicates
from kairolake.llm.packing import pack
from kairolake.llm.tokens import public_tokenizer


#: Target weight of each source in the mix, by name; None: natural shares, none above a quarter where the others can
#: make up for it.
WEIGHTS: dict[str, float] | None = None


def _without(docs: DataFrame, decided: DataFrame, name: str) -> DataFrame:
    """``docs`` without the ids of ``decided``. The ids are written first, so that Spark knows their size: up to
    its broadcast threshold the texts aren't shuffled, beyond it both sides are."""
    ids = materialize(decided.select("doc_id"), name)
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or without a letter) go. The model is fitted on the labelled documents."""
    known = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.fit(known.where(~langid.held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go from the texts; a document that loses all of them stays, empty."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = dedup_lines(docs, carry=others)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id (five words, 0.8)."""
    return _without(docs, near_duplicates(docs, NearDedupConfig()).where(~F.col("kept")), "dropped")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the schedule: the mix first (no source above a quarter of it where the others
    can make up for it), behind it the reserve, what a source has beyond its weight. Rows without an id come last."""
    order = materialize(mix(docs, WEIGHTS).groupBy("doc_id").agg(F.min(F.struct("phase", "slot")).alias("at")), "schedule")
    return docs.join(order, "doc_id", "left").orderBy(F.col("at").asc_nulls_last()).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096, in the order of mixing. Rows are in that order in the files that Spark wrote;
    the files' numbers and the rows' places in them tell it, as a table read back has no order of its own."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not read from files
        docs = materialize(docs, "mixed")
    name, number = F.col("_metadata.file_name"), lambda form: F.coalesce(F.regexp_extract(name, form, 1).try_cast("long"), F.lit(0))
    file = number(r"^part-(\d+)-") * (1 << 20) + number(r"-c(\d+)\.")
    return pack(docs, public_tokenizer(), order=(file, F.col("_metadata.row_index")))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Language ID, sketches and packing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
