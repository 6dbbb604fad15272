"""Exact dedup with a split for heavy hitters.

Digests of the normalised texts are counted by a Misra-Gries summary (``DataFrame.freqItems``); the candidates it
names are verified by an exact count. Those winners are at most ``1 / support`` rows, so they are broadcast and
their copies are settled on the map side. All other digests are settled by an ordinary shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

#: A digest is heavy when it holds at least this share of the rows: at most 1,000 rows are ever broadcast.
SUPPORT = 0.001


def text_digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, digest): SHA-256 of the text with A-Z lower-cased, in UTF-8; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lower = pc.ascii_lower(pc.fill_null(part.column("text"), "")).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([hashlib.sha256(t.as_buffer()).digest() for t in lower], pa.binary())], names=["id", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, digest binary")


def heavy_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, keep_id, group_size) of the digests that hold at least ``support`` of the rows."""
    total = digests.count()
    named = digests.select(F.hex("digest").alias("h")).freqItems(["h"], support).select(F.explode("h_freqItems").alias("h"))
    counted = digests.join(F.broadcast(named.select(F.unhex("h").alias("digest"))), "digest").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return counted.where(F.col("group_size") >= F.lit(support * total))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Of the rows with equal normalised text the one with the largest id stays. Null and empty texts are equal to
    one another, very long ones are read whole. Rows that repeat an id keep their own rows; a null id stays only if its whole group has no id.
    An empty table gives no rows; other columns are ignored."""
    digests = materialize(text_digests(docs, text, id_col), "digests")
    heavy = F.broadcast(materialize(heavy_digests(digests, support), "heavy"))
    settled = digests.join(heavy, "digest").select("id", "digest", "keep_id", "group_size")
    other = digests.join(heavy.select("digest"), "digest", "left_anti")
    groups = other.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rest = other.join(groups, "digest").select("id", "digest", "keep_id", "group_size")
    return settled.unionAll(rest).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, dropped ones too."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op3_exact_dedup": """
        with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents)
        select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
               doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256
        from d"""
}
