"""Helpers shared by the training-data operators: shared storage, Arrow batches, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_LOCAL: dict[str, str] = {}

#: Rows of an Arrow batch at most. Texts make batches large; tasks cut them into slices of about this many rows anyway.
ARROW_ROWS = 2048


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to ``ARROW_ROWS``; a smaller setting of the user stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def give_back() -> None:
    """Gives memory that Arrow and the C library have freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def frugal(run):
    """A function for ``mapInArrow`` after whose task the Python worker, which Spark uses again, gives freed memory
    back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only on a single machine, where it may be
    unset, a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_heavy_apart(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``keyed``, which has one row a key and in ``size`` how many of the ``total`` rows hold
    it. Keys with a thousandth of the rows (1,000 at least) are so few that they are broadcast; the others, none of
    which can overfill a task, are shuffled."""
    least = max(1000, -(-total // 1000))
    heavy = keyed.where(F.col(size) >= least)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(keyed.where(F.col(size) < least), key)
    return rows.join(F.broadcast(heavy), key).select(*rest.columns).unionAll(rest)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a slice stay near ``max_bytes``; a longer single text is one slice."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // max_bytes
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield batch.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets by text and the flat words: runs without ASCII white space, A-Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        offsets, flat = kept[offsets], flat.filter(pa.array(full))
    return offsets, flat


def hash_words(flat: pa.Array) -> np.ndarray:
    """64-bit hash of each word; each distinct word of the batch is hashed once."""
    if len(flat) == 0:
        return np.zeros(0, U64)
    enc = flat.dictionary_encode()
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.combine_chunks()
    words = enc.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    table_ = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U64, len(words))
    return table_[enc.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))
