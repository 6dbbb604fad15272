"""Token-id output: flat unsigned integer files with 64-bit document offsets.

A data set is a folder in shared storage:

* ``part-NNNNN.ids``: the ids of the part's documents back to back, little-endian ``uint16`` where the vocabulary
  allows it, else ``uint32``; meant to be memory-mapped.
* ``part-NNNNN.idx``: little-endian ``int64``: the document ids, then the documents' starts inside the part and
  its end (one more than documents).
* ``parts``: a Parquet table (part, docs, tokens, base); ``base`` is the prefix sum of the tokens of the parts
  before, so that the global start of a document is ``base`` plus its start in the part.

Parts follow one another in ascending document id. Each task writes its own part under a temporary name and then
moves it into place, so a repeated or speculative attempt leaves the same files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, scratch, table
from .tokens import END_ID, Encoder, public_tokenizer, together

#: Stands for a null document id in the files.
NO_ID = np.iinfo(np.int64).min
#: Bytes of text that a part is planned for.
PART_BYTES = 64 << 20


def ids_dtype(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, by_word: bool = True, text: str = "text", id_col: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Writes the data set and returns its ``parts`` table.

    Null texts count as empty: the end id alone. Rows with equal document ids stay apart, ordered by text; null
    ids come first. An empty table gives a data set without parts. Other columns are ignored."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    if parts is None:
        size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-size // PART_BYTES), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name = f"{root}/part-{task.partitionId():05d}"
        mine = f".{task.taskAttemptId()}"
        encode = Encoder(tokenizer, by_word)
        dtype = ids_dtype(encode.vocabulary)
        ids, starts, total = [], [np.zeros(1, "<i8")], 0
        with store.open_output_stream(f"{name}.ids{mine}") as out:
            for batch in together(batches, "text"):
                for part, offsets, flat in encode.parts(batch, "text", END_ID):
                    out.write(flat.astype(dtype).tobytes())
                    ids.append(part.column("id").fill_null(int(NO_ID)).to_numpy().astype("<i8"))
                    starts.append((offsets[1:] + total).astype("<i8"))
                    total += int(offsets[-1])
        if not ids:
            store.delete_file(f"{name}.ids{mine}")
            return
        ids = np.concatenate(ids)
        with store.open_output_stream(f"{name}.idx{mine}") as out:
            out.write(np.concatenate([ids, *starts]).tobytes())
        for kind in ("ids", "idx"):
            store.move(f"{name}.{kind}{mine}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64()), pa.array([dtype.itemsize], pa.int32())], names=["part", "docs", "tokens", "width"])

    ordered = narrow.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    ordered.mapInArrow(frugal(run), "part int, docs long, tokens long, width int").write.parquet(f"{folder}/written")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spark.read.parquet(f"{folder}/written").withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{folder}/parts")
    return spark.read.parquet(f"{folder}/parts")


def _opened(store: pafs.FileSystem, path: str, dtype: str):
    """A function (a, b) -> values a to b of a file; only they are read."""
    if isinstance(store, pafs.LocalFileSystem):
        values = np.memmap(path, dtype, mode="r")
        return lambda a, b: values[a:b]
    file, width = store.open_input_file(path), np.dtype(dtype).itemsize
    return lambda a, b: np.frombuffer(file.read_at((b - a) * width, a * width), dtype)


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document from the files alone; with ``ids`` the ids too."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = str(PurePosixPath(root) / f"part-{row['part']:05d}")
                ids_of, index = _opened(store, f"{name}.ids", f"<u{row['width']}"), _opened(store, f"{name}.idx", "<i8")
                n = row["docs"]
                for i in range(0, n, 2000):
                    d, s = index(i, min(i + 2000, n)), index(n + i, n + min(i + 2000, n) + 1)
                    each = [np.asarray(ids_of(a, b), "<u4") for a, b in zip(s[:-1], s[1:], strict=True)]
                    columns = [pa.array(np.asarray(d), mask=np.asarray(d) == NO_ID), pa.array(s[:-1] + row["base"]), pa.array(np.diff(s)), pa.array([zlib.crc32(e.tobytes()) for e in each], pa.int64())]
                    if ids:
                        columns.append(pa.array([e.astype(np.int32) for e in each], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    listed = spark.read.parquet(f"{folder}/parts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "part").mapInArrow(frugal(run), schema)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and returns what the files say."""
    folder = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizer())
    return read_tokens(spark, folder)
