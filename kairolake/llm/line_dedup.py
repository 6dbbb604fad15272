"""Reversible line dedup: exact reference counts with sharded cuckoo filters in front of them.

The index of a corpus is three tables in shared storage:

* ``postings(key, doc_id)``: one row for each distinct line key of a document,
* ``refs(key, shard, n_docs, first_doc)``: the exact reference counts,
* ``filters(shard, bits)``: for each shard of the key space a cuckoo filter of the keys with two or more documents.

A line is looked up in the filter first; only if that says "maybe repeated" is it joined with the exact table, so
that the many unique lines are settled where they are read. Inserting documents adds keys that reach two
references to the filters, deleting documents takes out keys that fall back to one: cuckoo filters, unlike Bloom
filters, allow that, and the line that a deleted document had suppressed elsewhere comes back."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, scratch, slices, table

SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Keys that a shard's filter is planned for, and filters that are broadcast at most (bytes, checked).
SHARD_KEYS = 200_000
BROADCAST_BYTES = 64 << 20
#: Documents from which on a line is common, and common lines that are broadcast at most (32 bytes each, counted).
COMMON, BROADCAST_KEYS = 2000, 100_000
SLOTS = 4
KICKS = 500


class CuckooFilter:
    """16-bit fingerprints in buckets of four. A table that overflows gets another one behind it."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables

    @classmethod
    def planned(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(3, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8))))
        return cls([np.zeros((buckets, SLOTS), np.uint16)])

    @classmethod
    def load(cls, bits: bytes) -> CuckooFilter:
        tables, at = [], 0
        while at < len(bits):
            n = int.from_bytes(bits[at : at + 8], "little")
            tables.append(np.frombuffer(bits[at + 8 : at + 8 + 2 * SLOTS * n], np.uint16).reshape(n, SLOTS).copy())
            at += 8 + 2 * SLOTS * n
        return cls(tables)

    def dump(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @staticmethod
    def _prints(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(48)).astype(np.uint16) | np.uint16(1)

    @staticmethod
    def _other(bucket, prints, n: int):
        return (bucket ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(n - 1)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        prints = self._prints(hashes)
        for t in self.tables:
            one = hashes & np.uint64(len(t) - 1)
            two = self._other(one, prints, len(t))
            found |= (t[one] == prints[:, None]).any(axis=1) | (t[two] == prints[:, None]).any(axis=1)
        return found

    def insert(self, hashes: np.ndarray) -> None:
        for h, p in zip(hashes, self._prints(hashes), strict=True):
            if not self._put(self.tables[-1], h, p):
                self.tables.append(np.zeros_like(self.tables[-1]))
                self._put(self.tables[-1], h, p)

    def _put(self, t: np.ndarray, h: np.uint64, p: np.uint16) -> bool:
        before = None
        at = h & np.uint64(len(t) - 1)
        for bucket in (at, self._other(at, p, len(t))):
            free = np.flatnonzero(t[bucket] == 0)
            if len(free):
                t[bucket, free[0]] = p
                return True
        before = t.copy()
        for i in range(KICKS):
            at = self._other(at, p, len(t))
            slot = i % SLOTS
            t[at, slot], p = p, t[at, slot]
            bucket = self._other(at, p, len(t))
            free = np.flatnonzero(t[bucket] == 0)
            if len(free):
                t[bucket, free[0]] = p
                return True
        t[:] = before  # no room: as it was, the next table takes the key
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for h, p in zip(hashes, self._prints(hashes), strict=True):
            for t in self.tables:
                one = h & np.uint64(len(t) - 1)
                at = next(((b, s[0]) for b in (one, self._other(one, p, len(t))) if len(s := np.flatnonzero(t[b] == p))), None)
                if at is not None:
                    t[at] = 0
                    break


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """What filters use of a 128-bit key: its second half."""
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[:, 1] if keys else np.zeros(0, np.uint64)


def key_shards(keys: list[bytes], shards: int) -> np.ndarray:
    """The shard of each key, as ``pmod(xxhash64(key), 1 << 20) % shards`` in Spark."""
    return np.fromiter((xxhash.xxh64_intdigest(k, 42) % (1 << 20) % shards for k in keys), np.int64, len(keys))


def line_keys(text: str | None, least: int) -> list[bytes | None]:
    """The 128-bit key of each line; None for lines whose key is shorter than ``least`` code points."""
    keys = (line.strip(SPACE).translate(LOWER) for line in (text or "").split("\n"))
    return [xxhash.xxh3_128_digest(k.encode()) if len(k) >= least else None for k in keys]


@dataclass(frozen=True)
class LineIndex:
    spark: SparkSession
    folder: str
    shards: int
    least: int

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def postings(self) -> DataFrame:
        return self._read("postings")

    @property
    def refs(self) -> DataFrame:
        return self._read("refs")

    @property
    def filters(self) -> DataFrame:
        return self._read("filters")


def _texts(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _postings(batches: Iterator[pa.RecordBatch], least: int, keep: Callable[[list[bytes]], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """(key, doc_id), once a document and batch, of the keys that ``keep`` says yes to."""
    for batch in batches:
        for part in slices(batch, "text"):
            lists = pc.split_pattern(pc.fill_null(part.column("text"), ""), "\n")
            coded = pc.ascii_lower(pc.ascii_trim(lists.flatten(), SPACE)).dictionary_encode()
            long = np.array(pc.greater_equal(pc.utf8_length(coded.dictionary), least).to_numpy(zero_copy_only=False), bool)
            owner, code = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy())), coded.indices.to_numpy().astype(np.int64)
            digests = [xxhash.xxh3_128_digest(k.as_buffer()) if ok else None for k, ok in zip(coded.dictionary.cast(pa.binary()), long, strict=True)]
            if keep:
                long[long] = keep([k for k in digests if k is not None])
            once = pd.unique((owner * len(long) + code)[long[code]])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()).take(pa.array(once % max(1, len(long)))), part.column("doc_id").take(pa.array(once // max(1, len(long))))], names=["key", "doc_id"])


def _keys_of(texts: DataFrame, least: int) -> DataFrame:
    """(key, doc_id), once a document and batch."""
    return texts.mapInArrow(frugal(lambda batches: _postings(batches, least)), "key binary, doc_id long")


def _count(postings: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    return postings.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).select("key", shard.alias("shard"), "n_docs", "first_doc")


def _refiltered(changes: DataFrame, filters: DataFrame | None) -> DataFrame:
    """Applies ``changes(shard, key, added)`` to the filters; each shard is one bounded group."""
    if filters is None:

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.planned(len(frame))
            f.insert(key_hashes(list(frame["key"])))
            return pd.DataFrame({"shard": frame["shard"].iloc[:1].to_numpy(), "bits": [f.dump()]})

        return changes.groupBy("shard").applyInPandas(build, "shard int, bits binary")

    def update(frame: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.load(old["bits"].iloc[0]) if len(old) else CuckooFilter.planned(len(frame))
        f.insert(key_hashes(list(frame.loc[frame["added"], "key"])))
        f.delete(key_hashes(list(frame.loc[~frame["added"], "key"])))
        return pd.DataFrame({"shard": (frame if len(frame) else old)["shard"].iloc[:1].to_numpy(), "bits": [f.dump()]})

    return changes.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(update, "shard int, bits binary")


def build_index(docs: DataFrame, least: int = 10, text: str = "text", id_col: str = "doc_id", postings: bool = True) -> LineIndex:
    """Index of a corpus. Without ``postings`` it can be read but not changed."""
    spark = docs.sparkSession
    folder = scratch(spark, "lines")
    keys = _keys_of(_texts(docs, text, id_col), least)
    if postings:
        keys.distinct().write.parquet(f"{folder}/postings")
        keys = spark.read.parquet(f"{folder}/postings")
    _count(keys, 1 << 20).where("true" if postings else "n_docs > 1").write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    shards = max(1, -(-counts.where("n_docs > 1").count() // SHARD_KEYS))
    counts.withColumn("shard", (F.col("shard") % shards).cast("int")).write.parquet(f"{folder}/refs")
    index = LineIndex(spark, folder, shards, least)
    _refiltered(index.refs.where("n_docs > 1").select("shard", "key"), None).write.parquet(f"{folder}/filters")
    return index


def _changed(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The index after ``postings`` replaced the old ones; only keys in ``touched`` differ."""
    folder = scratch(index.spark, "lines")
    postings.write.parquet(f"{folder}/postings")
    postings = index.spark.read.parquet(f"{folder}/postings")
    again = _count(postings.join(touched, "key", "left_semi"), 1 << 20).withColumn("shard", (F.col("shard") % index.shards).cast("int"))
    index.refs.join(touched, "key", "left_anti").unionByName(again).write.parquet(f"{folder}/counts")
    refs = index.spark.read.parquet(f"{folder}/counts")
    needed = -(-refs.where("n_docs > 1").count() // SHARD_KEYS)
    shards = needed if needed > 2 * index.shards else index.shards
    refs.withColumn("shard", (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) % shards).cast("int")).write.parquet(f"{folder}/refs")
    new = LineIndex(index.spark, folder, shards, index.least)
    if shards > index.shards:  # the shards have outgrown what their filters were planned for
        _refiltered(new.refs.where("n_docs > 1").select("shard", "key"), None).write.parquet(f"{folder}/filters")
        return new
    was = index.refs.join(touched, "key", "left_semi").where("n_docs > 1").select("key", "shard")
    now = new.refs.join(touched, "key", "left_semi").where("n_docs > 1").select("key", "shard")
    flips = now.join(was, "key", "left_anti").withColumn("added", F.lit(True)).unionByName(was.join(now, "key", "left_anti").withColumn("added", F.lit(False)))
    _refiltered(flips, index.filters).write.parquet(f"{folder}/filters")
    return new


def insert(index: LineIndex, docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> LineIndex:
    """The index with the lines of further documents."""
    more = _keys_of(_texts(docs, text, id_col), index.least).distinct()
    return _changed(index, index.postings.unionByName(more).distinct(), more.select("key").distinct())


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents in ``doc_ids(doc_id)``."""
    gone = index.postings.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return _changed(index, index.postings.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti"), gone.select("key").distinct())


def _maybe_repeated(texts: DataFrame, index: LineIndex) -> DataFrame:
    """(key, doc_id) of the lines that the filters don't rule out."""
    size = index.filters.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0)).alias("n")).first()["n"]
    if size > BROADCAST_BYTES:  # each shard's filter travels to its part of the lines, salted by document
        salts = 16
        keys, shard = _keys_of(texts, index.least), F.pmod(F.xxhash64("key"), F.lit(1 << 20)) % index.shards
        dealt = keys.withColumn("shard", shard.cast("int")).withColumn("salt", F.pmod(F.col("doc_id"), F.lit(salts)).cast("int"))
        copies = index.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def probe(frame: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            if not len(old) or not len(frame):
                return frame.iloc[:0][["key", "doc_id"]]
            return frame.loc[CuckooFilter.load(old["bits"].iloc[0]).contains(key_hashes(list(frame["key"]))), ["key", "doc_id"]]

        return dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, "key binary, doc_id long")

    shipped = index.spark.sparkContext.broadcast({r["shard"]: bytes(r["bits"]) for r in index.filters.collect()})
    least, n_shards = index.least, index.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: CuckooFilter.load(b) for s, b in shipped.value.items()}

        def keep(keys: list[bytes]) -> np.ndarray:
            hashes, shards = key_hashes(keys), key_shards(keys, n_shards)
            out = np.zeros(len(keys), bool)
            for s in np.unique(shards):
                at = shards == s
                if s in filters:
                    out[at] = filters[s].contains(hashes[at])
            return out

        yield from _postings(batches, least, keep)

    # keys and filters in one function: one behind the other are two Python workers a task, all of which Spark keeps
    return texts.mapInArrow(frugal(run), "key binary, doc_id long")


def dropped_keys(docs: DataFrame, index: LineIndex, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, keys): the line keys that each document loses."""
    maybe = _maybe_repeated(_texts(docs, text, id_col), index)
    exact = index.refs.where("n_docs > 1").select("key", "n_docs", "first_doc")
    common = exact.where(F.col("n_docs") >= COMMON)
    if common.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:  # lines of very many documents don't meet in a task
        rest = maybe.join(F.broadcast(common.select("key")), "key", "left_anti").join(exact.where(F.col("n_docs") < COMMON), "key")
        found = maybe.join(F.broadcast(common), "key").unionByName(rest)
    else:
        found = maybe.join(exact, "key")
    return found.where("first_doc <> doc_id").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, least: int = 10, text: str = "text", id_col: str = "doc_id", digest: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every document without the lines that an earlier one (smaller id) holds.

    Lines are cut at ``\\n``; a line's key is the line stripped of ASCII white space with A-Z lower-cased; keys
    under ``least`` code points always stay. Null and empty texts are one empty line. Lines repeated inside the
    smallest document stay, very long texts are read whole, rows that repeat an id count as one document. A document without an id is left as it is and suppresses nothing. With ``digest``
    the kept text's SHA-256 comes instead of the text. The columns in ``carry`` come along, others are ignored; an
    empty table gives no rows."""
    known = docs.where(F.col(id_col).isNotNull())
    index = index or build_index(known, least, text, id_col, postings=False)
    drops = dropped_keys(known, index, text, id_col)
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), rest.alias("rest"))
    joined = narrow.join(drops, "doc_id", "left").select("doc_id", "text", "keys", "rest")
    least = index.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines, lost, kept = [], [], []
                for t, drop in zip(part.column("text").to_pylist(), part.column("keys").to_pylist(), strict=True):
                    rows = (t or "").split("\n")
                    if drop:
                        drop = {*drop}
                        stay = [r for r, k in zip(rows, line_keys(t, least), strict=True) if k is None or k not in drop]
                    else:
                        stay = rows
                    lines.append(len(rows))
                    lost.append(len(rows) - len(stay))
                    whole = "\n".join(stay)
                    kept.append(hashlib.sha256(whole.encode()).hexdigest() if digest else whole)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lines, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string()), part.column("rest")], names=["doc_id", "n_lines", "n_dropped", name, "rest"])

    name = "kept_sha256" if digest else "text"
    kind = joined.schema["rest"].dataType.simpleString()
    out = joined.mapInArrow(frugal(run), f"doc_id long, n_lines long, n_dropped long, {name} string, rest {kind}")
    return out.select(F.col("doc_id").alias(id_col), "n_lines", "n_dropped", name, *[F.col(f"rest.{c}").alias(c) for c in carry or []])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents."""
    return dedup_lines(table(spark, sf_dir, "documents"), digest=True)


SQL = {
    "op9_line_dedup": """
        with lines as (
            select doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
            from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)
        ), rep as (
            select k, min(doc_id) as first_doc from lines where length(k) >= 10 group by k having count(distinct doc_id) > 1
        ), marked as (
            select doc_id, i, l, r.k is not null and doc_id <> first_doc as lost from lines left join rep r on lines.k = r.k
        )
        select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
               sha256(coalesce(string_agg(l, chr(10) order by i) filter (where not lost), '')) as kept_sha256
        from marked group by doc_id"""
}
