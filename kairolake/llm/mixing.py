"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut, in a fixed order, into blocks of near equal bytes. In a mix of total weight 1 the
j-th block of a source of weight w is released at slot floor(j / w) and due by slot ceil((j + 1) / w); serving the
earliest deadline among the released blocks meets every deadline, so that at any slot each source is less than one
block away from its share. Weights are whole numbers in the schedule, so that releases and deadlines are exact at
any length. One task writes the schedule from the first slot to the last and holds one block a source; each block
of the documents then finds its slot by a join.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, materialize, table

#: Rows that one window orders.
WINDOW_ROWS = 20_000


@dataclass(frozen=True)
class MixConfig:
    """``block_bytes``: bytes of a block, or what gives ``most_blocks`` blocks in all where that is more (at 64 KB
    beyond 4 TB), as one task writes the schedule, some microseconds a block. ``max_share``: without given weights a source's weight is its natural share, at most this much (sources
    beyond it are down-weighted). ``frame``: slots of the schedule that are held at a time."""

    block_bytes: int = 64 << 10
    most_blocks: int = 1 << 26
    max_share: float = 0.25
    frame: int = 1 << 16


def frame_schedule(weights: dict[str, int], blocks: dict[str, int] | None = None, slots: int | None = None) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, j, release, deadline, slot) of the first ``slots`` slots; without ``blocks`` and ``slots`` the
    weights are the blocks of each source, and all of them are scheduled."""
    blocks = weights if blocks is None else blocks
    total = sum(weights.values())
    due = lambda s, j: -(-(j + 1) * total // weights[s])
    waiting = [(0, s, 0) for s, w in sorted(weights.items()) if w and blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    for slot in range(total if slots is None else slots):
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, j), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        yield s, j, release, deadline, slot
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))


def natural_weights(blocks: dict[str, int], max_share: float) -> dict[str, Fraction]:
    """Exact shares of the blocks, none above ``max_share`` of the mix where the others can make up for it. Too few
    sources for that keep their natural shares, so that no small source is weighted up until it runs out."""
    if len(blocks) * max_share < 1:
        return {s: Fraction(n, sum(blocks.values())) for s, n in blocks.items()}
    max_share = Fraction(str(max_share))
    capped: set[str] = set()
    while True:
        rest = sum(n for s, n in blocks.items() if s not in capped)
        room = 1 - max_share * len(capped)
        over = {s for s, n in blocks.items() if s not in capped and rest and Fraction(n, rest) * room > max_share}
        if not over or (len(capped) + len(over)) * max_share >= 1 or len(over) == len(blocks) - len(capped):
            break
        capped |= over
    return {s: max_share if s in capped else Fraction(n, rest) * room for s, n in blocks.items()} if blocks else {}


def quotas_of(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, int]:
    """Blocks of each source in the longest mix that keeps to the weights: until the first source runs out."""
    wanted = {s: w for s, w in weights.items() if w > 0 and blocks.get(s)}
    if not wanted:
        return {}
    wanted = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in wanted.items()}
    scale = min(blocks[s] / w for s, w in wanted.items())
    return {s: min(blocks[s], int(w * scale)) for s, w in wanted.items()}


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in the same proportion; a float counts as the decimal number it prints."""
    exact = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items()}
    base = lcm(*[w.denominator for w in exact.values()])
    return {s: int(w * base) for s, w in exact.items()}


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[int, str, int, int, int, int]]:
    """(phase, source, block, release, deadline, slot) of every block: the mix, then the reserve in proportion to
    what is left."""
    quotas = quotas_of(blocks, weights)
    used: Counter[str] = Counter()
    for s, j, *times in frame_schedule(whole_weights({s: weights[s] for s in quotas}), blocks, sum(quotas.values())):
        used[s] += 1
        yield 0, s, j, *times
    for s, j, *times in frame_schedule({s: n - used[s] for s, n in blocks.items() if n > used[s]}):
        yield 1, s, used[s] + j, *times


def mix(docs: DataFrame, weights: dict[str, float] | None = None, cfg: MixConfig | None = None, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, block, phase, release, deadline, slot) of every row.

    Phase 0 is the mix: it lasts until a source with weight has no more blocks, and at each of its slots every
    source is less than one block from its weight. What is left over is the reserve, phase 1, scheduled behind it
    in proportion to what is left; no row is lost. A null source is a source of its own (""); null texts weigh
    one byte; a document longer than a block takes the slots it covers; rows without an id, and rows that repeat one, are rows like
    others. Order inside a block: by hash bin, then
    id. An empty table gives no rows; other columns are ignored. The number of sources is taken to be small (they
    are named in the weights): their totals are read to the driver, one row each."""
    cfg = cfg or MixConfig()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), (F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) + 1).cast("long").alias("bytes"))
    rows = materialize(rows, "sizes")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bins, block_bytes = max(1, -(-n // WINDOW_ROWS)), max(cfg.block_bytes, -(-size // cfg.most_blocks))
    binned = rows.withColumn("bin", F.pmod(F.xxhash64("id"), F.lit(bins)))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = binned.groupBy("source", "bin").agg(F.sum("bytes").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    inside = Window.partitionBy("source", "bin").orderBy("id", "bytes").rowsBetween(Window.unboundedPreceding, 0)
    placed = binned.withColumn("upto", F.sum("bytes").over(inside)).join(bases, ["source", "bin"])
    cut = placed.select("id", "source", F.floor((F.col("base") + F.col("upto") - F.col("bytes")) / block_bytes).cast("long").alias("block"))
    cut = materialize(cut, "blocks")
    blocks = {r["source"]: r["n"] for r in cut.groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}

    weights = natural_weights(blocks, cfg.max_share) if weights is None else weights
    form = pa.schema([("phase", pa.int32()), ("source", pa.string()), *[(c, pa.int64()) for c in ("block", "release", "deadline", "slot")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = schedule(blocks, weights)
        for batch in batches:
            while batch.num_rows and (part := list(islice(rows, cfg.frame))):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), form, strict=True)], schema=form)

    slots = spark.range(0, 1, 1, 1).mapInArrow(frugal(run), "phase int, source string, block long, release long, deadline long, slot long")
    timed = cut.join(materialize(slots, "slots"), ["source", "block"])
    return timed.select(F.col("id").alias(id_col), "source", "block", "phase", "release", "deadline", "slot")


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all documents; no source above a quarter of the mix."""
    return mix(table(spark, sf_dir, "documents"))
