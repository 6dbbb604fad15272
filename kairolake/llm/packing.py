"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents become token pieces of at most one sequence's length. Pieces are dealt into blocks of bounded size; each
block evolves on several islands, whose elites migrate between epochs. A child takes over whole well-filled bins
of one parent, loses the other parent's bins that share pieces with them, and the displaced pieces are placed
again by best fit. Full bins of a block are final; the pieces of its slack bins are pooled over all blocks and
packed again, until one block is left.

Documents that have an order keep it as far as packing allows: a block is a run of neighbouring pieces, a sequence holds
its pieces in their order, and sequences are numbered by their first pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, give_back, materialize, table
from .tokens import END_ID, Encoder, public_tokenizer, together


@dataclass(frozen=True)
class PackConfig:
    """``slack``: free tokens up to which a bin counts as full; where a turn settles less than a tenth of its pieces
    that way, eight times as many from then on."""

    length: int = 4096
    block: int = 2048
    islands: int = 2
    epochs: int = 2
    population: int = 4
    generations: int = 6
    slack: int = 8
    seed: int = 13


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: A piece's place: the part of the order that its document is in (a file, say) and the row in it.
PLACE = ["part", "row"]


def pieces_of(docs: DataFrame, tokenizer: str, length: int, by_word: bool = True, text: str = "text", id_col: str = "doc_id", order: tuple[Column, Column] | None = None) -> DataFrame:
    """PIECE rows: each document's ids with the end id, cut every ``length`` ids; with an ``order`` also PLACE."""
    place = PLACE if order else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, by_word)
        for batch in together(batches, "text"):
            for part, offsets, flat in encode.parts(batch, "text", END_ID):
                rows = []
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    for i, at in enumerate(range(a, b, length)):
                        to = min(b, at + length)
                        rows.append((k, i, at - a, to - at, zlib.crc32(flat[at:to].astype("<u4").tobytes())))
                k, i, s, n, c = zip(*rows, strict=True)
                own = part.select(["doc_id", *place]).take(pa.array(k))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(i, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), *own.columns[1:]], names=["doc_id", "piece", "start", "length", "ids_crc32", *place])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[c.cast("long").alias(name) for c, name in zip(order or (), place, strict=True)])
    return narrow.mapInArrow(frugal(run), PIECE + "".join(f", {c} long" for c in place))


def numbered(rows: DataFrame, out: str, *ties: str) -> DataFrame:
    """``rows`` with their number from 0 in the order of PLACE and ``ties``: counted by part, ordered inside it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("row", *ties)) - 1
    return rows.withColumn(out, inside.cast("long")).join(bases, "part").withColumn(out, F.col(out) + F.col("__base")).drop("__base")


class Packing:
    """Bins of one individual: lists of item numbers."""

    def __init__(self, bins: list[list[int]], size: list[int], room: int):
        self.bins = bins
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.fitness = (-len(bins), sum((f / room) ** 2 for f in self.fill))

    def assignment(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for k, b in enumerate(self.bins):
            out[b] = k
        return out


def best_fit(bins: list[list[int]], items: list[int], size: list[int], room: int) -> list[list[int]]:
    """Places ``items`` in their order where they leave the least room; a new bin where none has room."""
    free = sorted((room - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(free, (size[i], -1))
        if at == len(free):
            bins.append([i])
            left, k = room - size[i], len(bins) - 1
        else:
            left, k = free.pop(at)
            bins[k].append(i)
            left -= size[i]
        if left:
            insort(free, (left, k))
    return bins


def crossover(mother: Packing, father: Packing, size: list[int], room: int, rng: np.random.Generator) -> Packing:
    """Injects the father's well-filled bins into the mother."""
    order = sorted(range(len(father.bins)), key=lambda k: -father.fill[k])
    chosen = [k for k in order[: max(1, len(order) // 2)] if rng.random() < 0.7] or order[:1]
    taken = {i for k in chosen for i in father.bins[k]}
    bins, displaced = [list(father.bins[k]) for k in chosen], []
    for k, b in enumerate(mother.bins):
        if taken.isdisjoint(b) and (room - mother.fill[k] <= room // 16 or rng.random() < 0.8):
            bins.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    noise = rng.random(len(size)) * 0.1 * rng.random() + 1
    return Packing(best_fit(bins, sorted(displaced, key=lambda i: -size[i] * noise[i]), size, room), size, room)


def evolve(size: list[int], room: int, cfg: PackConfig, seed: int, guests: list[np.ndarray]) -> Packing:
    """The best of an island's population; ``guests`` are other islands' elites, as assignments."""
    rng = np.random.default_rng(seed)
    least = -(-sum(size) // room)
    people = []
    for g in guests:
        bins: list[list[int]] = [[] for _ in range(int(g.max()) + 1)]
        for i, k in enumerate(g):
            bins[k].append(i)
        people.append(Packing(bins, size, room))
    while len(people) < cfg.population:
        noise = 1 + 0.2 * rng.random(len(size)) * (len(people) > 0)
        people.append(Packing(best_fit([], sorted(range(len(size)), key=lambda i: -size[i] * noise[i]), size, room), size, room))
    for _ in range(cfg.generations):
        people.sort(key=lambda p: p.fitness, reverse=True)
        if -people[0].fitness[0] == least and sum(f < room - cfg.slack for f in people[0].fill) <= 1:
            break
        people = people[: cfg.population]
        people += [crossover(people[a], people[b], size, room, rng) for a, b in (rng.permutation(len(people))[:2] for _ in range(cfg.population)) if a != b]
    return max(people, key=lambda p: p.fitness)


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)


def _packed(pieces: DataFrame, blocks: int, left: int, cfg: PackConfig, turn: int) -> DataFrame:
    """PIECE rows with sequence_id, offset and the bin's free tokens. Pieces with a PLACE are dealt by it, ``left``
    of them in runs of equal size, others by their hash."""
    place = [c for c in PLACE if c in pieces.columns]
    if place:
        runs = numbered(pieces, "block", "piece").withColumn("block", F.floor(F.col("block") * blocks / left).cast("long"))
        dealt = materialize(runs.select(*pieces.columns, "block"), "dealt")
    else:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(blocks)))
    isles = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(cfg.islands - 1))))
    elite = "block long, island int, bins int, filled double, assigned array<int>"

    def row(frame: pd.DataFrame, guests: list[np.ndarray], epoch: int) -> pd.DataFrame:
        block, island = int(frame["block"].iloc[0]), int(frame["island"].iloc[0])
        size = _ordered(frame)["length"].tolist()
        best = evolve(size, cfg.length, cfg, hash((cfg.seed, turn, block, island, epoch)) & 0xFFFFFFFF, guests)
        give_back()  # Spark uses the worker again, and keeps it idle through the stages that follow
        return pd.DataFrame({"block": [block], "island": [island], "bins": [len(best.bins)], "filled": [best.fitness[1]], "assigned": [best.assignment(len(size))]})

    def meeting(epoch: int):
        return lambda frame, guests: row(frame, [np.asarray(g) for g in guests["assigned"]], epoch)

    elites = isles.groupBy("block", "island").applyInPandas(lambda frame: row(frame, [], 0), elite)
    for epoch in range(1, cfg.epochs):
        elites = materialize(elites, "elites")
        migrants = elites.select("block", "assigned", F.explode(F.sequence(F.lit(0), F.lit(cfg.islands - 1))).alias("island")).toDF("b", "assigned", "i")
        elites = isles.groupBy("block", "island").cogroup(migrants.groupBy("b", "i")).applyInPandas(meeting(epoch), elite)
    elites = materialize(elites, "elites")
    best = elites.groupBy(F.col("block").alias("b")).agg(F.max_by("assigned", F.struct(-F.col("bins"), "filled", -F.col("island"))).alias("assigned"))

    def settle(frame: pd.DataFrame, winner: pd.DataFrame) -> pd.DataFrame:
        out = _ordered(frame)
        bins = np.asarray(winner["assigned"].iloc[0])
        out["sequence_id"] = (turn << 52) + out["block"] * (1 << 20) + bins
        if place:
            out = out.sort_values([*place, "piece"], kind="stable")
        out["offset"] = out.groupby("sequence_id")["length"].cumsum() - out["length"]
        out["free"] = cfg.length - out.groupby("sequence_id")["length"].transform("sum")
        give_back()
        return out.drop(columns="block")

    form = PIECE + "".join(f", {c} long" for c in place) + ", sequence_id long, offset long, free long"
    return dealt.groupBy("block").cogroup(best.groupBy("b")).applyInPandas(settle, form)


def pack(docs: DataFrame, tokenizer: str, cfg: PackConfig | None = None, by_word: bool = True, text: str = "text", id_col: str = "doc_id", order: tuple[Column, Column] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    ``order``: two whole numbers that order the rows, their part and the row in it; no part may have more rows than one
    task sorts. Sequences are then made of neighbours, but for pieces of slack bins, and are numbered from 0 by the
    place of their first piece.

    A null text counts as empty and is one piece of one token, the end id. Only documents longer than a sequence
    are cut. Rows that repeat an id, or have none, are packed like others. An empty table gives no rows; other
    columns are ignored."""
    cfg = cfg or PackConfig()
    pool = materialize(pieces_of(docs, tokenizer, cfg.length, by_word, text, id_col, order), "pieces")
    whole = pool.where(F.col("length") >= cfg.length)
    done = [whole.withColumn("sequence_id", (F.lit(1 << 60) + F.monotonically_increasing_id())).withColumn("offset", F.lit(0).cast("long"))]
    pool = pool.where(F.col("length") < cfg.length)
    turn, left, slack = 1, pool.count(), cfg.slack
    while left:
        blocks = -(-left // cfg.block)
        result = materialize(_packed(pool, blocks, left, cfg, turn), f"packed-{turn}")
        if blocks == 1:
            done.append(result.drop("free"))
            break
        while (unsettled := result.where(F.col("free") > slack).count()) > 0.9 * left:
            slack *= 8  # hardly a bin is full (documents of like length): only emptier ones are pooled
        done.append(result.where(F.col("free") <= slack).drop("free"))
        pool, left, turn = result.where(F.col("free") > slack).drop("sequence_id", "offset", "free"), unsettled, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    if order:
        out = _in_order(out)
    return out.withColumnRenamed("doc_id", id_col)


def _in_order(packed: DataFrame) -> DataFrame:
    """Sequences numbered from 0 in the order of their first pieces, instead of their old ids."""
    packed = materialize(packed, "packed")
    first = packed.where(F.col("offset") == 0).select("part", "row", "piece", "sequence_id")
    ids = materialize(numbered(first, "number", "piece").select("sequence_id", "number"), "numbers")
    return packed.drop(*PLACE).join(ids, "sequence_id").withColumn("sequence_id", F.col("number")).drop("number")


def op5_ga_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizer())
