"""MinHash near-duplicate detection with SetSketch registers.

1. ``sketch``: each document's set of word shingles becomes ``m`` registers. A register is the minimum of an
   exponential variate over the set, truncated to exponentially spaced levels (SetSketch, Ertl 2021); registers
   merge by the larger level, and two sets agree in a register about as often as their Jaccard similarity.
2. Documents with equal sets form one class, linked without comparison; the rest works on one representative.
3. ``band``: ``rows`` registers at a time form a key; classes that share a key are candidates. Keys with few
   classes give their pairs. A key with many classes gives only the links to its smallest one; those links make
   groups; the members of a group are compared with its smallest one, and those that aren't linked with it block
   against block inside tasks, which emit a spanning forest of verified links and never the pairs.
4. A candidate is kept if the joint likelihood of the two sketches doesn't rule the threshold out, and is then
   confirmed on the full sets.
5. Connected components of the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, frugal, give_back, hash_words, join_heavy_apart, materialize, mix, slices, split_words
from .graph import connected_components


@dataclass(frozen=True)
class NearDedupConfig:
    """``percent``: link when 100 * |A and B| >= percent * |A or B|. 26 bands of 5 registers miss a pair at
    similarity 0.85 with probability 3e-7, at 0.8 with 4e-5. ``slack``: log-likelihood by which the threshold
    must be worse than the best estimate before a pair is ruled out (18: six standard deviations). ``small_bucket``:
    keys with more classes than this don't give pairs. ``block_bytes``, ``block_rows``: hashes and rows of a group's
    block, about."""

    shingle: int = 5
    percent: int = 80
    bands: int = 26
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    levels: int = 65534
    slack: float = 18.0
    small_bucket: int = 4
    block_bytes: int = 4 << 20
    block_rows: int = 1000
    seed: int = 7

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingle_hashes(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text. A text with fewer words is one shingle;
    a null text or one without words has none."""
    offsets, flat = split_words(texts)
    words = hash_words(flat)
    rolled = np.zeros(max(0, len(words) - k + 1), U64)
    for i in range(k):
        rolled = mix(rolled ^ (words[i : i + len(rolled)] + U64(i + 1)))
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes())], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


class SetSketch:
    """Registers of a set of 64-bit hashes; levels as 16-bit integers."""

    def __init__(self, cfg: NearDedupConfig):
        rng = np.random.default_rng(cfg.seed)
        self.cfg = cfg
        self.a = rng.integers(0, 2**63, cfg.registers, dtype=np.uint64) * U64(2) + U64(1)
        self.b = rng.integers(0, 2**63, cfg.registers, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(self.cfg.registers, np.iinfo(np.uint64).max, U64)
        for i in range(0, len(hashes), 2048):
            low = np.minimum(low, (hashes[i : i + 2048, None] * self.a + self.b).min(axis=0))
        x = -np.log1p(-((low.astype(np.float64) + 0.5) / 2.0**64).clip(max=1 - 1e-16)) / self.cfg.rate
        return np.floor(1 - np.log(x) / np.log(self.cfg.base)).clip(0, self.cfg.levels + 1).astype(np.uint16)

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(a, b)

    def band_keys(self, registers: np.ndarray) -> list[int]:
        r = self.cfg.rows
        return [np.array(xxhash.xxh3_64_intdigest(registers[i * r : (i + 1) * r].tobytes(), seed=i), U64).astype(np.int64).item() for i in range(self.cfg.bands)]


def plausible(cfg: NearDedupConfig, n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joint maximum-likelihood similarity of pairs of sketches, and whether it leaves the threshold possible.

    ``more`` and ``less`` count the registers in which the first sketch is above and below the second; with the
    known set sizes they are multinomial with probabilities that depend on the similarity alone."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    edge = cfg.percent / 100
    equal = cfg.registers - more - less
    near = (equal / cfg.registers)[:, None] + np.linspace(-0.08, 0.08, 9)[None, :]  # the maximum is close to the share of equal registers
    grid = np.column_stack([near.clip(0.001, 0.999), np.full(len(more), edge)])
    best = np.minimum(grid, np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (cfg.base - 1) / cfg.base) / np.log(cfg.base)
    up, down = p(u - v * best), p(v - u * best)
    same = np.clip(1 - up - down, 1e-12, 1)
    fit = more[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(same)
    top = fit.argmax(axis=1)
    estimate = best[np.arange(len(top)), top]
    by_size = 100 * np.minimum(n_a, n_b) >= cfg.percent * np.maximum(n_a, n_b)
    return estimate, by_size & ((fit[:, -1] >= fit.max(axis=1) - cfg.slack) | (estimate >= edge))


def linked(cfg: NearDedupConfig, a: np.ndarray, b: np.ndarray) -> bool:
    """The exact rule on two sorted distinct hash arrays."""
    both = len(a) + len(b)
    common = both - len(np.unique(np.concatenate([a, b])))
    return 100 * common >= cfg.percent * (both - common)


def sketch(docs: DataFrame, cfg: NearDedupConfig, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n, print, regs, bands) of every document; ``print`` is a 128-bit fingerprint of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = SetSketch(cfg)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_hashes(part.column("text"), cfg.shingle)
                regs = [sketcher(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([None if r is None else r.tobytes() for r in regs], pa.binary()),
                        pa.array([None if r is None else sketcher.band_keys(r) for r in regs], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "print", "regs", "bands"],
                )

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(frugal(run), "id long, n long, print binary, regs binary, bands array<long>")


def _estimated(pairs: DataFrame, classes: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """The pairs (a, b) that the joint likelihood leaves possible."""
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"r_{s}"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 4096):
                f = frame.iloc[at : at + 4096]
                x, y = (np.frombuffer(b"".join(f[c]), np.uint16).reshape(len(f), -1) for c in ("r_a", "r_b"))
                _, keep = plausible(cfg, f["n_a"].to_numpy(), f["n_b"].to_numpy(), (x > y).sum(axis=1), (x < y).sum(axis=1))
                yield f.loc[keep, ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(frugal(run), "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, cfg: NearDedupConfig, text: str, id_col: str) -> DataFrame:
    """(rep, hashes): the full sets of the representatives in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_hashes(part.column("text"), cfg.shingle)
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "hashes"])

    narrow = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text).cast("string").alias("text"))
    return narrow.join(wanted, "rep", "left_semi").mapInArrow(frugal(run), "rep long, hashes binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [linked(cfg, np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) for x, y in zip(batch.column("h_a"), batch.column("h_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    side = lambda s: sets.select(F.col("rep").alias(s), F.col("hashes").alias(f"h_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "h_a", "h_b").mapInArrow(frugal(run), "a long, b long")


def _forest(cfg: NearDedupConfig, left: pd.DataFrame, right: pd.DataFrame, same: bool, hub: int | None = None) -> list[tuple[int, int]]:
    """What confirmed links join between two blocks (or inside one), as (member, smallest member joined with it).
    Goes row by row and holds the candidates of that row only; pairs that are joined already aren't looked at. With
    ``hub`` the right block's rows are all joined with that member before."""
    regs = [np.stack([np.frombuffer(r, np.uint16) for r in side["regs"]]) for side in (left, right)]
    sizes = [side["n"].to_numpy() for side in (left, right)]
    ids = [side["rep"].to_numpy() for side in (left, right)]
    sets = [[np.frombuffer(h, U64) for h in side["hashes"]] for side in (left, right)]
    roots = [ids[0].copy()] * 2 if same else [ids[0].copy(), ids[1].copy() if hub is None else np.full(len(right), hub)]
    edge = cfg.percent / 100
    least = cfg.registers * (edge - 7 * np.sqrt(edge * (1 - edge) / cfg.registers))  # seven standard deviations
    for i in range(len(left)):
        at = np.arange(i + 1 if same else 0, len(right))
        at = at[roots[1][at] != roots[0][i]]
        if not len(at):
            continue
        more, less = (regs[0][i] > regs[1][at]).sum(axis=1), (regs[0][i] < regs[1][at]).sum(axis=1)
        near = np.flatnonzero(cfg.registers - more - less >= least)
        if not len(near):
            continue
        estimate, keep = plausible(cfg, np.full(len(near), sizes[0][i]), sizes[1][at[near]], more[near], less[near])
        for j in at[near][keep][np.argsort(-estimate[keep], kind="stable")]:
            a, b = roots[0][i], roots[1][j]
            if a != b and linked(cfg, sets[0][i], sets[1][j]):
                for side in roots:
                    side[side == max(a, b)] = min(a, b)
    seen = slice(2) if hub is None else slice(1)
    both = dict(zip(np.concatenate(ids[seen]).tolist(), np.concatenate(roots[seen]).tolist(), strict=True))
    return [(x, r) for x, r in both.items() if r != x]


def _cut(members: DataFrame, cfg: NearDedupConfig, name: str) -> DataFrame:
    """``members`` with their group's number of blocks of about ``cfg.block_bytes`` or ``cfg.block_rows``, whichever is
    less, and the block they are in."""
    sizes = F.ceil(F.greatest(8 * F.sum("n") / cfg.block_bytes, F.count(F.lit(1)) / cfg.block_rows)).cast("int")
    blocks = members.groupBy("grp").agg(sizes.alias(f"{name}s"))
    return members.join(blocks, "grp").withColumn(name, F.pmod(F.xxhash64("rep"), F.col(f"{name}s")).cast("int"))


def _within_groups(members: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """Links inside large groups, a spanning forest of them. ``members(grp, rep, n, regs, hashes)``; ``grp`` is the
    smallest rep of the group, its hub.

    Every member is compared with the hub first, which settles a group of near copies in linear time. Those that
    aren't linked with it are compared with one another and with the settled ones, block against block, so that no
    task holds more than two blocks; settled members are never compared with each other."""
    members, columns = materialize(members, "members"), ["rep", "n", "regs", "hashes"]
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    def with_hub(frame: pd.DataFrame) -> pd.DataFrame:
        hub = int(frame["grp"].iloc[0])
        left, right = frame[frame["rep"] != hub], frame[frame["rep"] == hub]
        found = _forest(cfg, left, right, False, hub) if len(left) else []
        if len(frame) > 500:
            give_back()
        return pd.DataFrame(found, columns=["a", "b"])

    cut = _cut(members, cfg, "blk")
    hubs = cut.where("rep = grp").select("grp", *columns, every("blks").alias("blk"))
    stars = materialize(cut.where("rep <> grp").select("grp", *columns, "blk").unionByName(hubs).groupBy("grp", "blk").applyInPandas(with_hub, "a long, b long"), "stars")

    rest = _cut(members.where("rep <> grp").join(stars.select(F.col("a").alias("rep")), "rep", "left_anti").select("grp", *columns), cfg, "blk")
    open_ = materialize(rest.select("grp", "rep", "blk", "blks"), "open")
    rest = members.join(open_.select("rep", "blk", "blks"), "rep").select("grp", *columns, "blk", "blks")
    groups = open_.select("grp", "blks").distinct()
    settled = _cut(members.join(open_.select("rep"), "rep", "left_anti").join(groups.select("grp"), "grp", "left_semi").select("grp", *columns), cfg, "s")
    among = rest.select("grp", *columns, "blk", every("blks").alias("other")).select("grp", F.lit(False).alias("to_hub"), F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), (F.col("blk") == F.least("blk", "other")).alias("is_left"), *columns)
    to_left = rest.join(settled.select("grp", "ss").distinct(), "grp").select("grp", F.lit(True).alias("to_hub"), F.col("blk").alias("p"), every("ss").alias("q"), F.lit(True).alias("is_left"), *columns)
    to_right = settled.join(groups, "grp").select("grp", F.lit(True).alias("to_hub"), every("blks").alias("p"), F.col("s").alias("q"), F.lit(False).alias("is_left"), *columns)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = (frame[frame["is_left"] == x].sort_values("rep") for x in (True, False))
        if frame["to_hub"].iloc[0]:
            found = _forest(cfg, left, right, False, int(frame["grp"].iloc[0])) if len(left) and len(right) else []
        elif frame["p"].iloc[0] == frame["q"].iloc[0]:
            found = _forest(cfg, left, left, True)
        else:
            found = _forest(cfg, left, right, False) if len(left) and len(right) else []
        if len(frame) > 500:
            give_back()
        return pd.DataFrame(found, columns=["a", "b"])

    pairs = among.unionByName(to_left).unionByName(to_right).groupBy("grp", "to_hub", "p", "q").applyInPandas(run, "a long, b long")
    return stars.unionAll(pairs)


def near_duplicates(docs: DataFrame, cfg: NearDedupConfig | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document.

    ``component_id`` is the smallest id reachable over links, the document itself included; ``kept`` marks the
    document with that id. Null and empty texts have no shingles and are linked with nothing; texts shorter than
    a shingle are one shingle; very long texts are read whole; repeated rows with other ids are linked. A row without
    an id is linked with equal sets only and stays unless one of them has an id. An empty table gives an empty result.
    Other columns of ``docs`` are ignored, whatever their names.

    A pair at the threshold shares no band with probability 3e-7 at 0.85 and 4e-5 at 0.8 (less above it); pairs that
    are candidates are ruled out unseen only where the likelihood ratio (``slack``, six standard deviations) or, inside
    groups, the number of equal registers (seven) excludes the threshold: with probability under 2e-9 and 2e-12.
    """
    cfg = cfg or NearDedupConfig()
    sketches = materialize(sketch(docs, cfg, text, id_col), "sketches")
    printed = sketches.where("print is not null").select("id", "n", "print")
    twins = materialize(printed.groupBy("print").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members")), "twins")
    same = join_heavy_apart(printed, twins.where("members > 1"), "print", "members", sketches.count()).select("id", "n", F.coalesce("rep", "id").alias("rep"))
    alone = printed.join(twins.where("members = 1").select("print"), "print", "left_semi")
    own = materialize(same.unionAll(alone.unionByName(sketches.where("print is null").select("print", "id", "n")).select("id", "n", F.col("id").alias("rep"))), "classes")
    classes = sketches.join(own.where("id = rep").select("id"), "id", "left_semi").where("n > 0").select(F.col("id").alias("rep"), "n", "regs", "bands")

    keys = classes.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("first")).where("size > 1")
    inside = materialize(join_heavy_apart(keys, materialize(buckets, "sizes"), "key", "size", keys.count()).select("rep", "key", "size", "first"), "buckets")
    stars = inside.where((F.col("size") > cfg.small_bucket) & (F.col("rep") > F.col("first"))).select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    groups = materialize(connected_components(stars, "groups").select(F.col("node").alias("rep"), F.col("component").alias("grp")), "groups")

    small = inside.where(F.col("size") <= cfg.small_bucket).groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("reps"))
    pairs = small.select("reps", F.posexplode("reps").alias("i", "a")).select("a", F.explode(F.expr("slice(reps, i + 2, size(reps))")).alias("b")).distinct()
    grp = lambda s: groups.select(F.col("rep").alias(s), F.col("grp").alias(f"g_{s}"))
    apart = pairs.join(grp("a"), "a", "left").join(grp("b"), "b", "left").where("not (g_a <=> g_b) or g_a is null").select("a", "b")
    likely = materialize(_estimated(apart, classes, cfg), "likely")

    wanted = likely.select(F.col("a").alias("rep")).unionAll(likely.select(F.col("b").alias("rep"))).unionAll(groups.select("rep")).distinct()
    sets = materialize(_sets(docs, wanted, cfg, text, id_col), "sets")
    members = groups.join(classes.select("rep", "n", "regs"), "rep").join(sets, "rep")
    links = _confirmed(likely, sets, cfg).unionAll(_within_groups(members, cfg))
    components = connected_components(links, "links").select(F.col("node").alias("rep"), "component")
    return (
        own.join(components, "rep", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """3-word shingles, links at 0.85, over all documents."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), NearDedupConfig(shingle=3, percent=85))
