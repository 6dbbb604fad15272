"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

A node holds the documents of a region of the metadata space. Each round splits every node at its weighted median
(weight: bytes) along its widest dimension, until there are as many leaves as shards, so that a leaf reaches the
target bytes. Equal texts are one group: they take the coordinates of one agreed row of theirs, and a cut is one
place in the order (coordinate, text hash, id hash, id), so that a group lies together in every order. A median
that falls inside a group of at most a hundredth of its node's bytes moves to the group's nearer end; only a larger
group is cut, as the shards' bytes come first. To find the place, histograms narrow the place
down, each key until a bin holds one single value of it, until few enough rows are left to order them. Histograms are summed on the map side and have at
most ``BINS`` rows a node, however many documents there are; no row moves before the slots are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_heavy_apart, materialize, table

BINS = 4096
#: Rows that one window orders.
WINDOW_ROWS = 20_000
#: Share of a node's bytes up to which a group of equal texts isn't cut.
SNAP = 0.01
DIMS = ("d0", "d1", "d2")
KEYS = ("x", "h", "k")


def _rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    """A table of a few literal rows (one a node), as a plan without any data source."""
    fields = [f.split() for f in schema.split(", ")]
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields, strict=True)]) for row in values])))


def _unit(column: Column) -> Column:
    """A hash of the column as a double in [0, 1)."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _metadata(docs: DataFrame, text: str, id_col: str, source: str, lang: str) -> DataFrame:
    """Size, checksum and coordinates in [0, 1]: log length, source, language; nulls count as one value."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = F.octet_length(raw) + 1
    place = lambda c: _unit(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in docs.columns else F.lit(0.0)
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        size.cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        (F.log2(size.cast("double")) / 32).alias("d0"),
        place(source).alias("d1"),
        place(lang).alias("d2"),
        F.xxhash64(raw).alias("t"),
        _unit(raw).alias("h"),
        _unit(F.col(id_col).cast("long")).alias("k"),
    )


def _agreed(rows: DataFrame) -> DataFrame:
    """Equal texts with different metadata take the coordinates of the least of their rows."""
    groups = rows.groupBy("t").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("d1", "d2")).alias("least"), F.max(F.struct("d1", "d2")).alias("most"))
    apart = materialize(groups.where("least <> most").select("t", "members", F.col("least.d1").alias("g1"), F.col("least.d2").alias("g2")), "agreed")
    moved = join_heavy_apart(rows, apart, "t", "members", rows.count()).withColumns({"d1": F.col("g1"), "d2": F.col("g2")})
    return moved.select(*rows.columns).unionAll(rows.join(apart.select("t"), "t", "left_anti").select(*rows.columns))


def _plan(rows: DataFrame, share: dict[int, float]) -> list[tuple]:
    """(node, dim, bytes, low, high, want) of the nodes in ``share``: widest dimension, bytes to go below the cut."""
    stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[F.min(d).alias(f"{d}_lo") for d in DIMS], *[F.max(d).alias(f"{d}_hi") for d in DIMS])
    plan = []
    for row in stats.collect():  # one row a node, at most as many as shards
        dim = max(range(len(DIMS)), key=lambda i: row[f"{DIMS[i]}_hi"] - row[f"{DIMS[i]}_lo"])
        if row["node"] in share:
            plan.append((row["node"], dim, row["bytes"], row[f"{DIMS[dim]}_lo"], row[f"{DIMS[dim]}_hi"], row["bytes"] * share[row["node"]]))
    return plan


def _places(rows: DataFrame, plan: list[tuple]) -> list[tuple]:
    """(node, dim, x, h, k, id, below): the row at each cut, and whether it belongs below."""
    spark = rows.sparkSession
    nodes = {p[0]: p for p in plan}
    inside = rows.join(F.broadcast(_rows(spark, [p[:2] for p in plan], "node long, dim int")), "node").withColumn("x", F.element_at(F.array(*DIMS), F.col("dim") + 1))
    bounds = {p[0]: (0, p[3], p[4], p[5]) for p in plan}
    while bounds:
        table_ = F.broadcast(_rows(spark, [(n, key, float(lo), float(hi - lo) or 1.0, float(want)) for n, (key, lo, hi, want) in bounds.items()], "node long, key int, lo double, width double, want double"))
        at = inside.join(table_, "node").withColumn("at", F.element_at(F.array(*KEYS), F.col("key") + 1))
        binned = at.withColumn("bin", F.floor((F.col("at") - F.col("lo")) / F.col("width") * BINS).cast("int"))
        sums = binned.groupBy("node", "bin", "want").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
        upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        crossed = sums.withColumn("sum", F.sum("bytes").over(upto)).where("sum > want")
        found = crossed.groupBy("node").agg(F.min_by(F.struct("bin", "n", "lo", "hi", (F.col("want") - F.col("sum") + F.col("bytes")).alias("want")), "bin").alias("c")).collect()
        picked = _rows(spark, [(r["node"], r["c"]["bin"]) for r in found], "node long, bin int")
        inside = binned.drop("key", "at", "lo", "width", "want").join(F.broadcast(picked), ["node", "bin"]).drop("bin")
        last, bounds = bounds, {}
        few = True
        for node, c in found:
            key = last[node][0]
            single = c["lo"] == c["hi"]
            few = few and (c["n"] <= WINDOW_ROWS or (single and key == len(KEYS) - 1))
            bounds[node] = (key + 1, 0.0, 1.0, c["want"]) if single and key < len(KEYS) - 1 else (key, c["lo"], c["hi"], c["want"])
        if few:
            break
    # a bin of x or of h holds whole groups of equal texts; one of k doesn't
    wants = F.broadcast(_rows(spark, [(n, float(b[3]), nodes[n][2] * SNAP if b[0] < 2 else -1.0) for n, b in bounds.items()], "node long, want double, most double"))
    upto = Window.partitionBy("node").orderBy(*KEYS, "id").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("node", "x", "h")
    run = inside.withColumn("sum", F.sum("size").over(upto)).withColumn("all", F.sum("size").over(group)).withColumn("end", F.max("sum").over(group)).join(wants, "node").where("sum > want")
    key = F.struct(*KEYS, "id")
    first = run.groupBy("node").agg(F.min_by(F.struct(*KEYS, "id", "sum", "size", "all", "end", "want", "most"), key).alias("p"))
    out = []
    for node, p in first.collect():
        if p["all"] <= p["most"]:  # before or behind all of the group: k lies in [0, 1)
            below = p["end"] - p["want"] <= p["want"] - (p["end"] - p["all"])
            out.append((node, nodes[node][1], p["x"], p["h"], 2.0 if below else -1.0, 0, below))
        else:
            out.append((node, nodes[node][1], p["x"], p["h"], p["k"], p["id"], p["sum"] - p["size"] / 2 < p["want"]))
    return out


def _descend(rows: DataFrame, places: list[tuple]) -> DataFrame:
    """Node n becomes 2n below its cut and 2n + 1 above; nodes without a cut become 2n."""
    cuts = _rows(rows.sparkSession, places, "node long, dim int, cx double, ch double, ck double, cid long, below boolean")
    here = F.struct(F.element_at(F.array(*DIMS), F.col("dim") + 1).alias("x"), "h", "k", "id")
    cut = F.struct(F.col("cx").alias("x"), F.col("ch").alias("h"), F.col("ck").alias("k"), F.col("cid").alias("id"))
    above = F.when(F.col("dim").isNull(), False).when(F.col("below"), here > cut).otherwise(here >= cut)
    return rows.join(F.broadcast(cuts), "node", "left").withColumn("node", F.col("node") * 2 + above.cast("long")).select(*rows.columns)


def kd_shards(docs: DataFrame, shards: int = 16, text: str = "text", id_col: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Law ``bytes``: the shards' sizes are near equal (each cut is right to half a document, or to half a group of
    equal texts that isn't cut). Null texts are empty
    (size 1); null metadata is one value of its own; missing metadata columns count as constant; rows that repeat
    all columns share a place and stay together; very long texts count with all their bytes, rows without an id come
    first in a shard. ``slot`` numbers the rows of a shard from 0 without gaps.
    Fewer rows than shards leave shards empty; an empty table gives no rows; other columns are ignored."""
    base = materialize(_metadata(docs, text, id_col, source, lang).withColumn("node", F.lit(1).cast("long")), "metadata")
    base = materialize(_agreed(base).drop("t"), "coordinates")
    rows, leaves = base, {1: shards}
    while any(n > 1 for n in leaves.values()):
        plan = _plan(rows, {node: (n // 2) / n for node, n in leaves.items() if n > 1})
        if not plan:
            break
        rows = _descend(rows, _places(rows, plan))
        leaves = {child: n for node, k in leaves.items() for child, n in ((2 * node, max(1, k // 2)), (2 * node + 1, k - k // 2 if k > 1 else 0)) if n}
    numbers = _rows(docs.sparkSession, [(node, i) for i, node in enumerate(sorted(leaves))], "node long, shard int")
    placed = rows.join(F.broadcast(numbers), "node")

    blocks = F.greatest(F.lit(1), F.ceil(F.lit(base.count() / WINDOW_ROWS))).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    at = Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "size")
    return placed.withColumn("at", F.row_number().over(at)).join(bases, ["shard", "block"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards."""
    return kd_shards(table(spark, sf_dir, "documents"))
