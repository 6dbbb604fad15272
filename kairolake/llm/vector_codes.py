"""Vector code compression: dual-tree Lloyd on integer parts.

Vectors become integers, floor(1024 x), and are cut into parts; each part position has a codebook that rounds of Lloyd
improve. Rows are stored once as blocks: for each part position a tree over the block's rows (median splits along the
widest dimension, so that the tree is the rows' order) with its nodes' boxes and sums. A round sends the codebooks,
with a tree over their entries, to the tasks. Pairs of a row node and an entry node go down both trees together; a pair
whose boxes are farther apart than some entry node can be at most is pruned, a row node that keeps one entry is
assigned as a whole from its cached sums, and what stays uncertain at the leaves is decided by exact integer distances
(ties to the lower index). A task returns sums and counts by part and entry, however many rows it has.

Everything is whole numbers: sums don't depend on their order, so the result is the same on any cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, bounded_batches, frugal, join_heavy_apart, materialize, table

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Bytes of a block's components (at 4 bytes), and rows of a leaf.
BLOCK_BYTES, LEAF = 1 << 20, 16
#: Entries of a leaf of the codebook's tree, and levels above the leaves whose entries are compared together.
ENTRY_LEAF, TOGETHER = 1, 3


#: Beyond any component, for boxes of empty nodes.
_FAR = (1 << 31) - 1


def limit(dim: int) -> int:
    """Scaled components of vectors of this length lie within ± this power of two, so that squared distances of whole
    vectors fit 63 bits: ±131,072 before scaling for 64 components."""
    return 1 << min(30, (62 - max(0, dim - 1).bit_length()) // 2 - 1)


class Tree(NamedTuple):
    """A complete binary tree over rows: node 1 is the root, i has the children 2i and 2i + 1, the last level holds the
    leaves. Leaf j has the rows ``cuts[j]`` to ``cuts[j + 1]`` of the order."""

    order: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    counts: np.ndarray


def _grown(values: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cuts): halves along the widest dimension, level by level, down to at most ``leaf`` rows."""
    n = len(values)
    levels = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    order, cuts = np.arange(n), np.array([0, n])
    for _ in range(levels):
        middle = (cuts[:-1] + cuts[1:]) // 2
        for a, m, b in zip(cuts[:-1].tolist(), middle.tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                own = values[order[a:b]]
                widest = np.argmax(own.max(0) - own.min(0))
                order[a:b] = order[a:b][np.argpartition(own[:, widest], m - a)]
        cuts = np.sort(np.concatenate([cuts, middle]))
    return order, cuts


def _boxes(values: np.ndarray, order: np.ndarray, cuts: np.ndarray) -> Tree:
    """The tree with its boxes and sums, from the leaves up. Boxes of empty nodes are inverted."""
    leaves = len(cuts) - 1
    width = values.shape[1]
    low, high = np.full((2 * leaves, width), _FAR, np.int64), np.full((2 * leaves, width), -_FAR, np.int64)
    sums, counts = np.zeros((2 * leaves, width), np.int64), np.zeros(2 * leaves, np.int64)
    counts[leaves:] = np.diff(cuts)
    full = np.flatnonzero(counts[leaves:])
    if len(full):
        placed, starts = values[order].astype(np.int64), cuts[:-1][full]
        low[leaves + full], high[leaves + full] = np.minimum.reduceat(placed, starts), np.maximum.reduceat(placed, starts)
        sums[leaves + full] = np.add.reduceat(placed, starts)
    first = leaves
    while first > 1:
        a, b, mine = np.s_[first : 2 * first : 2], np.s_[first + 1 : 2 * first : 2], np.s_[first // 2 : first]
        low[mine], high[mine] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
        sums[mine], counts[mine] = sums[a] + sums[b], counts[a] + counts[b]
        first //= 2
    return Tree(order, cuts, low, high, sums, counts)


def tree_over(values: np.ndarray, leaf: int) -> Tree:
    return _boxes(values, *_grown(values, leaf))


def _pair_bounds(rows: Tree, entries: Tree, r: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most squared distance between the boxes of row nodes ``r`` and entry nodes ``e``."""
    a, b = entries.low[e] - rows.high[r], rows.low[r] - entries.high[e]  # gaps on either side
    least, most = np.maximum(np.maximum(a, b), 0), np.maximum(-a, -b)
    return np.einsum("ij,ij->i", least, least), np.einsum("ij,ij->i", most, most)


def _exact(points: np.ndarray, norms: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, exactly: as doubles where every sum stays below 2^53, else as integers."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * points.shape[1] < 1 << 53:
        e = entries.astype(np.float64)
        return (norms[:, None] - 2 * (points.astype(np.float64) @ e.T) + np.einsum("ij,ij->i", e, e)).astype(np.int64)
    wide = entries.astype(np.int64)
    return norms[:, None] - 2 * (points.astype(np.int64) @ wide.T) + np.einsum("ij,ij->i", wide, wide)


class Assignment(NamedTuple):
    """What a block's rows are assigned to: nodes as a whole, and single rows (in tree order) with their entries."""

    nodes: np.ndarray
    node_entries: np.ndarray
    rows: np.ndarray
    row_entries: np.ndarray
    pairs: int


def dual_tree(rows: Tree, points: np.ndarray, entries: Tree, codebook: np.ndarray) -> Assignment:
    """The nearest entry of every row, by descending both trees. ``points`` are the rows in tree order."""
    leaves, entry_leaves = len(rows.cuts) - 1, len(entries.cuts) - 1
    r, e = np.array([1]), np.array([1])
    nodes, node_entries, compared = [], [], 0
    while len(r):
        least, most = _pair_bounds(rows, entries, r, e)
        compared += len(r)
        bound = np.full(2 * leaves, np.iinfo(np.int64).max)
        np.minimum.at(bound, r, most)
        keep = least <= bound[r]  # equal ones stay: a tie goes to the lower index
        r, e = r[keep], e[keep]
        # a row node that keeps a single entry is assigned as a whole
        alone = (np.bincount(r, minlength=2 * leaves)[r] == 1) & (entries.counts[e] == 1)
        if alone.any():
            nodes.append(r[alone])
            node_entries.append(_single(entries, e[alone]))
            r, e = r[~alone], e[~alone]
        down_r, down_e = r < leaves, e < entry_leaves
        if not (down_r.any() or down_e.any()):
            break
        r, e, down_r, down_e = (np.repeat(x, 2) for x in (r, e, down_r, down_e))
        second = np.arange(len(e)) & 1
        e = np.where(down_e, 2 * e + second, e)
        keep = (down_e | (second == 0)) & (entries.counts[e] > 0)
        r, e, down_r = r[keep], e[keep], down_r[keep]
        r, e, down_r = (np.repeat(x, 2) for x in (r, e, down_r))
        second = np.arange(len(r)) & 1
        r = np.where(down_r, 2 * r + second, r)
        keep = (down_r | (second == 0)) & (rows.counts[r] > 0)
        r, e = r[keep], e[keep]
    picked, chosen = _uncertain(rows, points, entries, codebook, r, e)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Assignment(join(nodes), join(node_entries), picked, chosen, compared)


def _single(entries: Tree, e: np.ndarray) -> np.ndarray:
    """The one entry of each entry node ``e``."""
    leaves = len(entries.cuts) - 1
    at = e.copy()
    while (at < leaves).any():
        inner = at < leaves
        left = entries.counts[np.where(inner, 2 * at, 0)] == 1
        at = np.where(inner, 2 * at + ~left, at)
    return entries.order[entries.cuts[at - leaves]]


def _uncertain(rows: Tree, points: np.ndarray, entries: Tree, codebook: np.ndarray, r: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the leaves ``r`` against the entries of the leaves ``e`` that they keep, by integer distances."""
    leaves, entry_leaves = len(rows.cuts) - 1, len(entries.cuts) - 1
    if not len(r):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = points.astype(np.int64)
    norms = np.einsum("ij,ij->i", wide, wide)
    best, entry = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(codebook))
    # entries of a small subtree go together, also those that a row's leaf has pruned: they can't be nearer
    pairs = np.unique(((e - entry_leaves) >> TOGETHER) * leaves + r - leaves)
    e, r = np.divmod(pairs, leaves)
    starts = np.flatnonzero(np.diff(e, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(e)], strict=True):
        first, sizes = rows.cuts[r[a:b]], np.diff(rows.cuts)[r[a:b]]
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        lo, hi = e[a] << TOGETHER, min((e[a] + 1) << TOGETHER, entry_leaves)
        own = np.sort(entries.order[entries.cuts[lo] : entries.cuts[hi]])  # argmin takes the lower index
        d = _exact(points[at], norms[at], codebook[own])
        nearest = d.argmin(1)
        d, own = d[np.arange(len(at)), nearest], own[nearest]
        better = (d < best[at]) | ((d == best[at]) & (own < entry[at]))
        best[at[better]], entry[at[better]] = d[better], own[better]
    picked = np.flatnonzero(entry < len(codebook))
    return picked, entry[picked]


def _totals(rows: Tree, points: np.ndarray, found: Assignment, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the rows assigned to each entry; nodes bring their cached sums."""
    width = points.shape[1]
    sums, counts = np.zeros((entries, width), np.int64), np.bincount(found.row_entries, minlength=entries)
    np.add.at(sums, found.node_entries, rows.sums[found.nodes])
    np.add.at(counts, found.node_entries, rows.counts[found.nodes])
    if len(found.rows):
        by_entry = np.argsort(found.row_entries, kind="stable")
        starts = np.flatnonzero(np.diff(found.row_entries[by_entry], prepend=-1))
        sums[found.row_entries[by_entry][starts]] += np.add.reduceat(points[found.rows[by_entry]].astype(np.int64), starts)
    return sums, counts


def _codes(rows: Tree, points: np.ndarray, found: Assignment, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row, in the order of the block."""
    leaves = len(rows.cuts) - 1
    entry = np.zeros(len(points), np.int64)
    entry[found.rows] = found.row_entries
    for node, own in zip(found.nodes.tolist(), found.node_entries.tolist(), strict=True):
        a, b = node, node
        while a < leaves:
            a, b = 2 * a, 2 * b + 1
        entry[rows.cuts[a - leaves] : rows.cuts[b - leaves + 1]] = own
    apart = points.astype(np.int64) - codebook[entry]
    out_entry, out_d = np.empty_like(entry), np.empty_like(entry)
    out_entry[rows.order], out_d[rows.order] = entry, np.einsum("ij,ij->i", apart, apart)
    return out_entry, out_d


_TREE = [("order", "<i4"), ("cuts", "<i4"), ("low", "<i4"), ("high", "<i4"), ("sums", "<i8"), ("points", "<i4")]
BLOCK = "ids array<long>, labels array<long>, " + ", ".join(f"{c} array<binary>" for c, _ in _TREE)


def part_bounds(dim: int, parts: int) -> list[int]:
    """Where the parts begin and end; a length that isn't a multiple gives the first parts one component more."""
    return np.cumsum([0, *(dim // parts + (i < dim % parts) for i in range(parts))]).tolist()


def store_blocks(vectors: DataFrame, dim: int, parts: int) -> DataFrame:
    """Blocks of (id, label, vector) with a tree for each part position, written once."""
    bounds, top = part_bounds(dim, parts), limit(dim)
    most = max(LEAF, BLOCK_BYTES // (4 * dim))

    def block(ids: list, labels: list, values: list) -> pa.RecordBatch:
        flat = np.concatenate(values)
        trees = {c: [] for c, _ in _TREE}
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = np.ascontiguousarray(flat[:, a:b])
            t = tree_over(own, LEAF)
            for c, kind in _TREE:
                trees[c].append((own[t.order] if c == "points" else getattr(t, c)).astype(kind).tobytes())
        columns = [pa.array([pa.concat_arrays(x).to_pylist()], pa.list_(pa.int64())) for x in (ids, labels)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([trees[c]], pa.list_(pa.binary())) for c, _ in _TREE)], names=["ids", "labels", *(c for c, _ in _TREE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, values, held = [], [], [], 0
        for batch in batches:
            vector = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            whole = np.clip(np.floor(vector * SCALE), -top, top).astype(np.int32)
            at = 0
            while at < batch.num_rows:
                take = min(most - held, batch.num_rows - at)
                ids.append(batch.column("id").slice(at, take))
                labels.append(batch.column("label").slice(at, take))
                values.append(whole[at : at + take])
                at, held = at + take, held + take
                if held == most:
                    yield block(ids, labels, values)
                    ids, labels, values, held = [], [], [], 0
        if held:
            yield block(ids, labels, values)

    return materialize(vectors.mapInArrow(frugal(run), BLOCK), "blocks")


def _opened(batch: pa.RecordBatch, row: int, part: int, width: int) -> tuple[Tree, np.ndarray]:
    """A part position's tree and its rows in tree order, from a stored block."""
    got = {c: np.frombuffer(batch.column(c)[row][part].as_buffer(), kind) for c, kind in _TREE}
    wide = lambda c: got[c].reshape(-1, width).astype(np.int64)
    cuts = got["cuts"].astype(np.int64)
    leaves = len(cuts) - 1
    counts = np.zeros(2 * leaves, np.int64)
    counts[leaves:] = np.diff(cuts)
    first = leaves
    while first > 1:
        counts[first // 2 : first] = counts[first : 2 * first : 2] + counts[first + 1 : 2 * first : 2]
        first //= 2
    return Tree(got["order"].astype(np.int64), cuts, wide("low"), wide("high"), wide("sums"), counts), got["points"].reshape(-1, width)


def first_books(vectors: DataFrame, dim: int, parts: int, entries: int) -> list[np.ndarray]:
    """Codebooks from the rows with the ``entries`` smallest ids (equal ids by their vectors), null ids last."""
    first = vectors.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    flat = np.clip(np.floor(np.array([r["vector"] for r in first], np.float64).reshape(-1, dim) * SCALE), -limit(dim), limit(dim)).astype(np.int64)
    bounds = part_bounds(dim, parts)
    return [np.ascontiguousarray(flat[:, a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def lloyd_round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The next codebooks: each entry becomes the floor of the mean of its rows, unused entries stay."""
    width = max(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree_over(b, ENTRY_LEAF) for b in books]
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                for i, book in enumerate(books):
                    rows, points = _opened(batch, row, i, book.shape[1])
                    s, n = _totals(rows, points, dual_tree(rows, points, trees[i], book), len(book))
                    sums[i] += s
                    counts[i] += n
        for i, book in enumerate(books):
            used = np.flatnonzero(counts[i])
            padded = np.zeros((len(used), width), np.int64)
            padded[:, : book.shape[1]] = sums[i][used]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[i][used]), pa.array(list(padded), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    partial = blocks.mapInArrow(frugal(run), "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = [b.copy() for b in books]
    for row in total.collect():  # one row for each part and entry
        book = out[row["part"]]
        book[row["entry"]] = np.array(row["sums"][: book.shape[1]], np.int64) // row["n"]
    return out


def encode(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree_over(b, ENTRY_LEAF) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                entry, error = [], 0
                for i, book in enumerate(books):
                    rows, points = _opened(batch, row, i, book.shape[1])
                    own, d = _codes(rows, points, dual_tree(rows, points, trees[i], book), book)
                    entry.append(own)
                    error = error + d
                codes = np.stack(entry, 1).astype(np.uint8).tobytes().hex()
                step = 2 * len(books)
                columns = [batch.column("ids")[row].values, batch.column("labels")[row].values, pa.array([codes[a : a + step] for a in range(0, len(codes), step)]), pa.array(error)]
                for a in range(0, len(error), ARROW_ROWS):
                    yield pa.RecordBatch.from_arrays([c.slice(a, ARROW_ROWS) for c in columns], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(frugal(run), "id long, label long, code string, error long")


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding", id_col: str = "vec_id", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((id, code, error, label_error) of every usable row, codebooks).

    Rows whose vector is null, empty or holds null or non-finite components are left out, and so are those whose
    length isn't that of the kept row with the smallest id. Components beyond ``limit`` count as the limit (squared
    distances would not fit a long). Equal vectors get equal codes; rows that repeat an id have a row each; null ids come
    last in the first codebooks. Fewer rows than ``entries`` (256 at most) give so many entries, unused entries stay.
    ``label_error`` sums the errors of equal labels, nulls together (without such a column, of all rows; null if
    the sum doesn't fit a long). An empty
    table gives no rows and no codebooks; other columns are ignored.

    ``entries`` rows and the codebooks are all that reaches the driver."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    bounded_batches(spark)
    number = F.col(label).cast("long") if label in vectors.columns else F.lit(None).cast("long")
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    narrow = vectors.select(F.col(id_col).cast("long").alias("id"), number.alias("label"), F.col(vector).cast("array<double>").alias(vector)).where(F.coalesce(sound, F.lit(False)) & (F.size(vector) > 0)).withColumnRenamed(vector, "vector")
    least = narrow.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).first()
    if least is None:
        return narrow.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    dim = least["n"]
    usable = narrow.where(F.size("vector") == dim)
    books = first_books(usable, dim, parts, entries)
    blocks = store_blocks(usable, dim, parts)
    for _ in range(rounds):
        books = lloyd_round(blocks, books)
    coded = materialize(encode(blocks, books).withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit("null"))), "codes")
    sums = materialize(coded.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("holders")), "label_errors")
    joined = join_heavy_apart(coded, sums, "key", "holders", coded.count())
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 4 parts of 256 entries, 4 rounds."""
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(books_digest(books)))


def _sql() -> str:
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""d{i} as materialized (select row, part, entry, sum((p.v - b.v) * (p.v - b.v)) as d from p join b{i} b using (part, pos) group by row, part, entry),
        a{i} as materialized (select row, part, arg_min(entry, (d, entry)) as entry, min(d) as d from d{i} group by row, part)""")
        if i < ROUNDS:
            steps.append(f"""n{i} as (select part, entry, pos, sum(v) as s, count(*) as n from p join a{i} using (row, part) group by part, entry, pos),
        b{i + 1} as materialized (select part, entry, pos, cast(case when n is null then b.v else (s - ((s % n) + n) % n) // n end as bigint) as v from b{i} b left join n{i} using (part, entry, pos))""")
    return f"""
        with kept as (select vec_id, label, embedding, row_number() over (order by vec_id) as row from embeddings
                      where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        flat as (select row, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i, len(embedding) // {PARTS} as w from kept),
        p as materialized (select row, cast(i // w as int) as part, cast(i % w as int) as pos, cast(floor({SCALE} * cast(x as double)) as bigint) as v from flat),
        b0 as materialized (select part, cast(row - 1 as int) as entry, pos, v from p where row <= {ENTRIES}),
        {", ".join(steps)},
        c as (select row, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a{ROUNDS} group by row)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
               (select sha256(string_agg(cast(v as varchar), ',' order by part, entry, pos)) from b{ROUNDS}) as codebooks_sha256
        from c join kept using (row)"""


SQL = {"op11_vector_codes": _sql()}
