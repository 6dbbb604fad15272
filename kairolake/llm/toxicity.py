"""Toxicity by class-conditional Kneser-Ney language models.

Words are spelled out: each class has an interpolated Kneser-Ney model of characters given the five before them
inside the word, so that inflected and compounded expressions are met too; a text's likelihood is that of its
words. Only the longest n-grams count documents (every word once a document, not once an occurrence). A shorter one
counts in how many contexts it was met, that is the distinct characters seen before it; only where it starts the word,
so that nothing can stand before it, its documents count. The counts of the long orders are a class's own, from every
labelled document that may be learnt from; they are discounted and back off to continuation counts of short orders
that both classes share and that are gathered from the whole corpus, so that what a class has hardly seen is judged
alike by both. A place with less before it than an order asks for begins at the order that it fills.

The counts are Spark aggregations and stay a distributed table that grows with the corpus. Up to
``broadcast_rows`` of them (counted first) are shipped to the tasks; beyond it the n-grams of the corpus' distinct
words are joined with the table instead. Both ways give the same scores.

A document's evidence is the length-normalised difference of its log-likelihoods under the two models, over the
whole text and over its strongest windows of words; a logistic curve fitted on labelled rows that the counts
didn't use turns it into a score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, frugal, give_back, hash_words, materialize, mix, slices, split_words, table


@dataclass(frozen=True)
class ToxicityConfig:
    """The class counts cover every labelled document but a fifth; of that fifth at most about ``class_docs`` of a
    class calibrate the curve. The shared counts cover every document. Orders up to ``shared_order`` are shared,
    those above are the classes' own. ``broadcast_rows``: rows of the count tables (16 to 24 bytes each), and of
    labels, that are broadcast at most; larger ones are joined."""

    class_docs: int = 4000
    order: int = 6
    shared_order: int = 3
    discount: float = 0.75
    windows: tuple[int, ...] = (1, 4, 16, 64)
    broadcast_rows: int = 3_000_000
    seed: int = 5


def _words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Offsets by text, the distinct words, and the index of each word; words are lower-cased and cut to letters."""
    offsets, flat = split_words(texts)
    coded = flat.dictionary_encode()
    bare = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}]+", "").dictionary_encode()
    return offsets, bare.dictionary.to_numpy(zero_copy_only=False).tolist(), bare.indices.to_numpy()[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)


def _spelled(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(owner, place in the word, {n: (context key, n-gram key)}) of every character and closing bound of the words.
    Contexts are cut at the word's start: an n-gram has its full length where the place is n - 1 at least, and starts
    the word where it is just that."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    real = place > 0
    keys, context = {}, np.zeros(len(codes), U64)
    for n in range(1, order + 1):
        keys[n] = (context[real], mix(context[real] * U64(1000003) + codes[real]))
        back = np.concatenate([np.zeros(n, U64), codes[:-n]]) if len(codes) > n else np.zeros(len(codes), U64)
        context = np.where(place >= n, mix(context + back * U64(0x9E3779B97F4A7C15) + U64(n)), context)
    return owner[real], place[real], keys


GRAM = {"n": "int", "starts": "boolean", "context": "long", "gram": "long", "tail_context": "long", "tail": "long"}
SEEN = ("ordinary", "toxic", "documents")


class _Counts:
    """n-gram counts of a task: rows of equal n-grams are added up now and then."""

    def __init__(self, most: int = 400_000):
        self.most, self.rows, self.size = most, [], 0

    def add(self, n: int, starts: np.ndarray, keys: list[np.ndarray], seen: list[np.ndarray]) -> None:
        """``keys``: context and n-gram, context and n-gram of the order below; ``seen``: see ``SEEN``."""
        if len(starts):
            self.rows.append(self._merged([np.full(len(starts), n, np.int32), starts, *keys], seen))
            self.size += len(self.rows[-1][0])

    @staticmethod
    def _merged(what: list[np.ndarray], seen: list[np.ndarray]) -> list[np.ndarray]:
        codes, _ = pd.factorize(mix(what[3] + what[0].astype(U64)))
        first = np.zeros(codes.max() + 1, np.int64)
        first[codes] = np.arange(len(codes))
        return [*(c[first] for c in what), *(np.bincount(codes, weights=c) for c in seen)]

    def flush(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.size or (self.size < self.most and not last):
            return
        columns = [np.concatenate(c) for c in zip(*self.rows, strict=True)]
        rows = self._merged(columns[: len(GRAM)], columns[len(GRAM) :])
        self.rows, self.size = [rows], len(rows[0])
        if last or self.size > self.most // 2:
            for i in range(0, self.size, 100_000):
                n, starts, *rest = (c[i : i + 100_000] for c in rows)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(starts), *(pa.array(c.view(np.int64) if c.dtype == U64 else c.astype(np.int64)) for c in rest)], names=[*GRAM, *SEEN])
            self.rows, self.size = [], 0


def ngrams(rows: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """The distinct full n-grams from two characters on of ``rows(text, toxic)``: does it start the word, its context,
    its tail (the n-gram without the first character) with context, and the documents with it: ordinary, toxic, all.
    Orders that only the classes use leave out what is in no document whose ``toxic`` is 0 or 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, words, index = _words(part.column("text"))
                kind = pc.fill_null(part.column("toxic"), -1).to_numpy()
                owner = np.repeat(np.arange(len(kind)), np.diff(offsets))
                once = pd.unique(owner * (len(words) + 1) + index)
                word, kind = once % (len(words) + 1), kind[once // (len(words) + 1)]
                seen = [np.bincount(word[at], minlength=len(words)) for at in (kind == 0, kind == 1, slice(None))]
                at, place, keys = _spelled(words, cfg.order)
                learnt = (seen[0] + seen[1])[at] > 0
                for n in range(2, cfg.order + 1):
                    kept = (place >= n - 1) & (learnt if n > cfg.shared_order + 1 else True)
                    counts.add(n, place[kept] == n - 1, [k[kept] for k in (*keys[n], *keys[n - 1])], [c[at[kept]] for c in seen])
                yield from counts.flush()
        yield from counts.flush(last=True)

    made = rows.select("text", "toxic").mapInArrow(frugal(run), ", ".join([*(f"{c} {k}" for c, k in GRAM.items()), *(f"{c} long" for c in SEEN)]))
    return made.groupBy(*GRAM).agg(*[F.sum(c).alias(c) for c in SEEN])


def kneser_ney_counts(grams: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """(n, context, gram, ordinary, toxic) of ``ngrams``: documents for the longest order and for what starts a word,
    otherwise how many distinct characters were seen before the n-gram: by documents of the class in the classes' own
    orders, by all documents, the same for both classes, in the shared ones."""
    shared = lambda c: F.when(F.col("n") <= cfg.shared_order, F.col("documents")).otherwise(F.col(c)).alias(c)
    plain = grams.where((F.col("n") == cfg.order) | F.col("starts")).select("n", "context", "gram", shared("ordinary"), shared("toxic"))
    met = lambda c: F.sum((F.when(F.col("n") <= cfg.shared_order + 1, F.col("documents")).otherwise(F.col(c)) > 0).cast("long")).alias(c)
    before = grams.groupBy("n", "tail_context", "tail").agg(met("ordinary"), met("toxic"))
    return plain.unionAll(before.select(F.col("n") - 1, "tail_context", "tail", "ordinary", "toxic")).where("ordinary > 0 or toxic > 0")


def context_sums(counts: DataFrame) -> DataFrame:
    """(n, context, sum_0, types_0, sum_1, types_1): of each context and class, all counts and the n-grams seen."""
    sides = [x for i, c in enumerate(("ordinary", "toxic")) for x in (F.sum(c).alias(f"sum_{i}"), F.sum((F.col(c) > 0).cast("long")).alias(f"types_{i}"))]
    return counts.groupBy("n", "context").agg(*sides)


def _look(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    if not len(keys):
        return [np.zeros(len(wanted)) for _ in values]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return [np.where(hit, v[at], 0.0) for v in values]


class KneserNey:
    """Both classes' character models; ``levels``: {order: (n-grams, counts by class, contexts, sums, types)}, keys
    sorted."""

    def __init__(self, levels: dict, cfg: ToxicityConfig):
        self.levels, self.cfg = levels, cfg

    @classmethod
    def load(cls, counts: DataFrame, sums: DataFrame, cfg: ToxicityConfig) -> KneserNey:
        grams, contexts, levels = counts.drop("context").toArrow(), sums.toArrow(), {}
        for n in range(1, cfg.order + 1):
            g, x = (t.filter(pc.equal(t.column("n"), n)) for t in (grams, contexts))
            g_key, x_key = (t.column(c).to_numpy().view(U64) for t, c in ((g, "gram"), (x, "context")))
            a, b = np.argsort(g_key), np.argsort(x_key)
            values = lambda t, at, *names: [t.column(c).to_numpy()[at].astype(np.float32) for c in names]
            levels[n] = (g_key[a], values(g, a, "ordinary", "toxic"), x_key[b], values(x, b, "sum_0", "sum_1"), values(x, b, "types_0", "types_1"))
        return cls(levels, cfg)

    def ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio (toxic over ordinary) of each word, by character; words without letters have 0."""
        owner, _, keys = _spelled(words, self.cfg.order)
        codes, grams = pd.factorize(keys[self.cfg.order][1])  # the longest n-gram decides all the shorter ones
        first = np.zeros(len(grams), np.int64)
        first[codes] = np.arange(len(codes))
        p, d = [np.full(len(grams), 1e-5)] * 2, self.cfg.discount
        for n in range(1, self.cfg.order + 1):
            g_key, counts, x_key, sums, types = self.levels[n]
            context, gram = (k[first] for k in keys[n])
            count, (sum_0, sum_1, types_0, types_1) = _look(g_key, gram, *counts), _look(x_key, context, *sums, *types)
            p = [np.where(s > 0, (np.maximum(c - d, 0) + d * t * q) / np.maximum(s, 1e-9), q) for c, s, t, q in zip(count, (sum_0, sum_1), (types_0, types_1), p, strict=True)]
        logs = np.log(np.maximum(p[1], 1e-12)) - np.log(np.maximum(p[0], 1e-12))
        out = np.bincount(owner, weights=logs[codes], minlength=len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)
        out[[i for i, w in enumerate(words) if not w]] = 0.0
        return out


def joined_ratios(texts: DataFrame, counts: DataFrame, sums: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """(word, ratio) of the distinct words of ``texts(text)``: what ``KneserNey.ratios`` gives, by joins with the
    distributed tables; ``word`` is a hash. The shared orders, whose few keys would each take a large part of all
    places, are broadcast, unless they alone have more than ``broadcast_rows`` rows."""
    orders = range(1, cfg.order + 1)
    short = F.col("n") <= cfg.shared_order
    few = counts.where(short).count() + sums.where(short).count() <= cfg.broadcast_rows

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([w for w in _words(part.column("text"))[1] if w], pa.string())], names=["word"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word", 1 << 20):
                owner, _, keys = _spelled(part.column("word").to_pylist(), cfg.order)
                columns = [hash_words(part.column("word"))[owner], *(k for n in orders for k in keys[n])]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["word", *(f"{k}{n}" for n in orders for k in "xg")])

    words = texts.select("text").mapInArrow(frugal(distinct), "word string").distinct()
    rows = words.mapInArrow(frugal(spell), ", ".join(["word long", *(f"{k}{n} long" for n in orders for k in "xg")])).withColumns({"p0": F.lit(1e-5), "p1": F.lit(1e-5)})
    for n in orders:
        grams = counts.where(F.col("n") == n).select(F.col("gram").alias(f"g{n}"), F.col("ordinary").alias("c0"), F.col("toxic").alias("c1"))
        contexts = sums.where(F.col("n") == n).select(F.col("context").alias(f"x{n}"), "sum_0", "types_0", "sum_1", "types_1")
        if few and n <= cfg.shared_order:
            grams, contexts = F.broadcast(grams), F.broadcast(contexts)
        rows = rows.join(grams, f"g{n}", "left").join(contexts, f"x{n}", "left")
        step = lambda i: F.when(F.col(f"sum_{i}") > 0, (F.greatest(F.coalesce(f"c{i}", F.lit(0)) - cfg.discount, F.lit(0.0)) + cfg.discount * F.col(f"types_{i}") * F.col(f"p{i}")) / F.col(f"sum_{i}")).otherwise(F.col(f"p{i}"))
        rows = rows.withColumns({"p0": step(0), "p1": step(1)}).drop(f"g{n}", f"x{n}", "c0", "c1", "sum_0", "types_0", "sum_1", "types_1")
    log = lambda i: F.log(F.greatest(f"p{i}", F.lit(1e-12)))
    return rows.groupBy("word").agg(F.avg(log(1) - log(0)).alias("ratio"))


def evidence(offsets: np.ndarray, ratios: np.ndarray, windows: tuple[int, ...]) -> np.ndarray:
    """By text: mean ratio of its words, the largest mean over each kind of window, and log length. ``ratios`` are
    those of the words of all texts."""
    out = np.zeros((len(offsets) - 1, len(windows) + 2))
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        n = b - a
        if n:
            out[i, 0] = (sums[b] - sums[a]) / n
            for j, w in enumerate(windows):
                w_ = min(w, n)
                out[i, j + 1] = (sums[a + w_ : b + 1] - sums[a : b + 1 - w_]).max() / w
            out[i, -1] = np.log1p(n) / 10
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps; constant last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _scored(x: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ curve, -30, 30)))


def _shipped(counts: DataFrame, sums: DataFrame, cfg: ToxicityConfig):
    """The models as a broadcast variable; none if they have more than ``broadcast_rows`` rows."""
    if counts.count() + sums.count() > cfg.broadcast_rows:
        return None
    shipped = counts.sparkSession.sparkContext.broadcast(KneserNey.load(counts, sums, cfg).levels)
    give_back()
    return shipped


def _with_evidence(rows: DataFrame, counts: DataFrame, sums: DataFrame, shipped, cfg: ToxicityConfig, finish, fields: dict[str, pa.DataType], extra: str = "") -> DataFrame:
    """``rows(doc_id, text, extra)`` with the text replaced by what ``finish`` makes of its evidence."""
    keep = ["doc_id", *extra.split()]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keep}
    names = [*keep, *fields]
    schema = ", ".join([f"{c} {k}" for c, k in kinds.items()] + [f"{c} {'array<double>' if pa.types.is_list(k) else 'double'}" for c, k in fields.items()])

    def out(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(v, k) for v, k in zip(finish(x), fields.values(), strict=True))], names=names)

    if shipped is not None:

        def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = KneserNey(shipped.value, cfg)
            for batch in batches:
                for part in slices(batch, "text"):
                    offsets, words, index = _words(part.column("text"))
                    yield out(part, evidence(offsets, model.ratios(words)[index], cfg.windows))

        return rows.select(*keep, "text").mapInArrow(frugal(see), schema)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, words, index = _words(part.column("text"))
                owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                once = pd.unique(owner * (len(words) + 1) + index)
                hashes = hash_words(pa.array(words, pa.string())).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(once // (len(words) + 1))), pa.array(hashes[once % (len(words) + 1)])], names=["key", "word"])

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                offsets, words, index = _words(part.column("text"))
                found = {r["word"]: r["ratio"] for r in part.column("ratios")[0].as_py() or []}
                mine = np.fromiter((found.get(h, 0.0) for h in hash_words(pa.array(words, pa.string())).view(np.int64).tolist()), np.float64, len(words))
                yield out(part, evidence(offsets, mine[index], cfg.windows))

    keyed = rows.withColumn("key", F.sha2("text", 256))  # equal texts have equal evidence
    ratios = joined_ratios(rows, counts, sums, cfg)
    pairs = keyed.select("key", "text").mapInArrow(frugal(used), "key string, word long").distinct()
    lists = pairs.join(ratios, "word").groupBy("key").agg(F.collect_list(F.struct("word", "ratio")).alias("ratios"))
    return keyed.join(lists, "key", "left").select(*keep, "text", "ratios").mapInArrow(frugal(given), schema)


def fit_and_score(docs: DataFrame, labels: DataFrame, trainable, cfg: ToxicityConfig | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``; labels are learnt from rows where ``trainable`` holds.

    ``labels(doc_id, toxic)``; rows without an id or without a 0 or 1 teach nothing, and an id with both counts as
    toxic. Without both classes every score is the share of class 1 (0 if nothing is labelled). Where the
    calibration fifth lacks a class, the score is the logistic function of the evidence of the whole text alone: 0.5
    where both classes make it equally likely. Null and empty texts get the score of no evidence, very long ones are
    read whole; rows with a null id are scored like others; equal texts get equal scores. An empty table gives no
    rows; other columns are ignored."""
    cfg = cfg or ToxicityConfig()
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    usable = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(trainable)
    usable = materialize(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "usable")
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        share = float(sizes.get(1, 0) > 0)
        return narrow.select(F.col("doc_id").alias(id_col), F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    small = sum(sizes.values()) <= cfg.broadcast_rows // 10
    fold = F.pmod(F.xxhash64(F.lit(cfg.seed + 1), F.col("doc_id")), F.lit(5))
    taught = usable.where(fold > 0)
    grams = materialize(ngrams(narrow.join(F.broadcast(taught) if small else taught, "doc_id", "left"), cfg), "grams")
    counts = materialize(kneser_ney_counts(grams, cfg), "counts")
    sums = materialize(context_sums(counts), "sums")
    shipped = _shipped(counts, sums, cfg)

    draw = F.pmod(F.xxhash64(F.lit(cfg.seed), F.col("doc_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chance = F.when(F.col("toxic") == 1, F.lit(5 * cfg.class_docs / sizes[1])).otherwise(F.lit(5 * cfg.class_docs / sizes[0]))
    held = narrow.join(F.broadcast(usable.where(fold == 0).where(draw < chance)), "doc_id")
    seen = _with_evidence(held, counts, sums, shipped, cfg, lambda x: [list(x)], {"x": pa.list_(pa.float64())}, "toxic").orderBy("doc_id", "x").toArrow()
    y = seen.column("toxic").to_numpy().astype(np.float64)
    width = len(cfg.windows) + 2
    if 0 < y.sum() < len(y):
        x = np.array(seen.column("x").to_pylist()).reshape(len(y), width)
        curve = _logistic(x, y, np.array([sizes[int(c)] / (y == c).sum() for c in y]) * len(y) / sum(sizes.values()))
    else:
        curve = np.array([1.0] + [0.0] * width)
    scored = _with_evidence(narrow, counts, sums, shipped, cfg, lambda x: [_scored(x, curve)], {"score": pa.float64()})
    return scored.select(F.col("doc_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(id_col: str = "doc_id", folds: int = 5):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; one fold in five is held out of learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit_and_score(docs, labels, ~held_out()).select("doc_id", held_out().alias("held_out"), "score", "predicted")
