"""Hierarchical language identification.

The first decision is the language family, the second the language within it; both are taken by one-versus-one
linear support vector machines over hashed character n-grams. A document's features are the relative frequencies
of the n-grams of its words, so that a document's margin is the mean of its words' margins: each distinct word of
a batch is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, bounded_batches, frugal, give_back, mix, slices, table

#: Language families by ISO 639-1 code. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "nb", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "ug", "uz"],
    "semitic": ["am", "ar", "he", "mt"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "dravidian": ["kn", "ml", "ta", "te"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
UNDETERMINED = "und"
#: Words whose n-grams are looked at together.
WORDS = 8192


@dataclass(frozen=True)
class LangIdConfig:
    """``sample_docs`` bounds the labelled documents that the machines are fitted on, shared evenly by language."""

    sample_docs: int = 3000
    dims: int = 8192
    longest: int = 4
    epochs: int = 12
    cost: float = 10.0
    seed: int = 11


@dataclass
class LangIdModel:
    languages: list[str]
    #: one-versus-one machines: (level, first, second) with level "" for families, else the family's name
    pairs: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None  # machines x (dims + 1), bias last
    slopes: np.ndarray | None = None


def word_ngrams(words: pa.Array, cfg: LangIdConfig) -> tuple[np.ndarray, np.ndarray]:
    """(owner, dimension) of every byte n-gram of the words with their bounds; words are cut to their letters."""
    letters = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}]+", "")
    framed = pc.if_else(pc.equal(letters, ""), "", pc.binary_join_element_wise(" ", letters, " ", ""))
    raw = framed.cast(pa.binary())
    size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer(b"".join(raw.to_numpy(zero_copy_only=False).tolist()), np.uint8).astype(U64)
    owner = np.repeat(np.arange(len(size)), size)
    owners, dims = [], []
    rolled = np.zeros(len(flat), U64)
    for n in range(1, cfg.longest + 1):
        if len(flat) < n:
            break
        rolled = rolled[: len(flat) - n + 1] * U64(257) + flat[n - 1 :] + U64(1)
        same = owner[: len(rolled)] == owner[n - 1 :]
        owners.append(owner[: len(rolled)][same])
        dims.append((mix(rolled[same] + U64(n << 40)) % U64(cfg.dims)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(dims)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(owner text of each word, distinct words, index of each word)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy())), coded.dictionary, coded.indices.to_numpy()


#: A document's features: its dimensions and their relative frequencies.
Sparse = tuple[np.ndarray, np.ndarray]


def features(texts: pa.Array, cfg: LangIdConfig) -> list[Sparse]:
    """Relative n-gram frequencies by text, with a constant as the last dimension."""
    out = []
    for i in range(len(texts)):
        _, words, index = _words(texts.slice(i, 1))
        owner, dims = word_ngrams(words, cfg)
        counts = np.bincount(dims, weights=np.bincount(index, minlength=len(words))[owner], minlength=cfg.dims)
        seen = np.flatnonzero(counts)
        out.append((np.append(seen, cfg.dims).astype(np.int32), np.append(counts[seen] / max(1.0, counts.sum()), 0.01).astype(np.float32)))
    return out


def margins(x: list[Sparse], w: np.ndarray) -> np.ndarray:
    return np.fromiter((v @ w[d] for d, v in x), np.float64, len(x))


def linear_svm(x: list[Sparse], y: np.ndarray, cfg: LangIdConfig) -> np.ndarray:
    """Hinge-loss machine by dual coordinate descent; y is -1 or 1, the classes weigh the same."""
    rng = np.random.default_rng(cfg.seed)
    norm = np.fromiter((v @ v for _, v in x), np.float64, len(x)) + 1e-12
    limit = cfg.cost / norm.mean() * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    alpha, w = np.zeros(len(y)), np.zeros(cfg.dims + 1)
    for _ in range(cfg.epochs):
        for i in rng.permutation(len(y)):
            dims, values = x[i]
            step = np.clip(alpha[i] + (1 - y[i] * (values @ w[dims])) / norm[i], 0, limit[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[dims] += step * y[i] * values
    return w


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve that turns margins into probabilities, by a search over powers of two."""
    steps = 2.0 ** np.arange(-2, 7)
    return float(min(steps, key=lambda s: np.logaddexp(0, -s * y * margin).mean()))


def labelled_sample(docs: DataFrame, per_class: int, label: str, seed: int) -> DataFrame:
    """About ``per_class`` rows of each label: those with the smallest hashes of their id and text, by a threshold
    for each label, so that no group is gathered or sorted."""
    sizes = docs.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    chance = F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("__n"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return docs.join(F.broadcast(sizes), label).where(draw < chance).drop("__n")


def fit(docs: DataFrame, cfg: LangIdConfig | None = None, text: str = "text", lang: str = "lang") -> LangIdModel:
    """Fits on a bounded sample of the rows of ``docs(doc_id, text, lang)`` with text and language.

    Without labelled rows the model knows no language and everything is undetermined."""
    cfg = cfg or LangIdConfig()
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)).select("doc_id", F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    model = LangIdModel(languages)
    if len(languages) < 2:
        return model
    sample = labelled_sample(known, max(20, cfg.sample_docs // len(languages)), "lang", cfg.seed).orderBy("doc_id").select("text", "lang").toArrow()
    x, label = features(sample.column("text").combine_chunks(), cfg), np.array(sample.column("lang").to_pylist())
    family = np.array([FAMILY_OF.get(code, code) for code in label])
    todo = [("", a, b, family) for a, b in combinations(sorted({*family}), 2)]
    for name in sorted({*family}):
        todo += [(name, a, b, label) for a, b in combinations(sorted({*label[family == name]}), 2)]
    weights, slopes = [], []
    for level, a, b, names in todo:
        rows = np.flatnonzero((names == a) | (names == b))
        y = np.where(names[rows] == a, 1.0, -1.0)
        mine = [x[i] for i in rows]
        w = linear_svm(mine, y, cfg)
        model.pairs.append((level, a, b))
        weights.append(w)
        slopes.append(_slope(margins(mine, w), y))
    model.weights, model.slopes = np.array(weights), np.array(slopes)
    del x, sample
    give_back()
    return model


def _decide(chance: np.ndarray, pairs: list[tuple[str, str, str]], level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Winner of the pairwise votes at a level, ties to the larger sum of probabilities, and its mean probability."""
    if len(names) == 1:
        return np.zeros(len(chance), np.int64), np.ones(len(chance))
    votes, sums = np.zeros((len(chance), len(names))), np.zeros((len(chance), len(names)))
    for k, (at, a, b) in enumerate(pairs):
        if at == level:
            i, j = names.index(a), names.index(b)
            votes[:, i] += chance[:, k] >= 0.5
            votes[:, j] += chance[:, k] < 0.5
            sums[:, i] += chance[:, k]
            sums[:, j] += 1 - chance[:, k]
    best = (votes + sums / len(names)).argmax(axis=1)
    return best, sums[np.arange(len(best)), best] / (len(names) - 1)


def _word_sums(words: pa.Array, model: LangIdModel, cfg: LangIdConfig) -> tuple[np.ndarray, np.ndarray]:
    """(number of n-grams by word, sum of their weights by machine and word), some words at a time: n-grams take a
    hundred times as much memory as the words they come from."""
    weights = [] if model.weights is None else model.weights
    count, sums = np.zeros(len(words)), np.zeros((len(weights), len(words)))
    for a in range(0, len(words), WORDS):
        some = words.slice(a, WORDS)
        at, dims = word_ngrams(some, cfg)
        to = a + len(some)
        count[a:to] = np.bincount(at, minlength=len(some))
        for k, w in enumerate(weights):
            sums[k, a:to] = np.bincount(at, weights=w[dims], minlength=len(some))
    return count, sums


def classify(texts: pa.Array, model: LangIdModel, cfg: LangIdConfig) -> tuple[list[str], np.ndarray]:
    owner, words, index = _words(texts)
    count, by_word = _word_sums(words, model, cfg)
    total = np.bincount(owner, weights=count[index], minlength=len(texts))
    names, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
    if len(model.languages) == 1:
        names[total > 0], score[total > 0] = model.languages[0], 1.0
    if model.weights is None:
        return list(names), score
    margins = np.empty((len(texts), len(model.pairs)))
    for k, w in enumerate(model.weights):
        margins[:, k] = np.bincount(owner, weights=by_word[k][index], minlength=len(texts)) / np.maximum(total, 1) + 0.01 * w[-1]
    chance = 1 / (1 + np.exp(-np.clip(margins * model.slopes, -500, 500)))
    families = sorted({FAMILY_OF.get(code, code) for code in model.languages})
    top, sure = _decide(chance, model.pairs, "", families)
    for f, family in enumerate(families):
        members = sorted(code for code in model.languages if FAMILY_OF.get(code, code) == family)
        rows = np.flatnonzero((top == f) & (total > 0))
        best, within = _decide(chance[rows], model.pairs, family, members)
        names[rows], score[rows] = np.array(members, object)[best], sure[rows] * within
    return list(names), score


def predict(docs: DataFrame, model: LangIdModel, cfg: LangIdConfig | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of every row.

    Null texts and texts without a letter are ``und`` with score 0. Equal texts get equal answers, tied votes go to
    the larger sum of probabilities, then to the language first by name. Rows with a null id and repeated rows are
    answered like others, very long texts are read whole. Other columns are ignored, language labels above all; an
    empty table gives no rows."""
    cfg = cfg or LangIdConfig()
    shipped = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, score = classify(part.column("text"), LangIdModel(**shipped.value), cfg)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(frugal(run), "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def identified(docs: DataFrame, model: LangIdModel, cfg: LangIdConfig | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't ``und``, with all their columns as they are.

    Each task filters its own rows, so that texts are neither shuffled nor joined; null ids and repeated rows are
    rows like others, and extra columns of any name go through."""
    cfg = cfg or LangIdConfig()
    shipped = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                names, _ = classify(part.column(text), LangIdModel(**shipped.value), cfg)
                yield part.filter(pc.not_equal(pa.array(names, pa.string()), UNDETERMINED))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(frugal(run), docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; one fold in three is held out of fitting."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
