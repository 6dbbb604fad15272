"""Fill-in-middle transformation with unit boundaries found by SWAR words.

A unit is a run of white space with the run of other bytes behind it; white space at a text's end is a unit of its
own. White space is ASCII, so units are found on the UTF-8 bytes. The bytes of many texts, one behind the other, are
viewed as 64-bit words: additions that can't carry from byte to byte mark white space in eight bytes at once, a shift
marks the bytes that end a unit, ``bitwise_count`` counts the marks of a word, and their cumulative sum is searched for
the word that holds a wanted mark; a multiplication then sums the marks inside the word to find the byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, bounded_batches, frugal, slices, table

#: Signs in front of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")

_ONES = U64(0x0101010101010101)
_LOW = U64(0x7F7F7F7F7F7F7F7F)
_HIGH = U64(0x8080808080808080)


def white_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is 0x20 or 0x09 to 0x0D."""
    low = words & _LOW
    at_least_9, at_least_14 = low + _ONES * U64(0x80 - 9), low + _ONES * U64(0x80 - 14)
    other = words ^ (_ONES * U64(0x20))
    blank = ~(((other & _LOW) + _LOW) | other)
    return ((at_least_9 & ~at_least_14 & ~words) | blank) & _HIGH


class Marks:
    """Marked bytes of a sequence of 64-bit words, with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.upto = np.cumsum(np.bitwise_count(words), dtype=np.int64)

    def before(self, place: np.ndarray) -> np.ndarray:
        """Number of marked bytes before each place."""
        word, byte = place >> 3, (place & 7).astype(U64)
        inside = self.words[word] & ((U64(1) << (byte * U64(8))) - U64(1))
        return self.upto[word] - np.bitwise_count(self.words[word]) + np.bitwise_count(inside)

    def place(self, rank: np.ndarray) -> np.ndarray:
        """Place of the marked byte with each rank, from 1."""
        word = np.searchsorted(self.upto, rank)
        found = self.words[word]
        inside = (rank - (self.upto[word] - np.bitwise_count(found))).astype(U64)
        sums = (found >> U64(7)) * _ONES  # byte i: marks in bytes 0 to i
        reached = ((sums | _HIGH) - inside * _ONES) & _HIGH
        return word * 8 + 8 - np.bitwise_count(reached)


def text_marks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Marks, Marks]:
    """(bytes, offsets, marks of unit ends, marks of UTF-8 continuation bytes) of texts without nulls."""
    texts = texts.cast(pa.binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first, size = offsets[0], int(offsets[-1] - offsets[0])
    offsets = offsets - first
    padded = np.zeros((size // 8 + 2) * 8, np.uint8)
    if size:
        padded[:size] = np.frombuffer(data, np.uint8)[first : first + size]
    words = padded.view("<u8")
    white = white_marks(words)
    following = white >> U64(8)
    following[:-1] |= white[1:] << U64(56)
    ends = ~white & following & _HIGH
    last = offsets[1:][np.diff(offsets) > 0] - 1  # a text's last byte ends a unit, whatever it is
    np.bitwise_or.at(ends, last >> 3, U64(0x80) << ((last & 7).astype(U64) * U64(8)))
    return padded[:size], offsets, Marks(ends), Marks(words & ~(words << U64(1)) & _HIGH)


def _separable(sentinels: tuple[str, str, str]) -> None:
    """A text without the sentinels must not seem to hold one where it meets the next."""
    for s in sentinels:
        for i in range(1, len(s)):
            if any(t.startswith(s[i:]) or s[i:].startswith(t) for t in sentinels):
                raise ValueError(f"sentinels overlap: {sentinels}")
    if not all(sentinels) or len({*sentinels}) < 3:
        raise ValueError(f"three different sentinels are needed: {sentinels}")


def fill_in_middle(docs: DataFrame, percent: int = 50, spm_percent: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    ``n`` is the number of units, ``output`` the new text, ``form`` plain, psm (prefix, suffix, middle) or spm
    (suffix, prefix, middle); ``percent`` of the documents change, ``spm_percent`` of these to spm. Draws are SHA-256
    of seed and id: the first two, modulo n + 1, are the cuts, the smaller one ends the prefix.

    Null texts are empty, empty ones and those that hold a sentinel stay plain, with null for both lengths. Very long
    texts are one slice of their own and whole. Rows that repeat an id have equal draws, a null id draws as an empty
    one. An empty table gives no rows; other columns are ignored. No shuffle."""
    _separable(sentinels)
    bounded_batches(docs.sparkSession)
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draw = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    plain = (raw == "") | (draw(2) % 100 >= percent)
    for s in sentinels:
        plain = plain | F.contains(raw, F.lit(s))
    form = F.when(plain, "plain").when(draw(3) % 100 < spm_percent, "spm").otherwise("psm")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("text"), form.alias("form"), draw(0).alias("h1"), draw(1).alias("h2"))
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets, ends, tails = text_marks(part.column("text"))
                start, end = offsets[:-1], offsets[1:]
                seen = ends.before(start)
                n = ends.before(end) - seen
                cuts = np.sort(np.stack([part.column(c).to_numpy() % (n + 1) for c in ("h1", "h2")]), axis=0)
                one, two = (np.where(k > 0, ends.place(np.maximum(seen + k, 1)) + 1, start) if len(data) else start for k in cuts)
                chars = [(b - a) - (tails.before(b) - tails.before(a)) for a, b in ((start, one), (one, two))]
                whole, out = memoryview(data), []
                for kind, a, b, c, d in zip(part.column("form").to_pylist(), start.tolist(), one.tolist(), two.tolist(), end.tolist(), strict=True):
                    if kind == "plain":
                        out.append(bytes(whole[a:d]))
                    elif kind == "psm":
                        out.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
                    else:
                        out.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
                changed = pc.not_equal(part.column("form"), "plain")
                columns = [part.column("id"), pa.array(n), part.column("form"), *(pc.if_else(changed, pa.array(x.astype(np.int64)), None) for x in chars), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return narrow.mapInArrow(frugal(run), "id long, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of, rebuilt from it and ``form`` alone."""
    _separable(sentinels)
    p, s, m = sentinels

    def between(first: str, second: str) -> Column:
        """``first`` part, middle and ``second`` part of a text that begins with ``first``'s sentinel."""
        cut, mid = F.position(F.lit(second), output), F.position(F.lit(m), output)
        a = F.substr(output, F.lit(len(first) + 1), cut - len(first) - 1)
        b = F.substr(output, cut + len(second), mid - cut - len(second))
        c = F.substr(output, mid + len(m), F.char_length(output))
        return F.concat(a, c, b) if first == p else F.concat(b, c, a)

    return F.when(form == "plain", output).when(form == "psm", between(p, s)).otherwise(between(s, p))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; digests of the new and of the rebuilt texts."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = {
    "op12_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
                     cast('0x' || substr(h, 1, 8) as ubigint) as h1, cast('0x' || substr(h, 9, 8) as ubigint) as h2,
                     cast('0x' || substr(h, 17, 8) as ubigint) as h3, cast('0x' || substr(h, 25, 8) as ubigint) as h4 from d),
        k as (select *, cast(len(units) as bigint) as n, cast(h1 % (len(units) + 1) as bigint) as c1, cast(h2 % (len(units) + 1) as bigint) as c2,
                     case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
        c as (select *, array_to_string(units[1:least(c1, c2)], '') as p, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') as m, array_to_string(units[greatest(c1, c2) + 1:n], '') as s from k)
        select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
               sha256(p || m || s) as restored_sha256
        from c"""
}
