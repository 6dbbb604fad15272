"""Encoding whole texts with a public tokenizer file inside tasks."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices

#: Token id appended to each document.
END_ID = 1
#: Bytes of text whose distinct words are encoded together; nothing is remembered beyond them.
TOGETHER = 4 << 20
#: Ids of whole texts that are put together at a time, about.
IDS = 1 << 18
#: A small letter of the older Latin, Greek and Cyrillic blocks before signs that close a word.
_CLOSED = r"([a-z\x{df}-\x{f6}\x{f8}-\x{17f}\x{3b1}-\x{3c9}\x{430}-\x{45f}])[!-/:-@\[-`{-~]+$"


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _alphabet() -> dict[int, str]:
    """Byte -> the sign that byte-level tokenizers spell it with: printable bytes stand for themselves, the others
    follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in {*plain}]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SPELLED = _alphabet()


def _bytes_spelled(word: str) -> str:
    return word.encode().decode("latin-1").translate(_SPELLED)


def _rest(words: pa.Array, bodies: pa.Array) -> pa.Array:
    """What each word has behind its body, which it begins with."""
    whole, size = words.cast(pa.binary()), pc.binary_length(bodies).to_numpy(zero_copy_only=False)
    longer = np.flatnonzero(pc.binary_length(whole).to_numpy(zero_copy_only=False) > size)
    tails = [w[n:].decode() for w, n in zip(whole.take(pa.array(longer)).to_pylist(), size[longer].tolist(), strict=True)]
    out = np.full(len(words), "", object)
    out[longer] = tails
    return pa.array(out, pa.string())


def _joined(start: np.ndarray, length: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ends): the spans ``start``, ``length`` of ``picks`` one behind the other."""
    lengths = length[picks]
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[picks] - (ends - lengths), lengths), ends


class Encoder:
    """Ids of whole texts, equal to ``tokenizer.encode(text, add_special_tokens=False).ids``.

    With ``by_word`` the tokenizer must lower-case, drop white space, never look across it and cut between letters
    and other signs (``word_bpe_49k``): the ids of a text are then those of its words in order, and each distinct
    word of a call is encoded once. Other tokenizers need ``by_word=False``, which encodes text by text."""

    def __init__(self, path: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        # where small letters go through normaliser and pre-tokenizer as they are, the model alone is asked
        probe, t = "abcdefghijklmnopqrstuvwxyz", self.tokenizer
        self.direct = by_word and all(t.normalizer.normalize_str(w) == w and [p for p, _ in t.pre_tokenizer.pre_tokenize_str(w)] == [_bytes_spelled(w)] for w in (probe, probe + "\u00e9\u00df\u03c9\u0436"))

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(length of each text in ids, all ids), by the shortest way that gives the tokenizer's own answer."""
        flat, size, other = array("I"), [0] * len(texts), []
        model = self.tokenizer.model.tokenize
        for i, w in enumerate(texts):
            if self.direct and w.isalpha():
                if w.isascii():
                    spelled = w if w.islower() else w.lower()
                else:
                    top = max(w)
                    spelled = _bytes_spelled(w.lower()) if top <= "\u00ff" or (top < "\u0460" and w.islower() and is_normalized("NFC", w)) else ""
                if spelled:
                    ids = [t.id for t in model(spelled)]
                    flat.extend(ids)
                    size[i] = len(ids)
                    continue
            other.append(i)
        if not other:
            return np.array(size, np.int64), np.frombuffer(flat, np.uint32)
        at = np.concatenate([[0], np.cumsum(size)])
        more = array("I")
        for k in range(0, len(other), 1000):
            some = other[k : k + 1000]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
                more.extend(e.ids)
                size[i] = len(e.ids)
        length, start = np.array(size, np.int64), at[:-1]
        start[other] = len(flat) + np.cumsum(length[other]) - length[other]
        positions, _ = _joined(start, length, np.arange(len(texts)))
        return length, np.concatenate([np.frombuffer(flat, np.uint32), np.frombuffer(more, np.uint32)])[positions]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded``. Case and closing signs are taken off first: neither changes the ids of what is left, and
        words recur more."""
        marked = pc.match_substring(words, "<|")  # may hold a special token, which is looked for before all else
        lower = pc.if_else(marked, words, pc.ascii_lower(words))
        body = pc.if_else(marked, lower, pc.replace_substring_regex(lower, _CLOSED, r"\1"))
        tail = _rest(lower, body)
        both = pa.concat_arrays([body, tail]).dictionary_encode()
        length, flat = self._encoded(both.dictionary.to_numpy(zero_copy_only=False).tolist())
        picks = both.indices.to_numpy().reshape(2, -1).T.ravel()
        positions, _ = _joined(np.cumsum(length) - length, length, picks)
        return length[picks].reshape(-1, 2).sum(axis=1), flat[positions]

    def parts(self, batch: pa.RecordBatch, column: str, end: int | None = END_ID) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """(rows, offsets, ids) of consecutive runs of rows: the ids of the i-th text of a run are
        ``ids[offsets[i]:offsets[i + 1]]``; null counts as empty."""
        texts = pc.fill_null(batch.column(column), "")
        if self.by_word:
            lists = pc.ascii_split_whitespace(texts)
            coded = lists.flatten().dictionary_encode()
            first, index = lists.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy()
            first -= first[0]
            length, flat = self._words(coded.dictionary)
        else:
            first, index = np.arange(len(texts) + 1), np.arange(len(texts))
            length, flat = self._encoded(texts.to_pylist())
        start = np.cumsum(length) - length
        flat = np.concatenate([flat, np.array([] if end is None else [end], np.uint32)])
        start, length = np.append(start, len(flat) - (end is not None)), np.append(length, int(end is not None))
        upto = np.concatenate([[0], np.cumsum(length[index])])[first] + np.arange(len(texts) + 1) * int(end is not None)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + IDS, "right")) - 1)
            counts = np.diff(first[a : b + 1])
            last = np.cumsum(counts + 1) - 1
            picks = np.full(last[-1] + 1, len(length) - 1, np.int64)
            inner = np.ones(len(picks), bool)
            inner[last] = False
            picks[inner] = index[first[a] : first[b]]
            positions, _ = _joined(start, length, picks)
            yield batch.slice(a, b - a), upto[a : b + 1] - upto[a], flat[positions]
            a = b

    def __call__(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all the texts at once."""
        offsets, ids = [np.zeros(1, np.int64)], [np.zeros(0, np.uint32)]
        for _, more, flat in self.parts(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", end):
            offsets.append(more[1:] + offsets[-1][-1])
            ids.append(flat)
        return np.concatenate(offsets), np.concatenate(ids)


def together(batches: Iterator[pa.RecordBatch], column: str, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes of text; a longer single text is a batch of its own."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, most):
            more = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + more > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.concat_batches(held)
