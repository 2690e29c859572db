"""Vectorised tokenising and hashing of the texts of an Arrow batch.

A batch of texts becomes one byte array; words are found with a byte class table, so both word
definitions of the library (ASCII white space, ASCII non-alphanumerics) are exact on UTF-8: every
byte of a multi-byte character is a word byte.  Word hashes are 64-bit polynomials over random
byte values, finished with a mixer; n-gram hashes are polynomials over word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are tokenised at once; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 21
_PIECE = 1 << 20
#: A word of more bytes is hashed with BLAKE2b, so that the power tables stay small.
_LONG = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of "words between white space".
SPACE = _space
_punct = np.zeros(256, bool)
_punct[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Separators of "runs of ASCII letters, ASCII digits and other characters".
PUNCT = _punct

_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_VALUES = _VALUES[_lower]


def _powers(base: int) -> np.ndarray:
    table = np.full(_PIECE + _LONG + 2, base & _MASK, np.uint64)
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


_POW = _powers(_BASE)
_INV = _powers(pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the constants are those of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def small_batches(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each hold about `most` bytes, or are one text."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of some texts: `start`, `end` (bytes in `data`), `doc` (index of the text), `hash`."""

    def __init__(self, texts: list[bytes | None], separators: np.ndarray = SPACE, lower: bool = False):
        texts = [t or b"" for t in texts]
        self.n_docs = len(texts)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(lengths)]) if texts else np.zeros(1, np.int64)
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[1:] = ~separators[self.data]
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.doc_start, self.start, "right") - 1
        self._lower = lower
        #: Index of each text's first word, and one past the last word at the end.
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    @cached_property
    def hash(self) -> np.ndarray:
        return self._hashes(_LOWER_VALUES if self._lower else _VALUES, self._lower)

    @cached_property
    def spaced(self) -> tuple[bytes, np.ndarray]:
        """All words, each with one space after it, and where each word begins in that, and the end."""
        at = np.concatenate([[0], np.cumsum(self.end - self.start + 1)])
        step = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(step, self.start, 1)
        np.add.at(step, self.end + 1, -1)  # a separator follows every word
        out = self.data[np.cumsum(step[:-1]) > 0]
        out[at[1:] - 1] = 0x20
        return out.tobytes(), at

    def _hashes(self, values: np.ndarray, lower: bool) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            lo = self.start[at]
            to = int(np.searchsorted(self.start, lo + _PIECE))
            while to - 1 > at and self.end[to - 1] - lo > _PIECE + _LONG:
                to -= 1
            hi = min(self.end[to - 1], lo + _PIECE + _LONG)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(values[self.data[lo:hi]] * _POW[: hi - lo], out=sums[1:])
            s, e = self.start[at:to] - lo, np.minimum(self.end[at:to] - lo, hi - lo)
            out[at:to] = (sums[e] - sums[s]) * _INV[s]
            at = to
        for i in np.flatnonzero(self.end - self.start > _LONG):
            word = self.data[self.start[i] : self.end[i]].tobytes()
            word = word.lower() if lower else word  # bytes.lower() changes A-Z only
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return mix(out + (self.end - self.start).astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of n words of one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, gram_hashes(self.hash, n)[at]


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive hashes."""
    m = len(hashes) - n + 1
    acc = np.full(m, n, np.uint64)
    for j in range(n):
        acc *= np.uint64(0xD6E8FEB86659FD93)
        acc += hashes[j : j + m]
    return mix(acc)


def texts_of(batch: pa.RecordBatch | pa.Table, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def or_empty(table: pa.Table, **columns: pa.DataType) -> pa.Table:
    """`table`; where a cogroup had no rows on this side, and so no columns, a table with them."""
    return table if table.num_rows else pa.schema(list(columns.items())).empty_table()
