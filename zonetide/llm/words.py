"""Words of a column of texts as NumPy arrays: positions, 64-bit hashes, n-gram hashes.

All helpers run inside Arrow batches on one executor. They look at the UTF-8 bytes of the batch, so no Python string is
made per word. Hashes are fixed functions of the bytes: every task and every retry gets the same value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: Bytes that end a word: white space (a-f), or everything but ASCII letters, digits and non-ASCII.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """``start``/``end``: byte bounds in ``data``; ``first[d]:first[d + 1]`` are the words of text ``d``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.first))

    def place(self) -> np.ndarray:
        """Number of a word inside its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], np.diff(self.first))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts together and the offset of each (null: empty)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset:]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, lower: bool = False, breaks: np.ndarray = SPACES, hashed: bool = True) -> Words:
    """Split texts at the bytes in ``breaks``; ``lower`` lowers A-Z first; without ``hashed`` the words get no hashes."""
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    inside = ~breaks[data]
    n = len(data)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    edges = offsets
    before[edges] = False  # a text starts here
    after[edges] = False
    start = np.flatnonzero(inside & ~before[:n])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(start, offsets)
    h = np.zeros(0, np.uint64)
    if hashed and len(start):
        length = end - start
        longest = int(length.max())
        # Only bytes of words are gathered; the power of a byte is its place in the word.
        total = int(length.sum())
        skip = np.cumsum(length) - length
        at = np.arange(total, dtype=np.int64) - np.repeat(skip, length)
        values = _BYTE[data[inside]] * _powers(_BASE, longest)[at]
        h = mix(np.add.reduceat(values, skip) + length.astype(np.uint64))
    return Words(data, start, end, first, h)


def slices(batch: pa.RecordBatch, column: str, size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``size`` bytes of text, one row at least, so that memory stays bounded."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        ends = np.cumsum(lengths[at:at + 20_000])
        n = max(1, int(np.searchsorted(ends, size, side="right")))
        yield batch.slice(at, n)
        at += n


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``n`` consecutive values from each place on; the last ``n - 1`` places have none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            out += h[j:j + m] * factor
            factor = factor * _STEP
    return mix(out)


def inside_grams(w: Words, n: int) -> np.ndarray:
    """Places from which ``n`` words of one text follow."""
    left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(w.start))
    return np.flatnonzero(left >= n)


class Rolling:
    """Hashes of any ranges of a sequence in constant time each."""

    def __init__(self, h: np.ndarray, base: int = 0xD1342543DE82EF95):
        base = np.uint64(base)
        with np.errstate(over="ignore"):
            self.power = _powers(base, len(h) + 1)
            self.inverse = _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(h) + 1)
            self.sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * self.power[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))


def ragged(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ranges ``offset[i] : offset[i] + length[i]``."""
    total = int(length.sum())
    skip = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) - np.repeat(skip - offset, length)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
