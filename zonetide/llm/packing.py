"""Harmonic packing of token ids into sequences.

A document's ids are cut into pieces: whole sequences, then halves, quarters and so on down to ``grain``, then the rest.
A piece longer than ``capacity / (k + 1)`` and not longer than ``capacity / k`` is of class ``k``; a bin of class ``k``
takes exactly ``k`` pieces of that class. Pieces of a power of two fill their bins without a gap. Every task fills its
own bins, so nothing is shuffled; what is left in the open bins at a task's end is cut at powers of two, where a
sequence needs no padding.

Null or empty text: the document is its end id alone. Repeated rows are packed each for itself. Columns besides
``doc_id`` and ``text`` are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from zonetide.llm.words import Words, ragged, slices, words_of

CAPACITY = 4096
GRAIN = 128
#: Distinct white-space words whose ids a Python worker remembers.
REMEMBERED = 1_500_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class WordIds:
    """Ids of texts by way of the ids of their distinct white-space words.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.offset = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _runs(self, simple: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single runs of letters or signs, encoded together and parted at word ends: all ids, and each run's number."""
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for at in range(0, len(simple), 512):
            part = simple[at:at + 512]
            found = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) == len(part):
                ids.append(found)
                counts.append(np.diff(cuts, prepend=0))
            else:  # not one piece a run after all
                each = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in part]
                ids.append(np.array([i for x in each for i in x], np.uint32))
                counts.append(np.array([len(x) for x in each]))
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(counts or [np.zeros(0, np.int64)]).astype(np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and each word's number of ids.

        A word of plain Latin letters with closing signs is a run of letters and a run of signs; others go as they are.
        """
        simple: dict[str, int] = {}
        number = simple.setdefault
        head, tail, hard = [], [], []
        for w in words:
            core = w.rstrip(".,;:!?")
            if core.isalpha() and (core.isascii() or max(core) < "İ"):
                head.append(number(core.lower(), len(simple)))
                tail.append(number(w[len(core):], len(simple)) if len(core) < len(w) else -1)
            else:
                head.append(-2 - len(hard))
                tail.append(-1)
                hard.append(w)
        ids, counts = self._runs(list(simple))
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(hard, add_special_tokens=False)] if hard else []
        counts = np.concatenate((counts, [len(x) for x in whole], [0])).astype(np.int64)  # the last is the missing tail
        ids = np.concatenate((ids, np.array([i for x in whole for i in x], np.uint32)))
        offsets = np.cumsum(counts) - counts
        pairs = np.column_stack((head, tail))
        pairs = np.where(pairs < -1, len(simple) - 2 - pairs, pairs).ravel()
        return ids[ragged(offsets[pairs], counts[pairs])], counts[pairs].reshape(-1, 2).sum(1)

    def _learn(self, w: Words, keys: np.ndarray, at: np.ndarray) -> None:
        size = w.end[at] - w.start[at] + 1
        text = w.data[np.minimum(ragged(w.start[at], size), len(w.data) - 1)]
        text[np.cumsum(size) - 1] = 0x20
        flat, length = self._encode(text.tobytes().decode("utf-8", "replace").split(" ")[:-1])
        offset = np.cumsum(length) - length + len(self.flat)
        self.flat = np.concatenate((self.flat, flat))
        keys, offset, length = (np.concatenate(x) for x in ((self.keys, keys), (self.offset, offset), (self.length, length)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.offset, self.length = keys[order], offset[order], length[order]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        w = words_of(texts)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(w.texts, np.int64)
        keys, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if new.any():
            if len(self.keys) + int(new.sum()) > REMEMBERED:
                self._forget()
                new[:] = True
            self._learn(w, keys[new], at[new])
        row = np.searchsorted(self.keys, keys)[back]
        length = self.length[row]
        sums = np.concatenate(([0], np.cumsum(length)))
        return self.flat[ragged(self.offset[row], length)], sums[w.first[1:]] - sums[w.first[:-1]]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder for each Python worker and vocabulary, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def cut(length: int, capacity: int, grain: int) -> list[int]:
    """Lengths of the pieces of a document of ``length`` ids."""
    out = [capacity] * (length // capacity)
    rest, size = length % capacity, capacity // 2
    while size >= grain:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """The open bins of one task, a bin for each class."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        used, out, total = 0, [], sum(p[2] for p in pieces)
        for p in pieces:
            out.append((*p, self.next_id, used, total))
            used += p[2]
        self.next_id += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """Put a piece (doc_id, start, length, ids, doc_tokens) into its bin; the bin's rows if that fills it."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self._close(self.open.pop(k)) if len(held) == k else []

    def rest(self) -> Iterator[list[tuple]]:
        """What open bins hold, end to end: whole sequences, then sequences of a power of two."""
        held = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(p[2] for p in held)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length() - 1)) if (total % self.capacity) >> b & 1]
        held.reverse()
        for size in sizes:
            now, room = [], size
            while room:
                doc, start, length, ids, tokens = held.pop()
                take = min(room, length)
                now.append((doc, start, take, ids[:take], tokens))
                if take < length:
                    held.append((doc, start + take, length - take, ids[take:], tokens))
                room -= take
            yield self._close(now)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, length, ids, tokens, sequence, offset, total = zip(*rows, strict=True)
    longs = [pa.array(x, pa.int64()) for x in (doc, start, length)]
    more = [pa.array(x, pa.int64()) for x in (tokens, sequence, offset, total)]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
    return pa.RecordBatch.from_arrays([*longs, pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), *more], names)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and their place in a sequence.

    ``capacity`` is a power of two, ``grain`` a power of two below it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, bins = encoder(vocabulary), Bins(capacity, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = ids_of.of(part.column("text"))
                ends = np.cumsum(counts)
                rows: list[tuple] = []
                for doc, n, end in zip(part.column("doc_id").to_pylist(), counts.tolist(), ends.tolist(), strict=True):
                    mine = np.append(ids[end - n:end], np.uint32(end_id))
                    at = 0
                    for size in cut(n + 1, capacity, grain):
                        rows += bins.add((doc, at, size, mine[at:at + size], n + 1))
                        at += size
                    if len(rows) > 2000:
                        yield _table(rows)
                        rows = []
                if rows:
                    yield _table(rows)
        for rows in bins.rest():
            yield _table(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


__all__ = ["Bins", "WordIds", "cut", "pack"]
