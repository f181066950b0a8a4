"""Substring dedup by recompression.

Words are symbols. A round first names runs of one symbol (symbol and number), then pairs: a hash of the name puts every
symbol in a left or a right class, and a left symbol followed by a right one becomes a new symbol, named by a hash of
both names. A name is a function of what it stands for, so all tasks name alike and equal substrings get equal
symbols except near their ends, where the surroundings decide. For each symbol and each gap between symbols the range
of words that decided it is kept along.

A window of ``WINDOW`` words is looked up by one gap of its own: of the gaps that its words alone decide, one of the
highest round, of those the one with the smallest hash of the symbols on both sides. Equal windows choose the same
gap. Neighbouring windows mostly share theirs, so there are few anchors: (key of the gap, hash of all words of its
windows). Spark counts the keys. Where all anchors of a key agree in all words, their windows are repeated; where they do
not, the windows of one anchor of each kind are compared one by one (two 64-bit hashes of all words).

Gaps of round 0 are decided by the words next to them, so every window has one and no repeat is lost. Null or empty
text: no words. Repeated rows repeat each other. Rows are told apart by a hash of doc_id and text. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.words import Rolling, Words, mix, ragged, signed, slices, words_of
from zonetide.session import written

WINDOW = 35
ROUNDS = 3
#: Words on each side of a gap that are part of its key.
SIDE = 5
_RUN, _PAIR, _CLASS = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Parse:
    """The symbols of one round, with the gap before each: names, and the half-open ranges of words that decided them."""

    def __init__(self, w: Words):
        n = len(w.hash)
        at = np.arange(n)
        self.name, self.start = w.hash, at
        self.low, self.high = at, at + 1
        self.gap_low, self.gap_high = at - 1, at + 1
        self.first = np.zeros(n, bool)
        self.first[w.first[:-1][np.diff(w.first) > 0]] = True

    def _neighbours(self, outside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Low of the symbol to the left, high of the one to the right, and who is a text's last; past an end: out of reach."""
        low, high = np.empty_like(self.low), np.empty_like(self.high)
        last = np.ones(len(self.name), bool)
        last[:-1] = self.first[1:]
        low[1:], high[:-1] = self.low[:-1], self.high[1:]
        low[self.first], high[last] = -outside, outside
        return low, high, last

    def _gaps(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the gaps once the classes or names on both sides have been looked at."""
        before_high = np.concatenate(([0], self.high[:-1]))
        return (np.minimum(np.minimum(self.gap_low, left), self.low), np.maximum(np.maximum(self.gap_high, before_high), self.high))

    def _take(self, heads: np.ndarray, name, low, high, gaps) -> None:
        self.name, self.low, self.high = name, low, high
        self.gap_low, self.gap_high = gaps[0][heads], gaps[1][heads]
        self.start, self.first = self.start[heads], self.first[heads]

    def runs(self, outside: int) -> None:
        left, right, last = self._neighbours(outside)
        head = self.first.copy()
        head[1:] |= self.name[1:] != self.name[:-1]
        heads = np.flatnonzero(head)
        ends = np.append(heads[1:], len(head))
        count = (ends - heads).astype(np.uint64)
        name = np.where(count > 1, mix(self.name[heads] + count * _RUN), self.name[heads])
        low = np.minimum(np.minimum.reduceat(self.low, heads), left[heads])
        high = np.maximum(np.maximum.reduceat(self.high, heads), right[ends - 1])
        self._take(heads, name, low, high, self._gaps(left))

    def pairs(self, number: int, outside: int) -> None:
        left, right, last = self._neighbours(outside)
        is_right = (mix(self.name ^ np.uint64(int(_CLASS) * (number + 1) % (1 << 64))) >> np.uint64(63)).astype(bool)
        merged = np.zeros(len(self.name), bool)  # with the next one
        merged[:-1] = ~is_right[:-1] & is_right[1:] & ~self.first[1:]
        taken = np.concatenate(([False], merged[:-1]))
        heads = np.flatnonzero(~taken)
        after = np.minimum(heads + 1, len(self.name) - 1)
        both, rest = merged[heads], is_right[heads]
        name = np.where(both, mix(self.name[heads] * _PAIR + self.name[after]), self.name[heads])
        # A lone left symbol was decided with the one after it, a lone right symbol with the one before.
        low = np.where(rest, np.minimum(self.low[heads], left[heads]), np.where(both | ~last[heads], np.minimum(self.low[heads], self.low[after]), self.low[heads]))
        high = np.where(rest, self.high[heads], np.where(both, np.maximum(self.high[heads], self.high[after]), np.maximum(self.high[heads], right[heads])))
        high = np.where(rest & ~self.first[heads], np.maximum(high, self.high[np.maximum(heads - 1, 0)]), high)
        self._take(heads, name, low, high, self._gaps(left))


def anchors(w: Words, window: int = WINDOW, rounds: int = ROUNDS, side: int = SIDE) -> tuple[np.ndarray, ...]:
    """For runs of windows with one gap: text, first window (word number in the batch), windows, key and hash of all words."""
    n = len(w.hash)
    empty = tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    count = np.diff(w.first)
    if n == 0 or count.max() < window:
        return empty
    doc_first, doc_end = np.repeat(w.first[:-1], count), np.repeat(w.first[1:], count)
    open_ = np.arange(n) + window <= doc_end
    parse, outside = Parse(w), 4 * n
    levels = [(parse.start, parse.gap_low, parse.gap_high, parse.name, parse.first)]
    for r in range(rounds):
        parse.runs(outside)
        parse.pairs(r, outside)
        levels.append((parse.start, parse.gap_low, parse.gap_high, parse.name, parse.first))
    rolling = Rolling(w.hash)
    place, key = np.full(n, -1, np.int64), np.zeros(n, np.uint64)
    best = np.full(n, _NONE, np.uint64)
    for level in range(rounds, -1, -1):
        at, low, high, name, first = levels[level]
        todo = np.concatenate(([0], np.cumsum(open_)))
        if not todo[-1]:
            break
        before = np.concatenate((name[:1], name[:-1]))
        a = np.maximum(np.maximum(high - window, at + side - window), doc_first[at])
        b = np.minimum(np.minimum(low, at - side), doc_end[at] - window)
        use = np.flatnonzero(~first & (a <= b))
        use = use[todo[b[use] + 1] > todo[a[use]]]
        at, a, b = at[use], a[use], b[use]
        tie = mix(before[use] * _PAIR ^ name[use])
        chosen = np.full(n, -1, np.int64)
        for t in range(side, window - side + 1):  # the gap is the t-th of the window; leftmost first
            p = at - t
            k = np.flatnonzero((p >= a) & (p <= b))
            p = p[k]
            k2 = open_[p] & (tie[k] < best[p])
            p, k = p[k2], k[k2]
            best[p] = tie[k]
            chosen[p] = k
        got = np.flatnonzero(chosen >= 0)
        k = chosen[got]
        place[got] = at[k]
        content = rolling.of(at - side, at + side)
        key[got] = mix(tie[k] ^ (content[k] * _RUN + np.uint64(level)))
        open_[got] = False
    p = np.flatnonzero(place >= 0)
    head = np.ones(len(p), bool)
    head[1:] = (p[1:] != p[:-1] + 1) | (place[p[1:]] != place[p[:-1]]) | (key[p[1:]] != key[p[:-1]])
    heads = np.flatnonzero(head)
    begin, many = p[heads], np.diff(np.append(heads, len(p)))
    seg = mix(rolling.of(begin, begin + many + window - 1) + (place[begin] - begin).astype(np.uint64) * _RUN)
    doc = np.searchsorted(w.first, begin, side="right") - 1
    return doc, begin, many, key[begin], seg


def _row(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def anchor_table(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 3 << 20):
                w = words_of(part.column("text"))
                doc, begin, many, key, seg = anchors(w, window)
                row = part.column("row").to_numpy()[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), pa.array(signed(seg)), pa.array(row), pa.array((begin - w.first[doc]).astype(np.int32)), pa.array(many.astype(np.int32))],
                    ["key", "seg", "row", "p", "m"])

    return _row(docs).select("row", "text").mapInArrow(run, "key long, seg long, row long, p int, m int")


def _lists(rows: DataFrame) -> DataFrame:
    """The ranges of each row; a text's length bounds their number."""
    return rows.groupBy("row").agg(F.collect_list(F.struct("p", "m")).alias("at"))


def _starts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first window and number of windows of lists of ranges (null: none)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    many = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
    return np.repeat(np.arange(len(many)), many), flat.field("p").to_numpy().astype(np.int64), flat.field("m").to_numpy().astype(np.int64)


def _window_hashes(docs: DataFrame, lists: DataFrame, window: int) -> DataFrame:
    """Two hashes of each window named in ``lists``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 3 << 20):
                w = words_of(part.column("text"))
                doc, p, m = _starts(part.column("at"))
                at = ragged(w.first[doc] + p, m)
                doc = np.repeat(doc, m)
                x, y = Rolling(w.hash).of(at, at + window), Rolling(mix(w.hash ^ _RUN), 0x2545F4914F6CDD1D).of(at, at + window)
                yield pa.RecordBatch.from_arrays([pa.array(signed(x)), pa.array(signed(y)), pa.array(part.column("row").to_numpy()[doc]),
                                                  pa.array((at - w.first[doc]).astype(np.int32))], ["x", "y", "row", "p"])

    return _row(docs).select("row", "text").join(lists, "row").select("row", "text", "at").mapInArrow(run, "x long, y long, row long, p int")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, p, m): windows p ... p + m - 1 of a row whose words also start somewhere else."""
    found = written(anchor_table(docs, window), "anchors")
    # Key lists are written before they are joined: a join of two plain shuffles may split a hot key's rows.
    again = written(found.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key"), "keys")
    again = written(found.join(again, "key"), "repeats")
    kinds = again.groupBy("key", "seg").agg(F.count("*").alias("k"), F.min(F.struct("row", "p", "m")).alias("one"))
    kinds = written(kinds, "kinds")
    alike = again.join(written(kinds.filter("k > 1").select("key", "seg"), "alike"), ["key", "seg"]).select("row", "p", "m")
    differ = written(kinds.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "differ")
    ones = kinds.join(differ, "key").select("one.*")
    hashes = written(_window_hashes(docs, _lists(ones), window).distinct(), "windows")
    twice = written(hashes.groupBy("x", "y").agg(F.count("*").alias("k")).filter("k > 1").select("x", "y"), "twice")
    single = hashes.join(twice, ["x", "y"]).select("row", "p", F.lit(1).alias("m"))
    return alike.union(single)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, and ``kept``, the words left joined by one space."""
    lists = _lists(repeated_windows(docs, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 3 << 20):
                w = words_of(part.column("text"))
                doc, p, m = _starts(part.column("at"))
                edge = np.zeros(len(w.start) + 1, np.int32)
                np.add.at(edge, w.first[doc] + p, 1)
                np.add.at(edge, w.first[doc] + p + m + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                sums = np.concatenate(([0], np.cumsum(gone)))
                removed = sums[w.first[1:]] - sums[w.first[:-1]]
                # Each kept word with one space behind it; the last space of a text is cut off.
                left = np.flatnonzero(~gone)
                size = w.end[left] - w.start[left] + 1
                text = w.data[np.minimum(ragged(w.start[left], size), max(len(w.data) - 1, 0))] if len(left) else w.data[:0].copy()
                text[np.cumsum(size) - 1] = 0x20
                ends = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(left, w.first)]
                raw = text.tobytes()
                kept = [raw[a:b - 1].decode() if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(w.first)), pa.array(removed), pa.array(kept, pa.string())],
                                                 ["doc_id", "n_words", "n_removed", "kept"])

    joined = _row(docs).join(lists, "row", "left").select("doc_id", "text", "at")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
