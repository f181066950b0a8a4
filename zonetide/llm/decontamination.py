"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A benchmark window is ten consecutive words of an item (the whole item if it is shorter); a document word inside any
occurrence of a window is hit. Seen as a set of shingles, an occurrence holds ALL shingles of the window, so a window
need only be looked up by one of them: its prefix is the shingle that is rarest in the documents. A first pass counts the
benchmark's shingles in the documents, a second looks up the prefixes, drops candidates whose window would start or
end outside the text, and checks the words of the window exactly (64-bit hash over the window and its length).

The benchmark side goes to the executors in blocks of ``BLOCK`` items, each block's index bounded; every document meets
every block, so nothing is shuffled but counts. Null or empty texts have no words and no hits; an item without words
never occurs. Repeated documents and items count each for itself. Other columns are ignored; empty tables are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.words import NOT_WORD, Rolling, Words, grams, inside_grams, ragged, slices, words_of

WINDOW = 10
SHINGLE = 5
#: Items whose windows are indexed at once.
BLOCK = 20_000
_BITS = 22
SCHEMA = "doc_id long, n_words long, n_hit long, hits array<struct<start: long, end: long>>, items array<string>"


class Index:
    """Windows of a block of items, found by their prefix shingle."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, shingle: int = SHINGLE):
        w = words_of(pa.array([t for _, t in items], pa.string()), lower=True, breaks=NOT_WORD)
        count = np.diff(w.first)
        length = np.minimum(count, window)
        number = np.where(count > 0, count - length + 1, 0)
        start = ragged(w.first[:-1], number)
        size = np.repeat(length, number)
        item = np.repeat(np.arange(len(items)), number)
        codes = Rolling(w.hash).of(start, start + size)
        self.names = [n for n, _ in items]
        # One entry for each different window, with the items that have it.
        order = np.lexsort((item, size, codes))
        codes, size, item, start = codes[order], size[order], item[order], start[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (size[1:] != size[:-1])
        head = np.flatnonzero(new)
        self.code, self.size, self.item = codes[head], size[head], item
        self.item_from, self.item_to = head, np.append(head[1:], len(codes))
        # All shingles of each window; short windows are one shingle of their own size.
        self.shingle_size = np.minimum(self.size, shingle)
        many = self.size - self.shingle_size + 1
        self.owner = np.repeat(np.arange(len(head)), many)
        self.offset = ragged(np.zeros(len(head), np.int64), many)
        at = np.repeat(start[head], many) + self.offset
        self.width = np.repeat(self.shingle_size, many)
        self.token = np.zeros(len(at), np.uint64)
        for s in np.unique(self.width):
            here = self.width == s
            self.token[here] = grams(w.hash, int(s))[at[here]]
        self.widths = [int(s) for s in np.unique(self.width)]
        self._look_up(np.arange(len(self.token)))

    def _look_up(self, chosen: np.ndarray) -> None:
        self.tables = {}
        for s in self.widths:
            mine = chosen[self.width[chosen] == s]
            mine = mine[np.argsort(self.token[mine], kind="stable")]
            tokens, first = np.unique(self.token[mine], return_index=True)
            maybe = np.zeros(1 << _BITS, bool)
            maybe[(tokens & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
            self.tables[s] = (tokens, first, np.append(first[1:], len(mine)), mine, maybe)

    def matches(self, w: Words, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Word places whose shingle of size ``s`` is in the table, and its number there."""
        tokens, *_, maybe = self.tables[s]
        at = inside_grams(w, s)
        g = grams(w.hash, s)[at]
        likely = np.flatnonzero(maybe[(g & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        at, g = at[likely], g[likely]
        if not len(tokens) or not len(g):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(tokens, g), len(tokens) - 1)
        same = tokens[k] == g
        return at[same], k[same]

    def keep_rarest(self, seen: dict[int, int]) -> None:
        """Keep one shingle of each window: the one seen least often in the documents."""
        times = np.array([seen.get(t, 0) for t in self.token.view(np.int64).tolist()], np.int64)
        order = np.lexsort((self.token, times, self.owner))
        first = np.ones(len(order), bool)
        first[1:] = self.owner[order][1:] != self.owner[order][:-1]
        self._look_up(order[first])

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Verified occurrences: first word and window number."""
        found_at, found = [], []
        rolling, doc = Rolling(w.hash), w.doc()
        for s in self.widths:
            at, k = self.matches(w, s)
            _, low, high, mine, _ = self.tables[s]
            many = high[k] - low[k]
            entry = mine[ragged(low[k], many)]
            at = np.repeat(at, many)
            window = self.owner[entry]
            begin, end = at - self.offset[entry], at - self.offset[entry] + self.size[window]
            fits = (begin >= w.first[doc[at]]) & (end <= w.first[doc[at] + 1])
            begin, end, window = begin[fits], end[fits], window[fits]
            right = rolling.of(begin, end) == self.code[window]
            found_at.append(begin[right])
            found.append(window[right])
        return np.concatenate(found_at or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])


def _words(part: pa.RecordBatch) -> Words:
    return words_of(part.column("text"), lower=True, breaks=NOT_WORD)


def _times_seen(docs: DataFrame, shared) -> dict[int, int]:
    """How often each shingle of a block occurs in the documents; bounded by the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        sums = {s: np.zeros(len(t[0]), np.int64) for s, t in index.tables.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part)
                for s in index.widths:
                    sums[s] += np.bincount(index.matches(w, s)[1], minlength=len(sums[s]))
        for s, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(index.tables[s][0].view(np.int64)[n > 0]), pa.array(n[n > 0])], ["token", "n"])

    counted = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in counted.toLocalIterator()}


def indexes(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> list:
    """Broadcast indexes of all items, a block each."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), "text").filter(F.col("text").isNotNull())
    blocks = max(1, -(-items.count() // block))
    out = []
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect()
        index = Index([(r["name"] or "", r["text"]) for r in rows], window)
        if not len(index.code):
            continue
        first = spark.sparkContext.broadcast(index)
        index.keep_rarest(_times_seen(docs, first))
        first.unpersist()
        out.append(spark.sparkContext.broadcast(index))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: its words, how many are hit, the hit ranges (word numbers, end exclusive) and the items met."""
    shared = indexes(docs, benchmark, window)
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part)
                edge = np.zeros(len(w.start) + 1, np.int32)
                items: list[set[str]] = [set() for _ in range(w.texts)]
                doc = w.doc()
                for s in shared:
                    index = s.value
                    at, window_ = index.occurrences(w)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + index.size[window_], -1)
                    pairs = np.unique(np.column_stack((doc[at], window_)), axis=0)
                    for d, x in pairs.tolist():
                        items[d].update(index.names[i] for i in index.item[index.item_from[x]:index.item_to[x]])
                hit = np.cumsum(edge[:-1]) > 0
                sums = np.concatenate(([0], np.cumsum(hit)))
                spans: list[list[dict]] = []
                for d in range(w.texts):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    if sums[a] == sums[b]:
                        spans.append([])
                        continue
                    flips = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].view(np.int8), [0]))))
                    spans.append([{"start": x, "end": y} for x, y in flips.reshape(-1, 2).tolist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(w.first)), pa.array(sums[w.first[1:]] - sums[w.first[:-1]]),
                     pa.array(spans, ranges), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    ["doc_id", "n_words", "n_hit", "hits", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all columns, in whose text no window occurs."""
    shared = indexes(docs, benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part)
                free = np.ones(w.texts, bool)
                for s in shared:
                    free[w.doc()[s.value.occurrences(w)[0]]] = False
                yield part.filter(pa.array(free))

    return docs.mapInArrow(run, docs.schema)
