"""Source divergence audit: how far the term shares of the sources of one language are apart.

Which terms a language keeps is found by iceberg prefix refinement. A term is its bytes and an end mark. A level counts, for
every language, the distinct documents that hold a prefix of ``width`` bytes, and discards prefixes in fewer than
``least`` documents; the next level, of four times the width, extends only what is left. A prefix that reaches the end mark is a
complete term. Levels go on until no open prefix is left, so their number is the logarithm of the longest kept term, and a
rare term is never shuffled beyond the prefix that is rare. Every level reads the documents anew and counts within a task
before it shuffles; nothing but the surviving prefixes is stored.

The survivors reach the next level as a bit table of bounded size, broadcast. Two prefixes may share a bit: then a
rare one is extended in vain and discarded by its own exact count. The result does not depend on the size of the table.

The kept terms are then counted by source, and blocks of terms are turned into shares of every source for the sums over
terms. Shares and gaps are whole numbers, worked out without rounding.

A document is a row: repeated rows are documents of their own. Null text, lang and source: empty. A language without kept
terms gives pairs of value 0. Ties: by item, in byte order. The number of pairs is the square of a language's number
of sources, as asked for. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonetide.llm.words import _BASE, _BYTE, _STEP, _powers, mix, ragged, signed, slices, text_bytes, words_of
from zonetide.session import written

LEAST = 10
#: Bytes of the first level's prefixes; each further level has four times as many.
WIDTH = 8
#: Bits of the table of survivors: 32 for each, but no fewer and no more than these.
FEWEST_BITS, MOST_BITS = 1 << 15, 1 << 26
SCALE = 1_000_000_000
TOP = 10
#: Rows of (source, term) in one group of the last step, on average.
BLOCK = 200_000
#: Bytes of text looked at together.
_SLICE = 12 << 20
#: Shares held at a time by a task, terms times sources.
_CELLS = 2_000_000
NOT_TERM = np.ones(256, bool)
NOT_TERM[0x41:0x5B] = NOT_TERM[0x61:0x7B] = NOT_TERM[0x80:] = False
FOUND = "lang string, prefix binary, complete boolean, slot long, twin long, docs long"
COUNTS = "slot long, twin long, source string, n long"
PARTS = "lang string, source string, part string, item string, value long"


class Coded:
    """Strings as numbers: ``code`` of each row into ``values``, whose bytes are ``data`` between ``offset`` and ``offset + length``."""

    def __init__(self, strings: pa.Array):
        coded = strings.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = coded.dictionary
        self.data, bounds = _bytes(self.values)
        self.offset, self.length = bounds[:-1], np.diff(bounds)

    def __len__(self) -> int:
        return len(self.values)


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if pa.types.is_large_binary(strings.type):
        bounds = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1 + strings.offset)[strings.offset:]
        buffer = strings.buffers()[2]
        return (np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)), bounds
    return text_bytes(strings)


def _binary(data: np.ndarray, length: np.ndarray) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def _cut(terms: Coded, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The first ``width`` bytes (None: all) of every coded term and its end mark, a zero byte: bytes and lengths."""
    whole = terms.length + 1
    length = whole if width is None else np.minimum(whole, width)
    data = np.append(terms.data, np.uint8(0))[ragged(terms.offset, length)]
    data[np.cumsum(length)[length == whole] - 1] = 0
    return data, length


def _hash(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Two numbers of 64 bits for each string of bytes, none of them empty."""
    if not len(length):
        return np.zeros((2, 0), np.uint64)
    skip = np.cumsum(length) - length
    at = np.arange(len(data), dtype=np.int64) - np.repeat(skip, length)
    size = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        both = [np.add.reduceat((_BYTE[data] ^ np.uint64(salt)) * _powers(base, int(length.max()))[at], skip) + size for salt, base in ((1, _BASE), (2, _STEP))]
        return np.stack([mix(h) for h in both])


def _lang_hash(langs: Coded) -> np.ndarray:
    return _hash(*_cut(langs, None))


def _slots(langs: np.ndarray, lang: np.ndarray, terms: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Two numbers for each pair of a language and a term (or prefix), which stand for them: 128 bits in all."""
    with np.errstate(over="ignore"):
        return mix(langs[:, lang] * np.uint64(3) ^ terms[:, term])


class Bits:
    """Which slots survive. ``size`` is a power of two."""

    def __init__(self, size: int, table: bytes):
        self.size, self.table = np.uint64(size), np.frombuffer(table, np.uint8)

    def has(self, slots: np.ndarray) -> np.ndarray:
        at = slots & (self.size - np.uint64(1))
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


class Words:
    """The terms of a slice of documents: place and document of each; the coded language and source of each document."""

    def __init__(self, batch: pa.RecordBatch):
        found = words_of(batch.column("text"), lower=True, breaks=NOT_TERM, hashed=False)
        self.data, self.start, self.length, self.doc = found.data, found.start, found.end - found.start, found.doc()
        self.lang = Coded(pc.fill_null(batch.column("lang").cast(pa.large_string()), ""))
        self.langs = _lang_hash(self.lang)

    def prefixes(self, which: np.ndarray, width: int) -> Coded:
        """The coded prefixes, end mark included, of the terms ``which``."""
        start, length = self.start[which], self.length[which]
        if width > 8:
            terms = Coded(_binary(self.data[ragged(start, length)], length))
            out = Coded(_binary(*_cut(terms, width)))
            out.code = out.code[terms.code]
            return out
        # Up to eight bytes fit a number; what lies behind a term's end is zero.
        eight = np.ndarray((len(self.data) + 1,), "<u8", np.concatenate((self.data, np.zeros(8, np.uint8))), strides=(1,))
        code, numbers = pd.factorize(eight[start] & _FIRST[np.minimum(length, width)])
        rows = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)
        size = np.minimum((rows[:, :width] != 0).sum(1) + 1, width)
        out = Coded(_binary(rows[np.arange(8) < size[:, None]], size))
        out.code = code  # the prefixes differ, so coding them once more has numbered them in their order
        return out


#: Masks of a number's first bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def _slice_prefixes(w: Words, before: int, width: int, left: Bits | None) -> pa.RecordBatch:
    """Documents by language and prefix in one slice. ``before``: width of the level before, whose survivors are ``left``."""
    open_ = np.flatnonzero(w.length >= before)  # the others were complete before
    prefixes = w.prefixes(open_, width)
    size = max(1, len(prefixes))
    once = _distinct(w.doc[open_] * size + prefixes.code)  # a prefix counts once in a document
    pair, docs = np.unique(w.lang.code[once // size] * size + once % size, return_counts=True)
    lang, prefix = pair // size, pair % size
    if left is not None and len(pair):
        parent = np.full(len(prefixes), before)
        parents = _hash(prefixes.data[ragged(prefixes.offset, parent)], parent)
        keep = left.has(_slots(w.langs, lang, parents, prefix)[0])
        lang, prefix, docs = lang[keep], prefix[keep], docs[keep]
    ends = prefixes.offset + prefixes.length - 1
    complete = prefixes.data[ends] == 0 if len(ends) else np.zeros(0, bool)
    slot, twin = _slots(w.langs, lang, _hash(prefixes.data, prefixes.length), prefix)
    return pa.RecordBatch.from_arrays([
        w.lang.values.take(pa.array(lang)).cast(pa.string()), prefixes.values.take(pa.array(prefix)).cast(pa.binary()),
        pa.array(complete[prefix]), pa.array(signed(slot)), pa.array(signed(twin)), pa.array(docs.astype(np.int64))],
        names=["lang", "prefix", "complete", "slot", "twin", "docs"])


def level(docs: DataFrame, before: int, width: int, left, least: int) -> DataFrame:
    """Prefixes of ``width`` bytes in at least ``least`` documents of a language. ``left``: a broadcast of ``Bits``, or None."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                yield _slice_prefixes(Words(part), before, width, left.value if left else None)

    counted = docs.select("lang", "text").mapInArrow(prefixes, FOUND)
    same = [F.first(c).alias(c) for c in ("complete", "slot", "twin")]
    return (counted.groupBy("lang", "prefix").agg(*same, F.sum("docs").alias("docs"))
            .filter(F.col("docs") >= least))


def bits_of(slots: DataFrame):
    """A broadcast of the slots' bits and their number of rows. What the driver gets is at most ``MOST_BITS`` bits."""
    spark = slots.sparkSession
    n = slots.count()
    size = min(MOST_BITS, max(FEWEST_BITS, 1 << (32 * n - 1).bit_length())) if n else FEWEST_BITS
    at = F.col("slot").bitwiseAND(F.lit(size - 1)) + 1  # the functions below count from 1
    rows = (slots.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect())
    table = bytearray(size // 8)
    for r in rows:
        start = (r["b"] - 1) * 4096
        table[start:start + 4096] = r["bits"][:len(table) - start]
    return spark.sparkContext.broadcast(Bits(size, bytes(table))), n


def kept_terms(docs: DataFrame, least: int = LEAST, width: int = WIDTH) -> DataFrame:
    """(lang, term, slot, twin) of the terms in at least ``least`` documents of their language."""
    complete, left, before = [], None, 0
    while True:
        found = written(level(docs, before, width, left, least), "prefixes")
        complete.append(found.filter("complete"))
        left, open_ = bits_of(found.filter("not complete"))
        if not open_:
            break
        before, width = width, 4 * width
    every = reduce(DataFrame.unionByName, complete)
    return every.select("lang", F.expr("substring(prefix, 1, length(prefix) - 1)").cast("string").alias("term"), "slot", "twin")


def _slice_counts(batch: pa.RecordBatch, kept: Bits) -> pa.RecordBatch:
    w = Words(batch)
    terms = Coded(_binary(w.data[~NOT_TERM[w.data]], w.length))
    sources = Coded(pc.fill_null(batch.column("source").cast(pa.large_string()), ""))
    groups, group = np.unique(w.lang.code * len(sources) + sources.code, return_inverse=True)
    size = max(1, len(terms))
    pair, n = np.unique(group[w.doc] * size + terms.code, return_counts=True)
    lang, source = np.divmod(groups[pair // size], max(1, len(sources)))
    slot, twin = _slots(w.langs, lang, _hash(*_cut(terms, None)), pair % size)
    keep = kept.has(slot)
    return pa.RecordBatch.from_arrays([
        pa.array(signed(slot[keep])), pa.array(signed(twin[keep])), sources.values.take(pa.array(source[keep])).cast(pa.string()),
        pa.array(n[keep].astype(np.int64))], names=["slot", "twin", "source", "n"])


def source_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n > 0): occurrences of the kept terms."""
    table, _ = bits_of(kept)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                yield _slice_counts(part, table.value)

    found = docs.select("lang", "source", "text").mapInArrow(counts, COUNTS).groupBy("slot", "twin", "source").agg(F.sum("n").alias("n"))
    return found.join(kept, ["slot", "twin"]).select("lang", "source", "term", "n")


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), by long division in steps that fit 64 bits."""
    below = np.asarray(total, np.int64) + 2 * terms
    if below.size and int(below.max()) >= 1 << 49:
        raise OverflowError("more term occurrences in a group than 64-bit steps can divide exactly")
    rest, out = np.broadcast_to(count + 2, np.broadcast_shapes(count.shape, below.shape)), 0
    for factor in (10_000, 10_000, 10):
        whole, rest = np.divmod(rest * factor, below)
        out = out * factor + whole
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _block(counts: pd.DataFrame, lang: str, sources: list[str], totals: np.ndarray, terms: int) -> Iterator[tuple]:
    """Sums over a block of terms by pair of sources, and the terms that stand out most in a source."""
    number = {s: i for i, s in enumerate(sources)}
    source = counts["source"].map(number).to_numpy(np.int64)
    code, names = pd.factorize(counts["term"], sort=False)
    n, many = counts["n"].to_numpy(np.int64), len(sources)
    order = np.argsort(code, kind="stable")
    sums, best = {}, {}
    step = max(1, _CELLS // many)
    for low in range(0, len(names), step):
        high = min(len(names), low + step)
        at = order[np.searchsorted(code[order], low):np.searchsorted(code[order], high)]
        table = np.zeros((high - low, many), np.int64)
        table[code[at] - low, source[at]] = n[at]
        p = shares(table, totals[None, :], terms)
        q = shares(table.sum(1), int(totals.sum()), terms)
        for i in range(many - 1):
            sums[i] = sums.get(i, 0) + gaps(p[:, i:i + 1], p[:, i + 1:]).sum(0)
        for i in range(many):
            here = np.flatnonzero((table[:, i] > 0) & (p[:, i] > q))
            value = gaps(p[here, i], q[here])
            if len(here) > TOP:  # all that tie with the last one stay in
                top = value >= np.partition(value, len(value) - TOP)[len(value) - TOP]
                here, value = here[top], value[top]
            rows = best.get(i, []) + [(-int(v), names[low + k].encode(), names[low + k]) for k, v in zip(here, value, strict=True)]
            best[i] = sorted(rows)[:TOP]
    for i, row in sums.items():
        for j, value in enumerate(row, start=i + 1):
            yield lang, sources[i], "pair", sources[j], int(value)
    for i, rows in best.items():
        for minus, _, term in rows:
            yield lang, sources[i], "term", term, -minus


def _block_frame(counts: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in PARTS.split(", ")]
    if counts.empty or stats.empty:
        return pd.DataFrame(columns=names)
    one = stats.iloc[0]
    totals = np.array([x["n"] for x in one["sources"]], np.int64)
    rows = _block(counts, one["lang"], [x["source"] for x in one["sources"]], totals, int(one["terms"]))
    return pd.DataFrame(rows, columns=names)


def audit(docs: DataFrame, least: int = LEAST, width: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value, rank; see the query's contract. ``docs``: text, lang, source."""
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    kept = kept_terms(named, least, width)
    counts = written(source_counts(named, kept), "counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stats = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"))  # one entry a source
    stats = written(stats.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0))), "stats")
    # A language's terms are dealt out over so many groups, also where it has nearly all of them.
    parts = max(64, -(-counts.count() // BLOCK))
    dealt = counts.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(parts)))
    copies = stats.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    blocks = written(dealt.groupBy("lang", "salt").cogroup(copies.groupBy("lang", "salt"))
                     .applyInPandas(lambda a, b: _block_frame(a, b), PARTS), "divergence")
    sums = blocks.filter("part = 'pair'").groupBy("lang", F.col("source").alias("a"), F.col("item").alias("b")).agg(F.sum("value").alias("value"))
    pairs = (stats.select("lang", F.explode("sources.source").alias("source"), "sources").select("lang", "source", F.explode("sources.source").alias("item"))
             .filter("source <> item").withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")})
             .join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = blocks.filter("part = 'term'").select(*pairs.columns).withColumn("rank", place).filter(F.col("rank") <= TOP)
    return pairs.withColumn("rank", place).unionByName(terms)
