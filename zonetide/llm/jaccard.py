"""n-gram Jaccard join of documents in the Jaccard metric space.

A document is the set of its distinct ``n``-word shingles (fewer words: the whole sequence is its only shingle). Two
link when their Jaccard similarity reaches ``percent``; the distance ``1 - similarity`` is a metric.

1. Equal sets are one class; only classes go on.
2. Shingles are ranked, rare ones first (a bounded list of frequent ones is counted, all others rank before it by
   hash). Linked classes share a shingle of each other's prefix, the first ``n - ceil(0.85 n) + 1`` of a set. The classes
   that have a prefix shingle in common elect the one with the fewest rarer shingles as their pivot; those that lie
   within reach of a pivot make up its region. Each linked pair shares a region.
3. A class's distances to 256 fixed pivots (its shingles counted by hash class) bound its distance to any other from
   below. Members of a region that these windows part from every other member are left out before texts are fetched.
4. A region is split among pivots into Voronoi cells. Document ``y`` also goes to the cell of pivot ``p`` if
   ``d(y, p) <= d(y, nearest) + 2 r``, ``r`` the largest linked distance: by the triangle inequality its partners at home in
   that cell are met there. Cells are split again as long as that makes them clearly smaller.
5. In a small cell documents outside the largest component so far are compared with all others, exactly. So a group
   of near copies costs a comparison with a few pivots each, not all pairs.
6. A region over ``REGION`` members is dealt out in blocks; each pair of blocks is joined as a region of its own.
7. Links of classes are merged to components.

Hashes are 64 bits wide; similarities are counted on whole sets. Null or empty text: no shingles, linked with nothing.
Repeated rows have equal sets. Of two rows with one ``doc_id`` each keeps its own set. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.links import components
from zonetide.llm.words import grams, inside_grams, mix, ragged, signed, slices, words_of
from zonetide.session import written

SHINGLE = 4
PERCENT = 85
#: Members of a region that one task takes at once.
REGION = 1500
#: Frequent shingles that are ranked by their count; the rest rank by hash. Any list gives the same links.
FREQUENT = 200_000
_LEAF, _PIVOTS = 64, 6


def sets_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, and the bounds of each text's: ``tokens[bounds[d]:bounds[d + 1]]``."""
    w = words_of(texts, lower=True)
    count, doc = np.diff(w.first), w.doc()
    at = inside_grams(w, n)
    tokens, owner = [grams(w.hash, n)[at]], [doc[at]]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        tokens.append(grams(w.hash, k)[w.first[short]] + np.uint64(k) if len(short) else np.zeros(0, np.uint64))
        owner.append(short)
    token, own = np.concatenate(tokens), np.concatenate(owner)
    order = np.lexsort((token, own))
    token, own = token[order], own[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
    token, own = token[new], own[new]
    return token, np.searchsorted(own, np.arange(len(texts) + 1))


def _codes(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; empty sets have 0."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)))
    size = np.diff(bounds)
    return np.where(size > 0, mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64)), 0).astype(np.uint64)


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``FREQUENT`` shingles with counts: those that come in three documents or more of some part, the commonest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, times = np.unique(sets_of(part.column("text"), n)[0], return_counts=True)
                often = times >= 3
                yield pa.RecordBatch.from_arrays([pa.array(signed(tokens[often])), pa.array(times[often])], ["token", "n"])

    seen = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = seen.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("n").to_numpy()[order]


def shingle_table(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per document: size of its set, its class, and the prefix of the set as packed 64-bit numbers in rank order."""
    common = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = common.value
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, bounds = sets_of(part.column("text"), n)
                size = np.diff(bounds)
                rank = np.zeros(len(tokens), np.int64)
                if len(known):
                    k = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    rank = np.where(known[k] == tokens, times[k], 0)
                owner = np.repeat(np.arange(len(size)), size)
                ranked = tokens[np.lexsort((tokens, rank, owner))]
                prefix = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
                at = owner * 256 + (tokens >> np.uint64(20) & np.uint64(255)).astype(np.int64)
                sketch = np.minimum(np.bincount(at, minlength=256 * len(size)), 255).astype(np.uint8).reshape(-1, 256)
                packed = [ranked[a:a + k].tobytes() for a, k in zip(bounds[:-1].tolist(), prefix.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(signed(_codes(tokens, bounds))), pa.array(packed, pa.binary()),
                     pa.array([x.tobytes() for x in sketch], pa.binary())],
                    ["doc_id", "n", "c", "prefix", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, c long, prefix binary, sketch binary")


def _places(classes: DataFrame) -> DataFrame:
    """A row for each prefix shingle ``s`` of a class, with its place ``i`` in rank order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                raw = [x.as_py() for x in part.column("prefix")]
                many = np.array([len(x) // 8 for x in raw], np.int64)
                tokens = np.frombuffer(b"".join(raw), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens), pa.array(ragged(np.zeros(len(many), np.int64), many).astype(np.int32)),
                     pa.array(np.repeat(part.column("c").to_numpy(), many)), pa.array(np.repeat(part.column("n").to_numpy(), many).astype(np.int32))],
                    ["s", "i", "c", "n"])

    return classes.select("c", "n", "prefix").mapInArrow(run, "s long, i int, c long, n int")


def _regions(places: DataFrame, percent: int) -> DataFrame:
    """(p, c): classes within reach of pivot ``p``. Rows of a shingle pass by in order, the pivot first; none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # shingle, pivot and place of the pivot at the end of the batch before
        for batch in batches:
            if not batch.num_rows:
                continue
            s, i, c, n = (x.to_numpy() for x in batch.columns)
            head = np.ones(len(s), bool)
            head[1:] = s[1:] != s[:-1]
            carried = last is not None and last[0] == s[0]
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            pivot, place = c[first], i[first].astype(np.int64)
            if carried:
                same = first == 0
                pivot, place = np.where(same, last[1], pivot), np.where(same, last[2], place)
            last = s[-1], pivot[-1], place[-1]
            # Shingles before the first common one are in one set only, so they count as a part of the distance.
            near = (c != pivot) & (percent * (i + place) <= (100 - percent) * n.astype(np.int64))
            pairs = np.unique(np.column_stack((pivot[near], c[near])), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["p", "c"])

    dealt = places.repartition("s").sortWithinPartitions("s", "i", "c")
    found = dealt.mapInArrow(run, "p long, c long").distinct()
    return found.union(found.select("p", F.col("p").alias("c")).distinct())


class Region:
    """Sets of one region, and the links found in it, kept as a forest."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, percent: int):
        _, self.tokens = np.unique(tokens, return_inverse=True)
        self.bounds, self.size, self.percent = bounds, np.diff(bounds), percent
        self.mark = np.zeros(int(self.tokens.max()) + 1 if len(self.tokens) else 1, np.int64)
        self.root = np.arange(len(self.size))
        self.links: list[tuple[int, int]] = []
        self.reach = 1 - percent / 100

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of ``x`` with others; no set is empty."""
        mine = self.tokens[self.bounds[x]:self.bounds[x + 1]]
        self.mark[mine] = 1
        size = self.size[others]
        out = np.add.reduceat(self.mark[self.tokens[ragged(self.bounds[others], size)]], np.cumsum(size) - size)
        self.mark[mine] = 0
        return out

    def distance(self, x: int, others: np.ndarray) -> np.ndarray:
        both = self.common(x, others)
        return 1 - both / (self.size[x] + self.size[others] - both)

    def compare(self, x: int, others: np.ndarray) -> None:
        """Link ``x`` to those of ``others`` that are near enough; one link for each component is kept."""
        near = (100 * self.size[others] >= self.percent * self.size[x]) & (100 * self.size[x] >= self.percent * self.size[others])
        others = others[near & (self.root[others] != self.root[x])]
        if not len(others):
            return
        both = self.common(x, others)
        linked = others[100 * both >= self.percent * (self.size[x] + self.size[others] - both)]
        roots, first = np.unique(self.root[linked], return_index=True)
        self.links += [(x, int(y)) for y in linked[first]]
        self.root[np.isin(self.root, roots)] = self.root[x]

    def leaf(self, members: np.ndarray) -> None:
        """All that is not in the largest component so far meets every other member."""
        done = np.zeros(len(members), bool)
        while not done.all():
            roots, times = np.unique(self.root[members], return_counts=True)
            largest = roots[times.argmax()] if times.max() > 1 else -1
            left = np.flatnonzero(~done & (self.root[members] != largest))
            if not len(left):
                return
            done[left[0]] = True
            self.compare(int(members[left[0]]), members)

    def join(self, members: np.ndarray) -> None:
        if len(members) <= _LEAF:
            return self.leaf(members)
        pivots = [int(members[0])]
        nearest = self.distance(pivots[0], members)
        table = [nearest]
        while len(pivots) < _PIVOTS and nearest.max() > self.reach:
            pivots.append(int(members[int(nearest.argmax())]))
            table.append(self.distance(pivots[-1], members))
            nearest = np.minimum(nearest, table[-1])
        home = np.argmin(table, axis=0)
        cells = [members[d <= nearest + 2 * self.reach + 1e-9] for k, d in enumerate(table) if (home == k).any()]
        # Cells that hardly shrink, or overlap much, would be worked on again and again.
        if max(map(len, cells)) > 0.75 * len(members) or sum(map(len, cells)) > 1.25 * len(members):
            return self.leaf(members)
        for cell in cells:
            self.join(cell)
        return None


def _members_links(table: pa.Table, n: int, percent: int) -> pa.Table:
    tokens, bounds = sets_of(table.column("text").combine_chunks(), n)
    c = signed(_codes(tokens, bounds))
    right = np.flatnonzero((c == table.column("c").to_numpy()) & (np.diff(bounds) > 0))
    _, first = np.unique(c[right], return_index=True)
    region = Region(tokens, bounds, percent)
    # The pivot leads, so that most of a group of copies is settled by the first comparison.
    members = right[first]
    lead = c[members] == table.column("p")[0].as_py()
    members = np.concatenate((members[lead], members[~lead]))
    region.join(members)
    a, b = ([c[x[k]] for x in region.links] for k in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _with_partner(key, table, percent: int):
    """Members of a region that the windows leave at least one possible partner."""
    n, c = table.column("n").to_numpy(), table.column("c")
    counts = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16)
    kept = np.zeros(len(n), bool)
    for at in range(0, len(n), 16):
        apart = np.abs(counts[at:at + 16, None, :] - counts[None, :, :]).sum(2, dtype=np.int64)
        may = (100 + percent) * apart <= (100 - percent) * (n[at:at + 16, None] + n[None, :])
        may[np.arange(len(may)), at + np.arange(len(may))] = False
        kept[at:at + 16] = may.any(1)
    rows = int(kept.sum())
    return pa.table({**{k: pa.array([v.as_py()] * rows, pa.int64() if k == "p" else pa.int32()) for k, v in zip("pbo", key, strict=True)}, "c": c.filter(pa.array(kept))})


def class_links(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between classes of equal sets: enough of them to join every component."""
    classes = sets.filter("n > 0").groupBy("c", "n").agg(F.min("doc_id").alias("doc_id"), F.first("prefix").alias("prefix"))
    regions = written(_regions(_places(classes), percent), "regions")
    size = written(regions.groupBy("p").agg(F.count("*").alias("m")), "sizes")  # so that the join may split a hot pivot
    held = regions.join(size, "p").withColumn("g", F.ceil(F.col("m") / REGION).cast("int"))
    block = F.pmod(F.xxhash64("c"), F.col("g")).cast("int")
    dealt = held.select("p", "c", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    dealt = dealt.select("p", "c", F.least("b", "o").alias("b"), F.greatest("b", "o").alias("o"))
    known = sets.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    windows = lambda key, table: _with_partner(key, table, percent)
    dealt = dealt.join(known.select("c", "n", "sketch"), "c").groupBy("p", "b", "o").applyInArrow(windows, "p long, b int, o int, c long")
    dealt = written(dealt, "members")
    wanted = dealt.select("c").distinct().join(known.select("c", "doc_id"), "c")
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(wanted, F.col("_id") == F.col("doc_id")).select("c", "text")
    join = lambda table: _members_links(table, n, percent)
    return dealt.join(texts, "c").select("p", "b", "o", "c", "text").groupBy("p", "b", "o").applyInArrow(join, "a long, b long")


def join(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id that links lead to."""
    sets = written(shingle_table(docs, n, percent), "sets")
    classes = sets.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("low"))
    roots = components(class_links(docs, sets, n, percent))
    rooted = classes.join(roots, F.col("c") == F.col("node"), "left").select("c", "low", F.coalesce("root", "c").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("c", "component_id")
    return sets.select("doc_id", "n", "c").join(named, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group of linked ones, the one with the smallest doc_id; all columns of ``docs``.

    Of several rows with one doc_id one stays. Rows without a doc_id can't be told apart and all stay.
    """
    first = join(docs, n, percent).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_first")).distinct()
    kept = docs.join(first, F.col("doc_id") == F.col("_first"), "left_semi")
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.filter(F.col("doc_id").isNull()))
