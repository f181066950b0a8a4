"""Filter interaction audit: what each filter removes at each place of every order, from decision diagrams.

Every document gets the set of filters it fails. Per part (a language) the counts by set make a decision diagram: one level
a filter, the low branch for documents that pass, the high one for those that fail, counts at the leaves and their sum
at every node, equal nodes shared, high branches without documents left out. All orders are reached from the first by
swapping two adjacent levels at a time, which rewrites only the nodes of these two; in each order the low path from the root
reads off what every step keeps and removes.

The corpus is read once, natively. Copies of a text are counted together before they meet, so that a text that is a third
of all rows is one row a task; a diagram sees at most 2 ** filters rows a part.

Null text: empty; null lang: the part ``''``. Ties: of equal texts those with the smallest doc_id pass, all of them if it is
repeated; rows without a doc_id always pass that filter and have no labels. A document counts once for each of its
rows; several labels of one doc_id count as one, marked if any is. Documents without labels are neither good nor toxic. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonetide.llm.quality import words

FILTERS = "ABCDE"
STEPS = ("part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, "
         "toxic_lost long, shapley long")
#: Rows without a doc_id are dealt out over so many keys of the label join, none of which a label has.
_NOWHERE = 1024


def text_failures(text: Column) -> list[Column]:
    """Filters A to D: few words, few distinct words, many capitals, odd signs."""
    w = F.col("_words")
    return [w["n"] < 100, 100 * w["d"] < 80 * w["n"],
            100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 10 * F.length(text), text.rlike("[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit ``k``: fails filter ``k``), n, good, toxic."""
    text = F.coalesce("text", F.lit(""))
    # One array of words a row, gone again before the first shuffle.
    counted = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.element_at(F.transform(
        F.array(words(text)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), 1).alias("_words"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = (counted.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text"), mask.cast("int").alias("mask"))
            .groupBy("text", "part", "doc_id", "mask").agg(F.count("*").alias("n")))
    # A text's documents of one part: all of them, and those of the smallest doc_id.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(_NOWHERE)) + 1).otherwise(0)
    mark = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0).cast("long")))
    known = (labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
             .agg(mark("quality").alias("good"), mark("toxic").alias("toxic")).withColumn("_salt", F.lit(0).cast("long")))
    marked = (rows.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_salt": salt.cast("long")}).join(known, ["_id", "_salt"], "left")
              .select("text", "part", "mask", "doc_id", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]))
    three = ("n", "good", "toxic")
    nameless = F.col("doc_id").isNull()
    groups = marked.groupBy("text", "part", "mask").agg(
        F.min(F.when(~nameless, F.struct("doc_id", *three))).alias("first"),
        *[F.sum(F.when(~nameless, F.col(c))).alias(c) for c in three], *[F.sum(F.when(nameless, F.col(c))).alias(f"_{c}") for c in three])
    # One row a text and part is left, so a window over a text has as many rows as the table has parts.
    lowest = F.min("first.doc_id").over(W.partitionBy("text"))
    passed = lambda c: F.when(F.col("first.doc_id") == F.col("_low"), F.col(f"first.{c}")).otherwise(0)
    spread = groups.withColumn("_low", lowest).select("part", "mask", *[F.coalesce(passed(c), F.lit(0)).alias(f"first_{c}") for c in three], *[F.coalesce(
        c, F.lit(0)).alias(c) for x in three for c in (x, f"_{x}")])
    bit = 1 << FILTERS.index("E")
    both = F.explode(F.array(
        F.struct(F.col("mask"), *[(F.col(f"_{c}") + F.col(f"first_{c}")).alias(c) for c in three]),
        F.struct((F.col("mask") + bit).alias("mask"), *[(F.col(c) - F.col(f"first_{c}")).alias(c) for c in three])))
    return (spread.select("part", both.alias("x")).filter("x.n > 0").groupBy("part", F.col("x.mask").alias("mask"))
            .agg(*[F.sum(f"x.{c}").alias(c) for c in three]))


class Diagram:
    """A zero-suppressed decision diagram with weights: tuples of counts at the leaves, their sums at the nodes."""

    ZERO = 0

    def __init__(self, order: str, counts: dict[frozenset, tuple[int, ...]]):
        self.order = list(order)
        self.width = len(next(iter(counts.values()), (0,)))
        self.node: dict[int, tuple | None] = {self.ZERO: None}  # (filter, low, high); None: a leaf
        self.weight: dict[int, tuple[int, ...]] = {self.ZERO: (0,) * self.width}
        self.table: dict[tuple, int] = {}
        self.made = 0
        self.root = self._build(0, counts)

    def _new(self, key: tuple, node: tuple | None, weight: tuple[int, ...]) -> int:
        if key not in self.table:
            self.made += 1
            self.table[key], self.node[self.made], self.weight[self.made] = self.made, node, weight
        return self.table[key]

    def _make(self, name: str, low: int, high: int) -> int:
        if high == self.ZERO:
            return low
        total = tuple(a + b for a, b in zip(self.weight[low], self.weight[high], strict=True))
        return self._new((name, low, high), (name, low, high), total)

    def _build(self, level: int, counts: dict[frozenset, tuple[int, ...]]) -> int:
        if not counts:
            return self.ZERO
        if level == len(self.order):
            (weight,) = counts.values()
            return self._new(("leaf", *weight), None, weight)
        name = self.order[level]
        low, high = ({s: w for s, w in counts.items() if (name in s) == fails} for fails in (False, True))
        return self._make(name, self._build(level + 1, low), self._build(level + 1, high))

    def _split(self, at: int, name: str) -> tuple[int, int]:
        node = self.node[at]
        return (node[1], node[2]) if node and node[0] == name else (at, self.ZERO)

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below. A changed node keeps its number, so those above stay as they are."""
        upper, lower = self.order[level:level + 2]
        for at, node in list(self.node.items()):
            if not node or node[0] != upper or not any(self.node[x] and self.node[x][0] == lower for x in node[1:]):
                continue
            (low_low, low_high), (high_low, high_high) = (self._split(x, lower) for x in node[1:])
            del self.table[node]
            self.node[at] = (lower, self._make(upper, low_low, high_low), self._make(upper, low_high, high_high))
            self.table[self.node[at]] = at
        self.order[level:level + 2] = lower, upper
        self._sweep()

    def _sweep(self) -> None:
        used, todo = {self.ZERO}, [self.root]
        while todo:
            at = todo.pop()
            if at not in used:
                used.add(at)
                todo += (self.node[at] or ())[1:]
        self.node = {k: v for k, v in self.node.items() if k in used}
        self.weight = {k: v for k, v in self.weight.items() if k in used}
        self.table = {k: v for k, v in self.table.items() if v in used}

    def passing(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weights kept, weights removed) along the low path."""
        at = self.root
        for name in self.order:
            low, high = self._split(at, name)
            yield name, self.weight[low], self.weight[high]
            at = low


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places at which to swap neighbours so that all orders of ``n`` things come up once: the last thing wanders through every order of the others."""
    if n < 2:
        return
    inner, there = adjacent_swaps(n - 1), False
    while True:
        yield from range(n - 1) if there else range(n - 2, -1, -1)
        there = not there
        step = next(inner, None)
        if step is None:
            return
        yield step + there


def orders_of(diagram: Diagram) -> dict[str, list[tuple]]:
    """The steps of every order."""
    found = {"".join(diagram.order): list(diagram.passing())}
    for place in adjacent_swaps(len(diagram.order)):
        diagram.swap(place)
        found["".join(diagram.order)] = list(diagram.passing())
    return found


def _report(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    counts = {frozenset(f for k, f in enumerate(FILTERS) if mask >> k & 1): (int(n), int(g), int(t))
              for mask, n, g, t in rows[["mask", "n", "good", "toxic"]].itertuples(index=False)}
    orders = orders_of(Diagram(FILTERS, counts))
    fails = {o[0]: steps[0][2][0] for o, steps in orders.items()}  # removed as the first filter: all that fail it
    alone = {o[-1]: steps[-1][2][0] for o, steps in orders.items()}  # as the last: those that pass all others
    shapley = {f: sum(gone[0] for steps in orders.values() for name, _, gone in steps if name == f) for f in FILTERS}
    out = [(key[0], o, k, f, kept[0], gone[0], fails[f] - gone[0], alone[f], gone[1], gone[2], shapley[f])
           for o, steps in sorted(orders.items()) for k, (f, kept, gone) in enumerate(steps, start=1)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step. ``docs``: doc_id, text, lang; ``labels``: doc_id, quality, toxic."""
    return failures(docs, labels).groupBy("part").applyInPandas(_report, STEPS)
