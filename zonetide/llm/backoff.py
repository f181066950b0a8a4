"""Katz backoff language model over words: bigrams with Good-Turing discounts and exactly normalised backoff weights.

Training documents are those whose ``crc32(doc_id as text) mod 10`` is not 0; all documents are scored. A text's tokens are
its words (A-Z lowered) and one end; the first token's history is a start mark.

Counts are taken per part of the input first and summed by key, so a common word or bigram is one entry per part:

* words: counts of all training words, exact. ``P1`` of a known word is its share less a Good-Turing part; that part, the
  mass of words without training tokens, goes equally to ``UNSEEN`` places, one for each of them;
* bigrams by history: a seen bigram has ``d(c) c / c(h)``, ``d`` the Good-Turing discounts for counts up to ``LEVELS``, from the
  counts of counts of all bigrams; an unseen one backs off to ``a(h) P1(w)``, where ``a(h)`` is what the seen ones leave
  over, divided by the ``P1`` mass of the words not seen after ``h``. A history that training never saw backs off to ``P1`` wholly.

What a history needs (its total, how many bigrams have counts 1 ... ``LEVELS``, the training tokens of its seen words) are sums of
whole numbers. A history with more than its share of all tokens is dealt out by classes of next words and its sums are added
up, so no task holds a hot history alone and the scores depend neither on that split nor on the number of tasks.

A part's tokens stay with the part, as numbers of its distinct words; the counts of its words and bigrams come back to it.
Words are told apart by 48 bits of their hash.

Null or empty text: the end token alone. Repeated rows count and score each for itself. Without training rows every
word is unknown. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.words import mix, slices, words_of
from zonetide.session import written

#: Words without training tokens that the lower order makes room for.
UNSEEN = 1 << 16
LEVELS = 5
#: Tokens and documents packed together on the map side, and classes of a split history.
PART_TOKENS, PART_DOCS, SPLIT = 3_500_000, 30_000, 64
_WIDE = np.uint64((1 << 48) - 1)
END, START = np.uint64(1), np.uint64(2)
ADD = 0.1


def held_out(ids: pa.Array, modulus: int = 10) -> np.ndarray:
    return np.array([zlib.crc32(str(x).encode()) % modulus == 0 for x in ids.to_pylist()], bool)


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """48-bit codes of the tokens of all texts, and tokens per text."""
    w = words_of(part.column("text"), lower=True)
    return np.insert((w.hash & _WIDE) | np.uint64(4), w.first[1:], END), np.diff(w.first) + 1


def split_class(w: np.ndarray) -> np.ndarray:
    """Class of a next word after a split history."""
    return (mix(w) % np.uint64(SPLIT)).astype(np.int64)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Sizes, then the arrays byte plane by byte plane (equal high bytes compress away)."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.dtype.itemsize)]], np.int32).tobytes()
    planes = b"".join(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays if len(a))
    return head + zstandard.compress(planes, 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(data, np.int32, 1)[0])
    sizes = np.frombuffer(data, np.int32, 2 * k, 4).reshape(-1, 2).tolist()
    planes, out, at = zstandard.decompress(data[4 + 8 * k:]), [], 0
    for n, size in sizes:
        raw = np.frombuffer(planes, np.uint8, n * size, at).reshape(size, n).T
        out.append(np.ascontiguousarray(raw).view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[size]).ravel())
        at += n * size
    return out


def _short(code: np.ndarray) -> list[np.ndarray]:
    """48-bit codes as 32 and 16 bits."""
    return [code.astype(np.uint32), (code >> np.uint64(32)).astype(np.uint16)]


def _long(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def _runs(*keys: np.ndarray) -> np.ndarray:
    head = np.ones(len(keys[0]), bool)
    if len(head):
        head[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(head)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``np.unique`` with the inverse, in less memory."""
    order = np.argsort(key)
    key = key[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    number = np.empty(len(key), np.uint32)
    number[order] = np.cumsum(head, dtype=np.uint32) - np.uint32(1)
    return key[head], number


class Parts:
    """Collects texts of a task and hands them over as parts: rows of (bucket, part, data), the tokens themselves in bucket -1."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.number = TaskContext.get().partitionId() << 24
        self._clear()

    def _clear(self) -> None:
        self.held: list[tuple] = []
        self.tokens = self.docs = 0

    def add(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, part.num_rows, PART_DOCS // 2):
            piece = part.slice(at, PART_DOCS // 2)
            code, count = _tokens(piece)
            if self.docs + len(count) > PART_DOCS or self.tokens + len(code) > PART_TOKENS:
                yield from self.flush()
            self.held.append((code, count, held_out(piece.column("doc_id")), piece.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy()))
            self.tokens, self.docs = self.tokens + len(code), self.docs + len(count)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        code, count, held, ids = (np.concatenate([x[k] for x in self.held]) for k in range(4))
        self.held.clear()
        words, number = _distinct(code)
        times = np.bincount(number[np.repeat(~held, count)], minlength=len(words))
        rows = [(-1, _pack([ids.view(np.uint64), held.view(np.uint8), count.astype(np.uint32), *_short(words), number]))]
        order, edges = _by_bucket(mix(words), self.buckets)
        for b in np.flatnonzero(np.diff(edges)):
            some = order[edges[b]:edges[b + 1]]
            rows.append((b, _pack([*_short(words[some]), times[some].astype(np.uint32)])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([self.number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "part", "data"])
        self.number += 1
        self._clear()


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings values of one bucket together and keeps it otherwise, and where each bucket starts in it."""
    bucket = (h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))


def _dealt(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(buckets)
        for batch in batches:
            for part in slices(batch, "text"):
                yield from parts.add(part)
        yield from parts.flush()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, part long, data binary")


_SCHEMA = "kind string, bucket int, part long, data binary"


def _table(rows: list[tuple]) -> pa.Table:
    kind, bucket, part, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kind, pa.string()), "bucket": pa.array(bucket, pa.int32()), "part": pa.array(part, pa.int64()), "data": pa.array(data, pa.binary())})


def _word_bucket(key, table):
    """Counts of the bucket's words, as a table and for each part in the order of its words."""
    found = [_unpack(raw) for raw in table.column("data").to_pylist()]
    words, back = np.unique(np.concatenate([_long(x[0], x[1]) for x in found]), return_inverse=True)
    count = np.bincount(back, weights=np.concatenate([x[2] for x in found]), minlength=len(words)).astype(np.uint64)
    edges = np.append(0, np.cumsum([len(x[2]) for x in found]))
    known = count > 0
    b = key[0].as_py()
    rows = [("counts", b, p, _pack([count[back[a:z]]])) for p, a, z in zip(table.column("part").to_pylist(), edges[:-1], edges[1:], strict=True)]
    return _table([*rows, ("words", b, -1, _pack([words[known], count[known]]))])


def _word_rows(packed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("data"):
                words, count = _unpack(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(count.view(np.int64))], ["w", "c"])

    return packed.filter("kind = 'words'").select("data").mapInArrow(run, "w long, c long")


class Lower:
    """P1 from the count of a word: known words have their own shares, ``UNSEEN`` others the same one each."""

    def __init__(self, n: int, one: int):
        self.unseen = min(max(one, 1) / n, 0.5) if n else 1.0
        self.known = (1 - self.unseen) / max(n, 1)

    def of(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, count * self.known, self.unseen / UNSEEN)


def ratios(n: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Good-Turing ratios d[0 ... levels + 1] from counts of counts; 1 beyond ``levels``. Where those give none: 1 - 1 / (2 r)."""
    d = np.ones(levels + 2)
    common = (levels + 1) * n[levels + 1] / n[1] if n[1] else 1.0
    for r in range(1, levels + 1):
        star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        value = (star - common) / (1 - common) if common < 1 else 0.0
        d[r] = value if 0 < value < 1 else 1 - 1 / (2 * r)
    return d


def counts_of_counts(count: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    return np.bincount(np.minimum(count, levels + 2).astype(np.int64), minlength=levels + 3)


def katz(c: np.ndarray, lower: np.ndarray, history: np.ndarray, sums: np.ndarray, mass: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 P(w | h) of bigrams with counts ``c`` and P1 ``lower``. A row of ``sums`` for each history: its total and its bigrams with
    counts 1 ... LEVELS; ``mass``: P1 of its seen words."""
    total = sums[:, 0]
    left = sums[:, 1:] @ ((1 - d[1:LEVELS + 1]) * np.arange(1, LEVELS + 1)) / np.maximum(total, 1)
    scale = np.where(left < 1e-9, total / (total + 1), 1.0)  # nothing was discounted: one more event makes room
    left = np.where(left < 1e-9, 1 / (total + 1), left)
    alpha = np.where(total > 0, left / np.maximum(1 - mass, 1e-12), 1.0)
    star = d[np.minimum(c, len(d) - 1)] * c
    return np.log10(np.where(c > 0, star * (scale / np.maximum(total, 1))[history], alpha[history] * lower))


def _history_sums(c: np.ndarray, head: np.ndarray) -> np.ndarray:
    return np.stack([np.add.reduceat(x.astype(np.int64), head) for x in (c, *[c == r for r in range(1, LEVELS + 1)])], 1)


def group_scores(g: np.ndarray, w: np.ndarray, train: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """log10 P(w | g) of every token when these are all; ``g`` numbers the histories 0, 1, ..., ``p1`` is the lower order.

    Tokens are in order of (g, w).
    """
    first = _runs(g, w)
    c = np.add.reduceat(train.astype(np.int64), first)
    head = _runs(g[first])
    mass = np.add.reduceat(np.where(c > 0, p1[first], 0), head)
    logs = katz(c, p1[first], g[first], _history_sums(c, head), mass, ratios(counts_of_counts(c[c > 0])))
    return np.repeat(logs, np.diff(np.append(first, len(g))))


class Tokens:
    """Tokens of a part with the training counts of its words, and its distinct bigrams: by bucket, history and word."""

    def __init__(self, table: pa.Table, buckets: int, hot: np.ndarray):
        kind, bucket, data = table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("data")
        rows = sorted(range(len(kind)), key=lambda k: (kind[k], bucket[k]))
        #: What came back for the bigrams: (bucket, packed).
        self.back = [(bucket[k], data[k]) for k in rows if kind[k] == "bigrams"]
        ids, held, count, low, high, number = _unpack(data[kind.index("info")].as_py())
        words = _long(low, high)
        self.ids, self.held, self.count, self.number = ids.view(np.int64), held.view(bool), count.astype(np.int64), number
        self.first = np.cumsum(self.count) - self.count
        self.word_count = np.empty(len(words), np.uint64)
        self.word_count[_by_bucket(mix(words), buckets)[0]] = np.concatenate([_unpack(data[k].as_py())[0] for k in rows if kind[k] == "counts"])
        key = np.empty(len(number), np.int64)
        key[1:] = number[:-1]
        key[self.first] = len(words)
        key *= len(words) + 1
        key += number
        pair, self.pair = _distinct(key)
        del key
        h, w = np.append(words, START)[pair // (len(words) + 1)], (pair % (len(words) + 1)).astype(np.uint32)
        sub = np.where(np.isin(h, hot), split_class(words[w]), 0).astype(np.uint64)
        order, self.edges = _by_bucket(mix(h * np.uint64(SPLIT + 1) + sub), buckets)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        self.pair = place[self.pair]
        self.h, self.w, self.words = h[order], w[order], words


def _bigrams(buckets: int, hot: np.ndarray):
    """The distinct bigrams of a part, dealt to buckets."""

    def run(key, table):
        x = Tokens(table, buckets, hot)
        times = np.bincount(x.pair[np.repeat(~x.held, x.count)], minlength=len(x.h))
        rows = []
        for b in np.flatnonzero(np.diff(x.edges)):
            a, z = x.edges[b], x.edges[b + 1]
            first = _runs(x.h[a:z])
            number = np.diff(np.append(first, z - a))
            w = x.w[a:z]
            rows.append(("", b, key[0].as_py(), _pack([*_short(x.h[a:z][first]), number.astype(np.uint32), *_short(x.words[w]), times[a:z].astype(np.uint32), x.word_count[w]])))
        return _table(rows)

    return run


def _bigram_bucket(hot: np.ndarray):
    """Counts and sums of histories for each part; once for the bucket: counts of counts, and the sums of its hot histories."""

    def run(key, table):
        b = key[0].as_py()
        found = [_unpack(raw) for raw in table.column("data").to_pylist()]
        mine = [_long(x[0], x[1]) for x in found]
        h = np.concatenate([np.repeat(m, x[2]) for m, x in zip(mine, found, strict=True)])
        w = np.concatenate([_long(x[3], x[4]) for x in found])
        order = np.lexsort((w, h))
        first = _runs(h[order], w[order])
        c = np.add.reduceat(np.concatenate([x[5] for x in found])[order].astype(np.int64), first)
        known = np.concatenate([x[6] for x in found])[order][first].astype(np.int64)
        back = np.empty(len(h), np.int64)
        back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        every = h[order][first]
        head = _runs(every)
        every = every[head]
        sums = np.column_stack([_history_sums(c, head), np.add.reduceat(np.where(c > 0, known, 0), head)]).astype(np.uint64)
        rows, at = [], 0
        for p, x, m in zip(table.column("part").to_pylist(), found, mine, strict=True):
            rows.append(("bigrams", b, p, _pack([c[back[at:at + len(x[5])]].view(np.uint64), *np.ascontiguousarray(sums[np.searchsorted(every, m)].T)])))
            at += len(x[5])
        is_hot = np.isin(every, hot)
        rows.append(("levels", b, -1, _pack([counts_of_counts(c[c > 0]).view(np.uint64)])))
        rows.append(("hot", b, -1, _pack([every[is_hot], *np.ascontiguousarray(sums[is_hot].T)])))
        return _table(rows)

    return run


def _totals(packed: DataFrame, kind: str, keyed: bool) -> np.ndarray:
    """Sums of the rows of one kind over all buckets, in columns; ``keyed``: by the first one."""
    width = LEVELS + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("data"):
                columns = [x.view(np.int64) for x in _unpack(raw.as_py())]
                columns = columns if keyed else list(columns[0].reshape(-1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [f"x{k}" for k in range(width)])

    rows = packed.filter(F.col("kind") == kind).select("data").mapInArrow(run, ", ".join(f"x{k} long" for k in range(width)))
    rows = rows.groupBy("x0").agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(1, width)]) if keyed else rows.agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(width)])
    return np.stack([rows_.fill_null(0).to_numpy() for rows_ in rows.toArrow().columns], 1)


def _scores(buckets: int, n: int, v: int, lower: Lower, hot: np.ndarray, hot_sums: np.ndarray, d: np.ndarray):
    def run(key, table):
        x = Tokens(table, buckets, hot)
        logs = np.empty(len(x.h))
        for b, raw in x.back:
            a, z = x.edges[b], x.edges[b + 1]
            c, *sums = (y.view(np.int64) for y in _unpack(raw.as_py()))
            sums, head = np.stack(sums, 1), _runs(x.h[a:z])
            history = np.repeat(np.arange(len(head)), np.diff(np.append(head, z - a)))
            if len(hot):
                mine = x.h[a:z][head]
                place = np.minimum(np.searchsorted(hot, mine), len(hot) - 1)
                whole = hot[place] == mine
                sums[whole] = hot_sums[place[whole]]
            logs[a:z] = katz(c, lower.of(x.word_count[x.w[a:z]]), history, sums[:, :-1], sums[:, -1] * lower.known, d)
        base = np.log10((x.word_count + ADD) / (n + ADD * (v + 1)))
        by_doc = lambda values: np.add.reduceat(values, x.first)
        return pa.table({"doc_id": x.ids, "held_out": pa.array(x.held), "n_tokens": x.count, "n_known": by_doc((x.word_count > 0).astype(np.int64)[x.number]),
                         "train_tokens": np.full(len(x.count), n, np.int64), "base_score": by_doc(base[x.number]), "score": by_doc(logs[x.pair])})

    return run


def score(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    buckets = buckets or max(36, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(_dealt(docs, buckets), "tokens")
    info = dealt.filter("bucket < 0").select(F.lit("info").alias("kind"), "bucket", "part", "data")
    packed = written(dealt.filter("bucket >= 0").groupBy("bucket").applyInArrow(_word_bucket, _SCHEMA), "words")
    words = _word_rows(packed)
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("one")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    # So often does a word come before another; the start comes before as many as there are ends.
    often = words.filter(F.col("c") > max(n // (2 * buckets), 1)).toArrow().column("w").to_numpy().view(np.uint64)
    hot = np.unique(np.where(often == END, START, often))
    parts = info.unionByName(packed.filter("kind = 'counts'"))
    pairs = parts.groupBy("part").applyInArrow(_bigrams(buckets, hot), _SCHEMA)
    bigrams = written(pairs.groupBy("bucket").applyInArrow(_bigram_bucket(hot), _SCHEMA), "bigrams")
    levels = _totals(bigrams, "levels", False)[0]
    by_history = _totals(bigrams, "hot", True)
    by_history = by_history[np.argsort(by_history[:, 0])]
    scored = _scores(buckets, n, v, Lower(n, int(total["one"] or 0)), by_history[:, 0].astype(np.uint64), by_history[:, 1:], ratios(levels))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.unionByName(bigrams.filter("kind = 'bigrams'")).groupBy("part").applyInArrow(scored, schema)
