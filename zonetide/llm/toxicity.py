"""Counterfactual-regularised toxicity classifier.

A logistic model over presence features: hashed words (A-Z lowered) and hashed word beginnings of 4 to 8 bytes. Beside the
labelled documents it sees their counterfactuals: in each, an identity term is swapped for the others of its group,
and the squared change of the score before the logistic function is a penalty. So a group's mention alone moves the score
as little as the name of any other group.

Only text goes into a score. Training uses at most ``SAMPLE`` labelled documents (those with the smallest hash of doc_id)
whose ``crc32(doc_id as text) mod 4`` is not 2. Null or empty text: the score of the intercept. Rows with a null label are
not learned from; of several labels of a document the highest counts. Without two kinds of labels the score is the
share of label 1 (0 without any). Repeated rows are scored each for itself; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.words import _BASE, _BYTE, NOT_WORD, _powers, mix, slices, words_of

SAMPLE = 30_000
BITS = 20
#: Features kept: those whose share differs most, in standard errors, between the labels.
SELECTED = 4096
BEGINNINGS = (4, 5, 6, 7, 8)
CUT = 0.3
#: Groups of identity terms; a term is swapped within its group. Fixed values, in the four languages of the corpus.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("women", "men"), ("woman", "man"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the text of each, with repetitions."""
    w = words_of(texts, lower=True, breaks=NOT_WORD)
    # Identity terms have no beginnings: a swap then changes all that they stand for.
    length, doc = np.where(np.isin(w.hash & np.uint64((1 << BITS) - 1), identity_numbers()[0].astype(np.uint64)), 0, w.end - w.start), w.doc()
    out, owner = [w.hash], [doc]
    for k in BEGINNINGS:
        at = np.flatnonzero(length > k)
        if len(at):
            raw = w.data[w.start[at][:, None] + np.arange(k)]
            out.append(mix((_BYTE[raw] * _powers(_BASE, k)).sum(1, dtype=np.uint64) ^ np.uint64(k << 8)))
            owner.append(doc[at])
    return (np.concatenate(out) & np.uint64((1 << BITS) - 1)).astype(np.int64), np.concatenate(owner)


def _distinct(f: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(owner << BITS | f)
    return pairs & ((1 << BITS) - 1), pairs >> BITS


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def training_labels(labels: DataFrame, sample: int = SAMPLE) -> dict[int, int]:
    """At most ``sample`` labelled documents outside the held-out part."""
    usable = labels.filter("doc_id is not null and toxic is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # bounded by the parameter
    return {r.doc_id: int(r.toxic) for r in rows}


def _chosen(batches: Iterator[pa.RecordBatch], known: dict[int, int]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Texts of the sample, and their labels."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        rows = [k for k, i in enumerate(ids) if i in known]
        if rows:
            part = batch.take(pa.array(rows))
            at = 0
            for piece in slices(part, "text"):
                mine = rows[at:at + piece.num_rows]
                at += piece.num_rows
                yield piece.column("text"), np.array([known[ids[k]] for k in mine])


def select(docs: DataFrame, labels) -> np.ndarray:
    """Numbers of the most telling features, identity terms always among them; document counts are summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, 1 << BITS), np.int64)
        for texts, y in _chosen(batches, labels.value):
            f, owner = _distinct(*features(texts))
            for label in (0, 1):
                count[label] += np.bincount(f[y[owner] == label], minlength=1 << BITS)
        at = np.flatnonzero(count.sum(0) > 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[0, at]), pa.array(count[1, at])], ["f", "n0", "n1"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ones = max(sum(labels.value.values()), 1)
    zeros = max(len(labels.value) - sum(labels.value.values()), 1)
    p1, p0 = F.col("n1") / ones, F.col("n0") / zeros
    all_ = (F.col("n1") + F.col("n0") + 1.0) / (ones + zeros)
    z = F.abs(p1 - p0) / F.sqrt(all_ * (1 / ones + 1 / zeros))
    top = counted.orderBy(F.desc(z), "f").limit(SELECTED).select("f").collect()
    return np.unique(np.concatenate(([r.f for r in top], identity_numbers()[0]))).astype(np.int64)


def identity_numbers() -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the identity terms, and the group of each."""
    terms = [(t, g) for g, group in enumerate(IDENTITY) for t in group]
    w = words_of(pa.array([t for t, _ in terms]), lower=True, breaks=NOT_WORD)
    return (w.hash & np.uint64((1 << BITS) - 1)).astype(np.int64), np.array([g for _, g in terms])


def fit(f: np.ndarray, owner: np.ndarray, y: np.ndarray, columns: np.ndarray, penalty: float = 1.0, ridge: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of ``columns`` and the intercept; ``f``, ``owner``: distinct selected features of each text (positions in ``columns``)."""
    n, m = len(y), len(columns)
    if n == 0 or y.min() == y.max():
        share = float(y.mean()) if n else 0.0
        return np.zeros(m), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    numbers, group = identity_numbers()
    where = np.searchsorted(columns, numbers)
    ok = (where < m) & (columns[np.minimum(where, m - 1)] == numbers)
    where, group = where[ok], group[ok]
    # Swaps (lost feature, gained feature, weight): every identity term of every text against the others of its group.
    times = np.bincount(f, minlength=m)
    swaps = [(a, b, times[a] / n) for g in np.unique(group) for a in where[group == g] for b in where[group == g] if a != b and times[a]]
    lost, gained, share = (np.array(x) for x in zip(*swaps, strict=True)) if swaps else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    g2, gb2, velocity = np.full(m, 1e-8), 1e-8, np.zeros(m)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=w[f], minlength=n) + b, -30, 30)))
        err = (p - y) / n
        grad = np.bincount(f, weights=err[owner], minlength=m) + ridge * w
        if len(lost):
            change = 2 * penalty * share * (w[gained] - w[lost])
            grad += np.bincount(gained, weights=change, minlength=m) - np.bincount(lost, weights=change, minlength=m)
        g2, gb2 = 0.95 * g2 + 0.05 * grad**2, 0.95 * gb2 + 0.05 * err.sum() ** 2
        velocity = 0.8 * velocity - 0.03 * grad / np.sqrt(g2 + 1e-12)
        w, b = w + velocity, b - 0.03 * err.sum() / np.sqrt(gb2 + 1e-12)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, penalty: float = 1.0, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A weight for each feature number (zero for those not selected) and the intercept."""
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(training_labels(labels, sample))
    columns = select(docs, known)
    chosen = sc.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns_ = chosen.value
        for texts, y in _chosen(batches, known.value):
            f, owner = features(texts)
            at = np.minimum(np.searchsorted(columns_, f), len(columns_) - 1)
            right = columns_[at] == f
            f, owner = _distinct(at[right], owner[right])
            edges = np.searchsorted(owner, np.arange(len(y) + 1)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([f[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.list_(pa.int64())), pa.array(y)], ["f", "y"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "f array<long>, y long").toArrow()  # of the bounded sample, selected features only
    lists = rows.column("f").to_pylist()
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    w, b = fit(np.array([i for x in lists for i in x], np.int64), owner, rows.column("y").to_numpy().astype(float), columns, penalty)
    weights = np.zeros(1 << BITS, np.float32)
    weights[columns] = w
    return weights, b


def score(docs: DataFrame, labels: DataFrame, penalty: float = 1.0) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, penalty))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                f, owner = features(part.column("text"))
                used = weights[f] != 0
                f, owner = _distinct(f[used], owner[used])
                total = np.bincount(owner, weights=weights[f].astype(float), minlength=part.num_rows) + b
                s = np.round(1 / (1 + np.exp(-np.clip(total, -30, 30))), 9)
                held = [is_held_out(i) for i in part.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(held), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
