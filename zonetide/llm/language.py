"""Language ID by error-correcting output codes.

Every learned language has a codeword; each of its bits splits the languages into two camps. For each bit a binary
classifier over hashed byte trigrams (A-Z lowered, one space around words) tells the camps apart: the mean log ratio of
the camps' smoothed multinomials, counted over all training texts. A text goes to the codeword with the smallest
total logistic loss, each bit weighted by how well its two camps are told apart; ``ambiguous`` marks texts whose second
codeword is nearly as near.

Training rows: lang not null and ``crc32(doc_id as text) mod 4`` not 2. Null text, or text without a letter: ``und``, score 0.
Without training rows everything is ``und``. Repeated rows are judged each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.toxicity import is_held_out
from zonetide.llm.words import _LOWER, SPACES, slices, text_bytes

BITS = 15
#: Trigrams' evidence is not independent; margins are means times this.
SHARPNESS = 40.0
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts one after the other, and the bounds of each text's."""
    data, offsets = text_bytes(texts)
    data = np.where(SPACES[data], np.uint8(0x20), _LOWER[data]).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    code = (data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D))
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    size = np.maximum(np.diff(offsets) - 2, 0)
    bounds = np.concatenate(([0], np.cumsum(size)))
    inside = np.ones(len(code), bool)  # not across two texts
    for back in (1, 2):
        edge = offsets[1:-1] - back
        inside[edge[(edge >= 0) & (edge < len(code))]] = False
    return code[inside].astype(np.int64), bounds


def codewords(languages: int) -> np.ndarray:
    """Bits by language, 0 or 1. Up to five languages: every split once; more: rows of a fixed random table, far apart."""
    if languages <= 5:
        splits = [(0, *rest) for rest in product((0, 1), repeat=languages - 1)][1:] or [(0,)]
        return np.array(splits).T
    rng, length = np.random.Generator(np.random.PCG64(7)), int(12 * np.ceil(np.log2(languages)))
    best, most = None, -1
    for _ in range(200):
        table = rng.integers(0, 2, (languages, length))
        apart = min((int((table[a] != table[b]).sum()) for a in range(languages) for b in range(a)), default=0)
        if apart > most and not (table.all(0) | ~table.any(0)).any():
            best, most = table, apart
    return best if best is not None else rng.integers(0, 2, (languages, length))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, their codewords, trigram weights of each bit and weights of the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                langs = part.column("lang").to_pylist()
                f, bounds = trigrams(part.column("text"))
                owner = np.repeat(np.arange(len(langs)), np.diff(bounds))
                for lang in set(langs):
                    mine = np.array([x == lang for x in langs])
                    count[lang] = count.get(lang, np.zeros(1 << BITS, np.int64)) + np.bincount(f[mine[owner]], minlength=1 << BITS)
        for lang, n in count.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n.tolist()], pa.list_(pa.int64()))], ["lang", "n"])

    rows = docs.filter(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).select("text", "lang")
    counted = rows.mapInArrow(run, "lang string, n array<long>").select("lang", F.posexplode("n").alias("f", "n"))
    total = counted.groupBy("lang", "f").agg(F.sum("n").alias("n")).filter("n > 0").toArrow()  # languages times 2^BITS at most
    langs = sorted(set(total.column("lang").to_pylist()))
    if not langs:
        return [], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0)
    number = {x: k for k, x in enumerate(langs)}
    share = np.zeros((len(langs), 1 << BITS))
    share[[number[x] for x in total.column("lang").to_pylist()], total.column("f").to_numpy()] = total.column("n").to_numpy()
    share = share / share.sum(1, keepdims=True)
    words = codewords(len(langs))
    weights, trust = [], []
    for bit in words.T:
        one, zero = (share[bit == v].mean(0) if (bit == v).any() else np.zeros(1 << BITS) for v in (1, 0))
        w = np.log(one + 1e-7) - np.log(zero + 1e-7) if len(langs) > 1 else np.zeros(1 << BITS)
        weights.append(w)
        means = share @ w  # the mean margin of each language; a bit is worth its smallest correct one
        trust.append(max(float((means * (2 * bit - 1)).min()), 1e-3))
    return langs, words, np.array(weights, np.float32).T.copy(), np.array(trust)


def decode(margins: np.ndarray, words: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its share of the softmax over negative losses, and whether the runner-up is near."""
    signs = 2 * words - 1
    loss = (np.logaddexp(0, -margins[:, None, :] * signs[None] * SHARPNESS) * (trust / trust.sum())).sum(2)
    p = np.exp(-(loss - loss.min(1, keepdims=True)))
    p = p / p.sum(1, keepdims=True)
    order = np.sort(p, 1)
    second = order[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
    return p.argmax(1), order[:, -1], order[:, -1] - second < 0.1


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def identify(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (0 to 1) and ambiguous."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, words, weights, trust = model.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                f, bounds = trigrams(part.column("text"))
                size = np.diff(bounds)
                some = size > 0
                margins = np.zeros((part.num_rows, words.shape[1]))
                if len(langs) and some.any():
                    margins[some] = np.add.reduceat(weights[f], bounds[:-1][some], axis=0) / size[some, None]
                letters = np.array([_has_letter(t) for t in part.column("text").to_pylist()], bool) & bool(len(langs))
                k, p, unsure = decode(margins, words, trust) if len(langs) else (np.zeros(len(size), int), np.zeros(len(size)), np.zeros(len(size), bool))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([is_held_out(i) for i in part.column("doc_id").to_pylist()]),
                     pa.array([langs[x] if y else "und" for x, y in zip(k.tolist(), letters.tolist(), strict=True)], pa.string()),
                     pa.array(np.where(letters, np.round(p, 9), 0.0)), pa.array(unsure | ~letters)],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
