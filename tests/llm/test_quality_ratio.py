"""The hashed n-gram ratio and the verdict against a plain computation, with the trusted ids broadcast and joined."""

from __future__ import annotations

import collections
import math
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from zonetide.llm import quality

BUCKETS = 97
TEXTS = [None, "", " \n ", "one", "# a | b\n# a | b\n\nc", "the cat sat on the mat " * 4, "é ü the\tcat\x0bsat", "x y " * 30,
         *(" ".join(f"w{(k * j) % 23}" for j in range(25 + k)) for k in range(1, 9)), "junk zq " * 11 + "q"]


def grams(text):
    """Buckets of the words, then of each word with the next one."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    first = lambda x: xxhash.xxh64(struct.pack("<Q", x), seed=42).intdigest()
    pairs = [xxhash.xxh64(struct.pack("<Q", b), seed=first(a)).intdigest() for a, b in zip(h, h[1:])]
    return [signed(x) % BUCKETS for x in [*h, *pairs]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "again", None), (None, TEXTS[7], "nameless", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, _w string, ratio double").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1), (5, 1), (9, 1), (10, 1), (16, 0), (7, None), (None, 1)], "doc_id long, quality int")


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_ratio_and_verdict(docs, labels, monkeypatch, limit):
    monkeypatch.setattr(quality, "TRUSTED", limit)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    every = collections.Counter(g for _, t in rows for g in grams(t))
    good = collections.Counter(g for i, t in rows if i in (5, 9, 10) for g in grams(t))
    add = quality.SMOOTHING / BUCKETS
    part = lambda c, g: math.log(c[g] / sum(c.values()) + add)
    got = quality.judge(docs, labels, buckets=BUCKETS).collect()
    assert len(got) == len(rows)
    for r in got:
        n = grams(r.text)
        want = sum(part(good, g) - part(every, g) for g in n) / len(n) if n else 0.0
        assert r.ratio == pytest.approx(want, abs=2e-9) and r.kept == (not r.base_failed and r.ratio >= quality.THRESHOLD)
        lines = [x for x in (r.text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)))
    assert {r.kept for r in got if not r.base_failed} == {True, False}


def test_threshold_is_kept_at_a_tie_and_without_trusted_documents(docs, labels):
    judged = quality.judge(docs, labels, buckets=BUCKETS).filter("not base_failed").agg(F.max("ratio").alias("r")).first()
    assert quality.judge(docs, labels, threshold=judged.r, buckets=BUCKETS).filter("kept").count() > 0
    untrusted = quality.judge(docs, labels.filter("quality = 0"), buckets=BUCKETS)
    assert untrusted.filter("ratio <> 0 or kept = base_failed").count() == 0
    assert quality.judge(docs, labels, buckets=BUCKETS).columns[-1] == "kept"
