"""Secret scans: layers with bytes that are no text, runs inside other runs, deep nesting, and base spans against a plain pass."""

from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from zonetide.llm import queries, secrets

PLAIN = b"password=hunter2hunter2"


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def raw(data: bytes) -> bytes:
    stream = zlib.compressobj(9, zlib.DEFLATED, -15)
    return stream.compress(data) + stream.flush()


def nested(times: int) -> bytes:
    data = PLAIN
    for _ in range(times):
        data = gzip.compress(data)
    return data


CASES = {
    "colour code": b64(gzip.compress(b"\x1b[31m log \x1b[0m " + PLAIN)), "Latin-1 in gzip": b64(gzip.compress(b"caf\xe9 " + PLAIN)),
    "NUL": b64(b"abc\0" + PLAIN), "Latin-1": b64(b"caf\xe9 " + PLAIN), "%E9 before": "%E9" + "".join(f"%{x:02x}" for x in PLAIN),
    "x/": "x/" + b64(PLAIN), "a-": "a-" + b64(PLAIN), "key_": "key_" + b64(PLAIN), "url path": "https://h.example/a/" + b64(PLAIN),
    "gzip in url path": "https://h.example/a/" + b64(gzip.compress(PLAIN)), "zlib": "key_" + b64(zlib.compress(PLAIN)),
    "66 layers": b64(nested(66)), "1500 layers": b64(nested(1500)), "raw deflate": b64(raw(b"a log line, then " + PLAIN)),
    "UTF-16": b64(PLAIN.decode().encode("utf-16")), "UTF-16 big": b64(PLAIN.decode().encode("utf-16-be")),
    "UTF-16 in gzip": b64(gzip.compress(PLAIN.decode().encode("utf-16-le"))), "behind a stream": b64(gzip.compress(b"nothing") + b"\xff" + PLAIN),
    "stream among bytes": b64(b"\xff\x00\x01" + gzip.compress(PLAIN) + b"\x00\xff"), "base64 after a byte": b64(b"\xe9 " + b64(PLAIN).encode()),
    "xz after a byte": b64(b"\x01" + lzma.compress(PLAIN)), "bzip2 after a byte": b64(b"\x01" + bz2.compress(PLAIN)),
}


@pytest.mark.parametrize("name", CASES)
def test_found_and_redacted(name):
    text = f"see {CASES[name]} !"
    found = [x for x in secrets.scan_text(text) if x[0] == "assign"]
    assert found and all(4 <= start < end <= len(text) - 2 for _, start, end, _ in found)
    left = secrets.redact_text(text)
    assert left.startswith("see ") and left.endswith(" !") and "[secret]" in left and not secrets.scan_text(left)


def test_places_of_characters():
    text = "é\u0430" + "%C3%A9%FF" + "".join(f"%{x:02x}" for x in PLAIN)
    start = text.index("%70")
    assert [x[:3] for x in secrets.scan_text(text)] == [("assign", start, len(text))]
    assert [x[:3] for x in secrets.scan_text("aaa " + b64("né ".encode() + PLAIN))] == [("assign", 9, 40)]


def test_clean_texts_stay_clean():
    rng = random.Random(4)
    long_words = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH/_-") for _ in range(rng.randint(12, 60))) for _ in range(2000))
    noise = b64(bytes(rng.randrange(256) for _ in range(30_000)))
    for text in (long_words, noise, b64(zlib.compress(long_words.encode())), b64(b"x^" * 5000), "x^ " * 5000):
        assert secrets.scan_text(text) == [] and secrets.redact_text(text) == text


def test_layers_that_only_grow_come_to_an_end(monkeypatch):
    """Each level unfolds to a longer stream; the scan stops after ``GROWING`` of them."""
    levels = []

    def members(source, magic, make, left):
        levels.append(sum(map(len, source)))
        left[:] = [0]
        yield b"\x1f\x8b\x08" + b"x" * (levels[-1] + 1)

    monkeypatch.setattr(secrets, "_members", members)
    assert secrets._unfold(b"\x1f\x8b\x08xx") is not None and len(levels) == secrets.GROWING


def plain_pass(text: str) -> list[str]:
    """Base spans by three loops over the whole text."""
    out = []
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for rank, (kind, pattern, group, least) in enumerate((("assign", assign, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


def test_query_keeps_all_base_spans(spark, small):
    """The registered query, over all documents, against a plain pass over the texts."""
    import hashlib

    texts = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = {r.doc_id: r for r in queries.QUERIES["op9_recursive_secret_scan"](spark, small).collect()}
    assert len(rows) == len(texts)
    for doc in texts:
        want, got = plain_pass(doc["text"] or ""), rows[doc["doc_id"]]
        kinds = [x.split(":")[0] for x in want]
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(kinds.count(k) for k in secrets.KINDS)
        assert got.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got.spans.split(",")) | {""}


def test_repeated_rows_and_further_columns(spark):
    rows = [(1, "token: abcdefgh12", "s", 7)] * 3 + [(2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, depth int")
    got = secrets.scan(docs).collect()
    assert sorted((r.doc_id, len(r.spans)) for r in got) == [(1, 1)] * 3 + [(2, 0)]
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).filter("text = '[secret]' and spans = 's'").count() == 3
