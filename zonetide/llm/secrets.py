"""Secret scans through nested encodings.

A worklist holds layers of a text. Each layer is searched; then its URL escapes, its character escapes, its base64
runs (from each of four places, as other characters of that alphabet may stand before one), its compressed streams and its
UTF-16 runs are decoded, each into a layer of its own that goes on the list. A byte that is no UTF-8 stays in its layer as an
escaped one, so nothing around it is lost and the bytes can be had back. A compressed stream (gzip, zlib, bzip2, xz, raw
deflate) is unfolded, all members and again what is compressed inside, in bounded chunks to the end. A layer that gets long is
cut, only after characters that no secret and no text encoding contains, so its pieces are searched one by one. A layer whose
digest was seen before is not taken up again, so the work ends, also when a layer decodes to itself. Every character of
a layer knows the range of the source it comes from, so a find is reported at its place in the document.

A base64 run is decoded where the bytes hold a part of a secret, a further encoding or a stream, or are text from its first
character on; most long words are none of these. Raw deflate has no mark, so it is looked for at the start of decoded bytes only.

Null or empty text: no spans. Repeated rows are scanned each for itself; columns besides ``doc_id`` and ``text`` are
ignored; an empty table gives no rows. Undecodable runs stay as they are. Spans of one start come in the order of ``KINDS``, then by end.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import urllib.parse
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes unfolded at a time, and characters from which on a layer is cut into pieces.
CHUNK, PIECE = 1 << 20, 4 << 20
#: Streams in one another, each longer than the one around it, after which they count as made to grow for ever.
GROWING = 64
#: Characters that secrets and encodings are made of: a layer is cut only after another one.
_JOINED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"' :%\\{}&#;~\x00"
KINDS = ("assign", "access", "hex")
SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long, depth: int>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the same as runs of hex digits with those under 32 dropped
_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_URL_MIXED = re.compile(r"[A-Za-z0-9_.~/+-]*(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~/+-]*)+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
_WIDE = re.compile("(?:[\t\n\r\x20-\x7e]\x00){5,}|(?:\x00[\t\n\r\x20-\x7e]){5,}")
#: Starts of gzip, bzip2, xz and zlib streams in a layer, where bytes that are no UTF-8 stand as lone surrogates.
_STREAM = re.compile("\x1f\udc8b\x08|BZh[1-9]1AY&SY|\udcfd7zXZ\x00|x[\x01^\udc9c\udcda]")
_STREAM_BYTES = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|x[\x01^\x9c\xda]")
#: What makes bytes that are not all text worth a layer: a part of a secret, another encoding.
_WORTH = re.compile(rb"passw|secret|token|api_?key|AKIA|[0-9a-f]{32}|%[0-9a-f]{2}%[0-9a-f]{2}|\\u[0-9a-f{]{4}|\\x[0-9a-f]{2}\\|&#x?[0-9a-f]{2,7};"
                    rb"|[a-z0-9+/_-]{12}|(?:[\t\n\r\x20-\x7e]\x00){5}|(?:\x00[\t\n\r\x20-\x7e]){5}", re.I)


def find(text: str) -> list[tuple[str, int, int]]:
    """Secrets of one layer: (kind, start, end), leftmost without overlaps within a kind."""
    out = []
    if _HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


class Layer:
    """A text, and for each of its characters the range of source characters behind it (None: the source itself)."""

    def __init__(self, text: str, low: np.ndarray | None, high: np.ndarray | None, depth: int):
        self.text, self.low, self.high, self.depth = text, low, high, depth

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.low is None else (int(self.low[start:end].min()), int(self.high[start:end].max()))


def _characters(data: bytes, low: np.ndarray, high: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Decode UTF-8, other bytes as escaped ones, and bring the ranges of bytes to ranges of characters."""
    text = data.decode("utf-8", "surrogateescape")
    if len(text) == len(data):
        return text, low, high
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    escaped = (codes >= 0xDC80) & (codes <= 0xDCFF)
    sizes = np.where((codes < 0x80) | escaped, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
    heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return text, np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)


_STREAMS = ((b"\x1f\x8b", lambda: zlib.decompressobj(47)), (b"\x78", lambda: zlib.decompressobj(15)), (b"BZh", bz2.BZ2Decompressor),
            (b"\xfd7zXZ\x00", lambda: lzma.LZMADecompressor(memlimit=1 << 28)))
_ERRORS = (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)
Bytes = Callable[[], Iterator[bytes]]


def _head(source: Iterator[bytes], size: int = 6) -> tuple[bytes, Iterator[bytes]]:
    """The first bytes, and an iterator over all."""
    start = b""
    for chunk in source:
        start += chunk
        if len(start) >= size:
            break
    return start[:size], itertools.chain([start] if start else [], source)


def _members(source: Iterator[bytes], magic: bytes, make: Callable, left: list[int]) -> Iterator[bytes]:
    """The content of a stream and of the members that follow it, in chunks. A damaged first member raises; ``left`` gets the number of bytes after the last."""
    first = True
    while True:
        start, source = _head(source)
        if not start.startswith(magic):
            left[:] = [sum(map(len, source))]
            return
        stream, rest = make(), b""
        try:
            for data in source:
                while not stream.eof:
                    if isinstance(stream, bz2.BZ2Decompressor | lzma.LZMADecompressor):
                        out = stream.decompress(data, CHUNK)
                        data, more = b"", not stream.needs_input
                    else:
                        out = stream.decompress(data, CHUNK)
                        data, more = stream.unconsumed_tail, len(out) == CHUNK or bool(stream.unconsumed_tail)
                    if out:
                        yield out
                    if not more:
                        break
                if stream.eof:
                    rest = stream.unused_data
                    break
        except _ERRORS:
            if first:
                raise
            return
        if not stream.eof:
            return
        first, source = False, itertools.chain([rest] if rest else [], source)


def _raw(data: bytes) -> Iterator[bytes]:
    """The content of a raw deflate stream that is all of ``data``; raises if it isn't one."""
    stream = zlib.decompressobj(-15)
    while not stream.eof:
        out, data = stream.decompress(data, CHUNK), stream.unconsumed_tail
        if out:
            yield out
        elif not data:
            break
    if not stream.eof or stream.unused_data:
        raise zlib.error("not a whole raw stream")


def _text(source: Bytes) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8")("surrogateescape")
    for chunk in source():
        if text := decoder.decode(chunk):
            yield text
    if text := decoder.decode(b"", True):
        yield text


def _opens(data: bytes) -> bool:
    """Whether the start of ``data`` can be unfolded."""
    for magic, make in _STREAMS:
        if data.startswith(magic):
            try:
                stream = make()
                out = stream.decompress(data[:512], 4096)
                return bool(out) and (stream.eof or len(out) >= 14) if magic == b"\x78" else True  # two bytes prove little; no secret is shorter
            except _ERRORS:
                return False
    return False


def _unfold(data: bytes) -> tuple[Bytes, int] | None:
    """The content of a stream, or of streams in one another, and the number of bytes after the outer one; None if there is none."""
    source: Bytes = lambda: iter([data])
    seen = {hashlib.sha256(data).digest()}
    behind, before, grown = 0, len(data), 0
    while grown < GROWING:
        left = [0]
        try:
            start, _ = _head(source())
            known = [x for x in _STREAMS if start.startswith(x[0])]
            if not known:
                break
            magic, make = known[0]
            inner: Bytes = lambda s=source, m=magic, k=make: _members(s(), m, k, [0])
            content, held, size = hashlib.sha256(), [], 0
            for chunk in _members(source(), magic, make, left):
                content.update(chunk)
                size += len(chunk)
                held = [*held, chunk] if size <= CHUNK else []
        except _ERRORS:
            break  # this only looked like a stream
        if not size or content.digest() in seen:
            break
        behind = left[0] if len(seen) == 1 else behind
        seen.add(content.digest())
        before, grown = size, grown + 1 if size > before else 0
        source = (lambda whole=b"".join(held): iter([whole])) if size <= CHUNK else inner  # short ones are held, so nesting may be deep
    if len(seen) > 1:
        return source, behind
    try:
        if len(data) > 8 and any([_worth(chunk) for chunk in _raw(data)]):
            return (lambda: _raw(data)), 0
    except _ERRORS:
        pass
    return None


def _readable(data: bytes) -> bool:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return bool(text) and text.replace("\t", "").replace("\n", "").replace("\r", "").isprintable()


def _worth(data: bytes) -> bool:
    """Whether bytes hold what a secret, an encoding or a stream may be made of."""
    return (_WORTH.search(data) is not None
            or any(_opens(data[m.start():m.start() + 512]) for m in _STREAM_BYTES.finditer(data)))


#: Start and end in the layer, and what comes instead: texts with the ranges of their characters.
Chunks = Callable[[], Iterator[tuple[str, np.ndarray, np.ndarray]]]
Part = tuple[int, int, Chunks]


def _one(start: int, end: int, got: tuple[str, np.ndarray, np.ndarray]) -> Part:
    return start, end, lambda: iter([got])


def _unfolded(start: int, end: int, data: bytes) -> Part | None:
    """Bytes that are a compressed stream as a part: each of its characters comes from the whole range."""
    got = _unfold(data)
    return _spread(start, end, got[0]) if got is not None and not got[1] else None  # with bytes behind it: left to _streams


def _spread(start: int, end: int, source: Bytes) -> Part:
    return start, end, lambda: ((text, np.full(len(text), start), np.full(len(text), end)) for text in _text(source))


def _url(text: str) -> Iterator[Part]:
    for m in _URL_MIXED.finditer(text):
        for plus in (m[0], m[0].replace("+", " ")):
            data = urllib.parse.unquote_to_bytes(plus)
            if (part := _unfolded(m.start(), m.end(), data)) is not None:
                break
        if part is not None:
            yield part
            continue
        for n in _URL.finditer(text, m.start(), m.end()):
            data = bytes.fromhex(n[0].replace("%", ""))
            at = n.start() + 3 * np.arange(len(data))
            if (part := _unfolded(n.start(), n.end(), data)) is not None:
                yield part
            else:
                yield _one(n.start(), n.end(), _characters(data, at, at + 3))


def _escapes(text: str) -> Iterator[Part]:
    units: list[tuple[int, int, int]] = []

    def flush() -> Iterator[Part]:
        if not units:
            return
        codes = b"".join(c.to_bytes(2, "big") if c < 0x10000 else chr(c).encode("utf-16-be") for _, _, c in units)
        got = codes.decode("utf-16-be", "replace")  # pairs of surrogates become one character
        if len(got) == len(units):
            low, high = (np.array([u[k] for u in units]) for k in (0, 1))
        else:
            low, high = np.full(len(got), units[0][0]), np.full(len(got), units[-1][1])
        yield _one(units[0][0], units[-1][1], (got, low, high))
        units.clear()

    for m in _ESCAPE.finditer(text):
        code = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
        if code > 0x10FFFF:
            continue
        if units and units[-1][1] != m.start():
            yield from flush()
        units.append((m.start(), m.end(), code))
    yield from flush()


def _base64(text: str, runs: list[tuple[int, int]], skip: int) -> Iterator[Part]:
    """Runs decoded from their first character, or from one after ``skip`` others; there, bytes that are text alone don't count."""
    for first, end in runs:
        start, run = first + skip, text[first + skip:end].rstrip("=")
        run = run[:len(run) - (len(run) % 4 == 1)]
        try:
            data = base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        if (part := _unfolded(start, end, data)) is not None:
            yield part
        elif _worth(data) or not skip and _readable(data):
            bits = 8 * np.arange(len(data))
            low, high = start + bits // 6, start + (bits + 13) // 6
            high[-1] = end
            yield _one(start, end, _characters(data, low, high))


def _streams(text: str) -> Iterator[Part]:
    """Compressed streams among other decoded bytes."""
    at = 0
    for m in _STREAM.finditer(text):
        if m.start() < at or not _opens(text[m.start():m.start() + 512].encode("utf-8", "surrogateescape")):
            continue
        data = text[m.start():].encode("utf-8", "surrogateescape")
        if (got := _unfold(data)) is not None:
            at = m.start() + len(data[:len(data) - got[1]].decode("utf-8", "surrogateescape"))
            yield _spread(m.start(), at, got[0])


def _wide(text: str) -> Iterator[Part]:
    """Runs of characters of one byte each in UTF-16."""
    for m in _WIDE.finditer(text):
        low = np.arange(m.start(), m.end(), 2)
        yield _one(m.start(), m.end(), (m[0].replace("\x00", ""), low, low + 2))


def _decoded(layer: Layer) -> Iterator[list[Part]]:
    """What each decoding finds in a layer; nothing for those that find nothing."""
    text = layer.text
    for hint, decode in (("%", _url), ("\\&", _escapes), ("\x1fBx\udcfd" if layer.depth else "", _streams), ("\x00", _wide)):
        if any(c in text for c in hint) and (parts := list(decode(text))):
            yield parts
    runs = [m.span() for m in _BASE64.finditer(text)]
    for skip in range(4):
        if parts := list(_base64(text, runs, skip)):
            yield parts


def _children(layer: Layer, parts: list[Part]) -> Iterator[Layer]:
    """The layer with decoded parts put in place of what they were; in several pieces if it is long."""
    base_low = layer.low if layer.low is not None else np.arange(len(layer.text))
    base_high = layer.high if layer.high is not None else np.arange(1, len(layer.text) + 1)

    def segments() -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        at = 0
        for start, end, chunks in parts:
            yield layer.text[at:start], base_low[at:start], base_high[at:start]
            for got, low, high in chunks():
                yield got, base_low[low], base_high[high - 1]
            at = end
        yield layer.text[at:], base_low[at:], base_high[at:]

    held: list[tuple[str, np.ndarray, np.ndarray]] = []
    size, limit = 0, PIECE
    for segment in segments():
        held.append(segment)
        size += len(segment[0])
        if size > limit:
            text, low, high = "".join(x[0] for x in held), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            if cut := len(text.rstrip(_JOINED)):
                yield Layer(text[:cut], low[:cut], high[:cut], layer.depth + 1)
            held, size = [(text[cut:], low[cut:], high[cut:])], len(text) - cut
            limit = max(PIECE, 2 * size)
    yield Layer("".join(x[0] for x in held), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), layer.depth + 1)


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def _search(first: Layer, known: set[bytes], found: dict[tuple[str, int, int], int]) -> None:
    """Put the spans of a layer and of all that is decoded from it in ``found``, each with its least depth."""
    seen, work = known | {_digest(first.text)}, [first]
    while work:
        layer = work.pop(0)
        for kind, start, end in find(layer.text):
            key = (kind, *layer.source(start, end))
            found[key] = min(found.get(key, layer.depth), layer.depth)
        for parts in _decoded(layer):
            children = _children(layer, parts)
            child, more = next(children), next(children, None)
            if more is None:
                if (digest := _digest(child.text)) not in seen:
                    seen.add(digest)
                    work.append(child)
                continue
            for piece in itertools.chain([child, more], children):  # not on the list, so only one is held
                if _digest(piece.text) not in seen:
                    _search(piece, seen, found)


def scan_text(text: str) -> list[tuple[str, int, int, int]]:
    """All spans of a text with the number of decodings at which each was first found, 0 for plain ones."""
    found: dict[tuple[str, int, int], int] = {}
    _search(Layer(text, None, None, 0), set(), found)
    order = sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return [(*x, found[x]) for x in order]


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document with all its spans (code points, end exclusive), ordered by start, kind and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())])
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e, "depth": d} for k, s, e, d in scan_text(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact_text(text: str, mark: str = "[secret]") -> str:
    """The text with every span, plain or encoded, replaced by ``mark``; spans that touch become one."""
    out, at = [], 0
    for _, start, end, _ in sorted(scan_text(text), key=lambda x: x[1]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with redacted texts (null stays null); ``n_chars``, if there, follows a text that is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact_text(t, mark) for t in batch.column("text").to_pylist()]
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                was = batch.column("n_chars").to_pylist()
                columns["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, was, strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)
