"""Operators against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import bz2
import collections
import gzip
import lzma
import random
import re
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zonetide.llm import backoff, decontamination, jaccard, language, packing, quality, recompression, secrets, toxicity, words, wrappers

pytest.importorskip("public_tokenizers")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["a", "b", "De", "the", "ost", "né", "x9", "|"]
    out = [None, "", "  \n", "one", "one", "a " * 90, "The the THE. é"]
    for _ in range(60):
        out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))))
    for k in range(12):  # near copies
        w = out[20].split() * 3
        w[k] = f"new{k}"
        out.append(" ".join(w))
    out += [" ".join(out[30:34]), "x " + out[31] + " y", out[40], "lorem " * 3000 + "end"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "n", "k") for i, t in enumerate(texts)] + [(5, texts[5], "n", "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, row string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    from zonetide.llm.queries import vocabulary

    rows = packing.pack(docs, vocabulary()).collect()
    tok = Tokenizer.from_file(vocabulary())
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for d in docs.collect():
        if d.doc_id == 5:
            continue
        ids = np.array(tok.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert b"".join(bytes(r.ids) for r in sorted(by[d.doc_id], key=lambda r: r.start)) == ids
    for v in seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack(empty, vocabulary()).count() == 0


@pytest.mark.parametrize("length", [1, 127, 128, 4095, 4096, 9001])
def test_cut(length):
    assert sum(packing.cut(length, 4096, 128)) == length


def test_words_split_as_bytes(texts):
    w = words.words_of(pa.array(texts, pa.string()))
    assert [w.data[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)] == [x for t in texts for x in (t or "").encode().split()]


def test_quality(spark, docs, empty, texts):
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, None)], "doc_id long, quality int")
    for r in quality.judge(docs.select("doc_id", "text"), labels).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        c = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.kept and r.base_failed)
    assert quality.judge(empty.select("doc_id", "text"), labels).count() == 0


def test_recompression(docs, empty, texts):
    size = 35
    everything = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    c = collections.Counter(tuple(w[p:p + size]) for _, w in everything for p in range(len(w) - size + 1))
    want = {}
    for i, w in everything:
        gone = {j for p in range(len(w) - size + 1) if c[tuple(w[p:p + size])] > 1 for j in range(p, p + size)}
        want[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    got = recompression.remove_repeats(docs).collect()
    assert len(got) == len(everything) and all((r.n_words, r.n_removed, r.kept) == want[r.doc_id] for r in got)
    assert recompression.remove_repeats(empty).count() == 0


def test_jaccard(docs, empty, texts):
    def shingles(t):
        w = low(t).encode().split()
        return frozenset(tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()

    sets = {i: shingles(t) for i, t in enumerate(texts)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = jaccard.join(docs).collect()
    assert len(got) == len(texts) + 1
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id]) for r in got)
    kept = jaccard.first_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values())) and kept.columns == docs.columns
    assert jaccard.join(empty).count() == 0
    nameless = docs.union(docs.limit(1).select(F.lit(None).cast("long"), "text", "kept", "row"))
    assert jaccard.first_of_each(nameless).filter("doc_id is null").count() == 1


def test_jaccard_region_recursion():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 60, 100)
    sets = []
    for _ in range(300):
        s = base.copy()
        k = rng.integers(0, 25)
        s[rng.choice(100, k, replace=False)] = rng.integers(1, 1 << 60, k)
        sets.append(np.sort(s).astype(np.uint64))
    region = jaccard.Region(np.concatenate(sets), np.arange(0, 30001, 100), 85)
    region.join(np.arange(300))
    root = list(range(300))
    for a in range(300):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (200 - both):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    same = lambda r: {tuple(np.flatnonzero(np.array(r) == k)) for k in set(r)}
    assert same(root) == same(region.root.tolist())


def test_decontamination(spark, docs, empty, texts):
    items = [(1, " ".join(texts[10].split()[:14])), (2, None), (3, "ONE"), (4, texts[11]), (4, texts[12]), (10, "lorem " * 10)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = pattern.findall(low(t))
        for p in range(max(len(w) - 9, min(len(w), 1))):
            windows[tuple(w[p:p + 10])].add(str(i))
    for r in decontamination.hits(docs, benchmark).collect():
        w, hit, met = pattern.findall(low(texts[r.doc_id])), set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if tuple(w[p:p + size]) in windows:
                    hit |= set(range(p, p + size))
                    met |= windows[tuple(w[p:p + size])]
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(met))
    assert decontamination.hits(empty, benchmark).count() == 0
    assert decontamination.clean(docs, benchmark.filter("item_id < 0")).count() == len(texts) + 1


def test_secrets_through_layers(spark, empty):
    plain = "password=hunter2hunter2"
    coded = base64.b64encode(plain.encode()).decode()
    cases = {plain: (0, 23, 0), f"x {coded} y": (2, 34, 1), "see password%3Dhunter2hunter2 ok": (4, 29, 1), base64.b64encode(gzip.compress(plain.encode(), mtime=0)).decode(): None,
             base64.b64encode(coded.encode()).decode(): None, "".join(f"\\u{ord(c):04x}" for c in plain): (0, 138, 1)}
    for text, want in cases.items():
        found = [x for x in secrets.scan_text(text) if x[0] == "assign"]
        assert found and (want is None or found[0][1:] == want)
        assert "hunter2" not in secrets.redact_text(text) and "[secret]" in secrets.redact_text(text)
    assert secrets.scan_text("") == [] and secrets.scan_text("%25" * 9) == []
    df = spark.createDataFrame([(1, None, 0), (2, plain, 23)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secrets.redact(df).orderBy("doc_id").collect()] == [(1, None, 0), (2, "[secret]", 8)]
    assert secrets.scan(empty).count() == 0


def test_backoff(docs, empty):
    rows = backoff.score(docs, buckets=3).collect()
    tokens = {r.doc_id: low(r.text).encode().split() + [None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = collections.Counter(w for r in docs.collect() if not held[r.doc_id] for w in tokens[r.doc_id])
    total = sum(c.values())
    assert len(rows) == len(tokens) + 1
    for r in rows:
        base = sum(np.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens[r.doc_id]), sum(w in c for w in tokens[r.doc_id]), total)
        assert abs(base - r.base_score) < 1e-6 * abs(base) + 1e-9 and r.score < 0
    assert backoff.score(empty).count() == 0


def test_secrets_behind_long_and_nested_streams():
    plain = b"password=hunter2hunter2"
    log = "é line of a log, again\n".encode() * 800_000  # 19 MB, and no chunk ends where a character does
    b64 = lambda data: base64.b64encode(data).decode()
    cases = {"behind 16 MB": b64(gzip.compress(log + plain, 1)), "bz2": b64(bz2.compress(log + plain, 1)), "xz": b64(lzma.compress(log + plain, preset=0)),
             "gzip in gzip": b64(gzip.compress(gzip.compress(plain))), "gzip in xz in bz2": b64(bz2.compress(lzma.compress(gzip.compress(plain)))),
             "second member": b64(gzip.compress(b"nothing here\n") + gzip.compress(plain)), "second bz2": b64(bz2.compress(b"nothing\n") + bz2.compress(plain)),
             "percent-encoded": "".join(f"%{x:02x}" for x in gzip.compress(plain)), "quoted": urllib.parse.quote(zlib.compress(plain)),
             "base64 behind 16 MB": b64(gzip.compress(log + b64(plain).encode() + b"\n" + log, 1))}
    for name, text in cases.items():
        found = secrets.scan_text(f"see {text} !")
        assert ("assign", 4, 4 + len(text)) in [x[:3] for x in found], name
        assert secrets.redact_text(f"see {text} !") == "see [secret] !", name
    damaged = gzip.compress(b"x" * 99 + plain)
    assert secrets.scan_text(b64(damaged[:30] + b"\xff" * 20)) == []


def test_secrets_of_pieces_are_those_of_the_whole(monkeypatch):
    rng = random.Random(5)
    bits = ["password", "=", " ", "hunter2hunter2", "AKIA" + "Q7" * 8, "0a" * 16, ",", "\n", "é", "%70%61ssword%3d", base64.b64encode(b"secret: abcdefgh12").decode(), "\\u0041KIA"]
    texts = ["".join(rng.choice(bits) for _ in range(60)) for _ in range(40)]
    texts = [base64.b64encode(gzip.compress(t.encode())).decode() + rng.choice([" ", "", "ssword=abcdefgh"]) + t for t in texts]
    whole = [secrets.scan_text(t) for t in texts]
    monkeypatch.setattr(secrets, "PIECE", 20)
    monkeypatch.setattr(secrets, "CHUNK", 7)
    assert [secrets.scan_text(t) for t in texts] == whole


def test_quality_counts_all_trusted_documents(docs, monkeypatch):
    """However few ids are held at a time."""
    labels = docs.select("doc_id", F.lit(1).alias("quality")).filter("doc_id % 2 = 0")
    whole = quality.weights(docs, labels, 64).first()["w"]
    monkeypatch.setattr(quality, "TRUSTED", 15)
    assert quality.weights(docs, labels, 64).first()["w"] == whole


def brute_katz(rows):
    """Scores of (doc_id, tokens): one Katz model with exact word shares and Good-Turing discounts of all bigrams."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = collections.Counter(w for i, t in rows if not held[i] for w in t)
    pairs = collections.Counter(x for i, t in rows if not held[i] for x in zip(["<s>", *t], t))
    n = sum(c.values())
    unseen = min(max(sum(k == 1 for k in c.values()), 1) / n, 0.5)
    p1 = lambda w: c[w] * (1 - unseen) / n if w in c else unseen / 65536
    d = backoff.ratios(np.bincount(np.minimum(list(pairs.values()), 7), minlength=8))
    total, kept, mass = collections.Counter(), collections.Counter(), collections.Counter()
    for (h, w), k in pairs.items():
        total[h] += k
        kept[h] += d[min(k, 6)] * k
        mass[h] += p1(w)

    def p(h, w):
        if not total[h]:
            return p1(w)
        left, scale = 1 - kept[h] / total[h], 1
        if left < 1e-9:
            left, scale = 1 / (total[h] + 1), total[h] / (total[h] + 1)
        return d[min(pairs[h, w], 6)] * pairs[h, w] * scale / total[h] if (h, w) in pairs else left / max(1 - mass[h], 1e-12) * p1(w)

    return {i: sum(np.log10(p(*x)) for x in zip(["<s>", *t], t)) for i, t in rows}


def test_backoff_is_one_model_for_any_number_of_tasks(docs):
    tokens = [(r.doc_id, [*low(r.text).encode().split(), "</s>"]) for r in docs.collect()]
    want = brute_katz(tokens)
    for buckets in (1, 7, 400):  # at 400 the common words are split
        got = {r.doc_id: r.score for r in backoff.score(docs, buckets=buckets).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_backoff_keeps_the_counts_of_all_words(spark):
    """Over 200,000 words: each has its own share, however rare."""
    many = [f"w{k}" for k in range(205_000)]
    rows = [(1, " ".join(many * 3)), (2, " ".join([*["rare"] * 2, "once"])), (3, "never once rare w7 often"), (4, "w5 rare once w9")]
    tokens = [(i, [*t.split(), "</s>"]) for i, t in rows]
    assert zlib.crc32(b"1") % 10 and zlib.crc32(b"2") % 10
    got = {r.doc_id: r.score for r in backoff.score(spark.createDataFrame(rows, "doc_id long, text string"), buckets=4).collect()}
    assert got == pytest.approx(brute_katz(tokens), rel=1e-9)


def test_backoff_sends_counts_not_occurrences(spark, monkeypatch):
    """However often a word and a pair occur, their bucket gets one entry a part."""
    monkeypatch.setattr(backoff, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
    parts = backoff.Parts(3)
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["the " * 5000, "the a"])], ["doc_id", "text"])
    (out,) = [*parts.add(batch), *parts.flush()]
    dealt = [backoff._unpack(d) for b, d in zip(out.column("bucket").to_pylist(), out.column("data").to_pylist(), strict=True) if b >= 0]
    assert sorted(k for x in dealt for k in x[2].tolist()) == [1, 2, 5001]


def test_backoff_is_normalised():
    """Seen words, and unseen ones added without training counts, sum to one."""
    rng = np.random.default_rng(0)
    v = 50
    p1 = rng.dirichlet(np.ones(v))
    seen = np.sort(rng.zipf(1.5, 400) % v)
    w = np.sort(np.concatenate((seen, np.arange(v))))
    order = np.lexsort((np.arange(len(w)), w))
    train = np.zeros(len(w), bool)
    first = backoff._runs(w)
    train[:] = True
    train[first] = False  # one untrained token of every word
    logs = backoff.group_scores(np.zeros(len(w), np.int64), w[order].astype(np.uint64), train, p1[w])
    assert abs((10 ** logs[first]).sum() - 1) < 1e-9


def test_toxicity_counterfactual(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        bad = i % 2
        w = [rng.choice("sun moon river stone cloud tree".split()) for _ in range(12)] + (["vilewordx"] if bad and i % 4 == 1 else [])
        if bad or i % 20 == 0:
            w.append("muslim")
        elif i % 3 == 0:
            w.append("christian")
        rows.append((i, " ".join(w), bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    probe = spark.createDataFrame([(1000, "the muslim river", 0), (1001, "the christian river", 0), (1002, None, 0), (1003, "", 0)], docs.schema)
    both = docs.union(probe)
    gap = {}
    for penalty in (0.0, 5.0):
        s = {r.doc_id: r.score for r in toxicity.score(both, docs.select("doc_id", "toxic"), penalty).collect()}
        gap[penalty] = abs(s[1000] - s[1001])
        assert s[1002] == s[1003] and 0 <= s[1002] <= 1
    assert gap[5.0] < 0.5 * gap[0.0]


def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) > 0.9 * len(rows)
    odd = spark.createDataFrame([(1, None, None), (2, "", None), (3, "12 !", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(docs.union(odd)).filter("doc_id < 4").join(odd.select("doc_id", F.lit(1).alias("o")), "doc_id").collect()} >= {("und", 0.0)}
    assert {r.lang_pred for r in language.identify(odd).collect()} == {"und"}


def test_wrappers(spark, docs):
    page = "<html><body><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><div class='content'><h1>T{0}</h1>{1}</div><div class='comments'><p>hey {0}</p></div><footer>&copy; me</footer></body>"
    rows = [(k, f"http://h.example/{k}", page.format(k, "".join(f"<p>par {k} {j} &amp; <b>x</b>\n y" for j in range(k + 1)))) for k in range(5)]
    rows += [(9, None, None), (10, "http://h.example/z", ""), (11, "nohost", "<article><p>a<br>b</p><script>x</p></script></article><aside>no</aside>")]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(5):
        assert got[k] == "\n\n".join([f"T{k}"] + [f"par {k} {j} & x y" for j in range(k + 1)])
    assert (got[9], got[10], got[11]) == ("", "", "a b")


def test_pipeline(spark, small):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    now, kept = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, small)
        assert now.columns == docs.columns
        kept.append({r.doc_id for r in now.collect()})
    assert kept[0] >= kept[1] >= kept[2] == kept[3]
    packed = pipeline.run(spark, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept[3]
