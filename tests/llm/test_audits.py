"""Source divergence, url filter and filter interactions against brute force."""

from __future__ import annotations

import collections
import itertools
import os
import random
import re

import duckdb
import pytest

from check_queries import TABLES, table_of
from zonetide.llm import divergence, interactions, queries, url_filter

NEW = ["op11_iceberg_source_divergence", "op12_trie_url_filter", "op13_diagram_filter_interactions"]


@pytest.mark.parametrize("name", NEW)
def test_query_agrees_with_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(small, t)}.parquet')")
    df = queries.QUERIES[name](spark, small)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names) and want
    assert table_of([tuple(r) for r in df.collect()], df.columns) == table_of(want, names)


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source) with nulls, empty and long texts, copies, repeated rows and ties."""
    rng = random.Random(11)
    vocabulary = ["Haus", "haus", "HAUSBAU", "né", "Ñandú", "zz", "x9y", "a", "dampfschifffahrt", "漢字漢字漢字漢字漢字", "q" * 70 + "e"]
    out = [(None, "haus " * 30, "de", "s1"), (1, None, None, None), (2, "", "de", "s2"), (3, "1 2 3 \n", "fr", "s1"), (4, "A" * 50_000, "de", "s3")]
    for i in range(5, 90):
        k = rng.randint(1, 130)
        out.append((i, " ".join(rng.choice(vocabulary) for _ in range(k)) + rng.choice(["", " #", " 100%"]), rng.choice(["de", "fr", None]),
                    rng.choice(["s1", "s2", "s3", None])))
    long = ("w%s " * 30_000) % tuple(range(30_000))
    out += [(90, long, "de", "s1"), (91, long, "fr", "s1"), (7, out[7][1], "fr", "s2"), (7, out[7][1], "fr", "s2"), (200, out[20][1], "de", "s1")]
    out += [(300 + i, out[30][1], "de", "s1") for i in range(40)] + [(None, out[30][1], "de", "s2")] * 2
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, part string, n long, term string, prefix string, mask int"
    return spark.createDataFrame([(*r, "p", 1, "t", "x", 3) for r in rows], schema).repartition(3)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_divergence(rows, least):
    named = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))) for _, text, lang, source in rows]
    documents, counts = collections.Counter(), collections.Counter()
    for lang, source, words in named:
        documents.update((lang, w) for w in set(words))
        counts.update((lang, source, w) for w in words)
    out = []
    for lang in {n[0] for n in named}:
        kept = [w for (x, w), n in documents.items() if x == lang and n >= least]
        sources = sorted({n[1] for n in named if n[0] == lang})
        c = {s: {w: counts[lang, s, w] for w in kept} for s in sources}
        whole = {w: sum(c[s][w] for s in sources) for w in kept}
        share = lambda d: {w: 1 + 1_000_000_000 * (n + 2) // (sum(d.values()) + 2 * len(kept)) for w, n in d.items()}
        p, q = {s: share(c[s]) for s in sources}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(gap(p[s][w], p[t][w]) for w in kept), t) for t in sources if t != s]
            terms = [(gap(p[s][w], q[w]), w) for w in kept if c[s][w] > 0 and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(ordered, start=1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "width"), [(10, 4), (2, 1), (1, 16), (10_000, 4)])
def test_divergence(docs, rows, least, width):
    got = sorted(tuple(r) for r in divergence.audit(docs, least, width).collect())
    assert got == brute_divergence(rows, least)


def test_divergence_does_not_depend_on_the_size_of_the_table(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "FEWEST_BITS", 8)
    monkeypatch.setattr(divergence, "MOST_BITS", 8)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == brute_divergence(rows, 10)


def test_divergence_in_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "_CELLS", 6)
    monkeypatch.setattr(divergence, "TOP", 2)
    want = [r for r in brute_divergence(rows, 2) if r[2] == "pair" or r[5] <= 2]
    names = "lang string, source string, text string"
    import numpy as np
    import pandas as pd

    counts = collections.Counter()
    for _, text, lang, source in rows:
        if lang == "de":
            counts.update((source or "", w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text)))
    documents = collections.Counter()
    for _, text, lang, _s in rows:
        if lang == "de":
            documents.update(set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))))
    frame = pd.DataFrame([(s, w, n) for (s, w), n in counts.items() if documents[w] >= 2], columns=["source", "term", "n"])
    sources = sorted({r[3] or "" for r in rows if r[2] == "de"})
    totals = np.array([frame[frame.source == s].n.sum() for s in sources])
    got = list(divergence._block(frame, "de", sources, totals, frame.term.nunique()))
    assert names and sorted((s, i, v) for _, s, p, i, v in got if p == "term") == sorted((s, i, v) for x, s, p, i, v, _ in want if x == "de" and p == "term")
    assert sorted((s, i, v) for _, s, p, i, v in got if p == "pair") == sorted((s, i, v) for x, s, p, i, v, _ in want if x == "de" and p == "pair" and s < i)


def test_shares_are_exact_beyond_floating_point():
    import numpy as np

    rng = random.Random(5)
    for _ in range(300):
        total, terms = rng.randint(1, 1 << 47), rng.randint(1, 1 << 40)
        count = rng.randint(0, total)
        assert int(divergence.shares(np.array([count]), np.array([total]), terms)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * terms)
    with pytest.raises(OverflowError):
        divergence.shares(np.array([1]), np.array([1 << 50]), 1)


def test_divergence_of_an_empty_table(docs):
    assert divergence.audit(docs.filter("doc_id < 0")).count() == 0


RULES = [("allow", "com", "/"), ("block", "Example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("allow", "net", "/e"),
         ("block", "net", "/es/a/b"), ("block", "example.com", ""), ("allow", "org", "/x"), ("block", "org", "/x"), ("block", None, "/"), ("maybe", "com", "/q/"),
         ("block", "deep.net", None)]


def brute_judge(url, rules, otherwise="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (lowered(m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, h, p in sorted(rules, key=str):
        if h is None or verdict not in ("allow", "block"):
            continue
        h, p = lowered(h), p or ""
        if (host == h or host.endswith("." + h) or not h) and path.startswith(p):
            labels = len(h.split(".")) if h else 0
            best = max(best or (-1,), (labels, len(p), h + p, verdict))
    return (host, path, best[2], best[3]) if best else (host, path, None, otherwise)


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(2)
    out = [None, "", "example.com/en/", "http://", "https:///en/", "https://COM/", "https://com", "https://a.com?x=/", "https://a.com#/en/", "x://y://z.net/es/",
           "https://example.com:80/en/", "https://Éa.net/es/", "https://net/es", "https://net./es/", "https://.net/es/", "https://net//es/",
           "https://www.example.com/en/" + "d/" * 20_000, "https://a.b.example.com/en/\nx", "https://" + "s." * 5_000 + "net/es/a/b", "https://xample.com/en/"]
    for _ in range(300):
        host = ".".join(rng.choice(["a", "www", "example", "deep"]) for _ in range(rng.randint(0, 3)))
        path = "/".join(rng.choice(["", "en", "es", "e", "a", "b", "xyz"]) for _ in range(rng.randint(0, 5)))
        out.append(f"https://{host}.{rng.choice(['com', 'net', 'org'])}/{path}{rng.choice(['', '?q=/es/', '#t'])}")
    return out + out[-3:]


@pytest.mark.parametrize("size", [1_000_000, 3])
def test_url_filter(spark, urls, size):
    table = spark.createDataFrame([(i, u, "h", "r", 0) for i, u in enumerate(urls)], "page_id int, url string, host string, rule string, labels int")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = url_filter.judge(table.repartition(3), rules, block_rules=size)
    assert got.columns == ["page_id", "url", "host", "rule", "labels", "path", "verdict"]
    rows = got.collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute_judge(urls[r.page_id], RULES), urls[r.page_id]
    assert url_filter.judge(table.limit(0), rules).count() == 0


def test_url_filter_without_rules(spark, urls):
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert {(r.rule, r.verdict) for r in url_filter.judge(table, rules, otherwise="block").collect()} == {(None, "block")}
    everywhere = spark.createDataFrame([("block", "", "/en/")], "verdict string, host string, path string")
    found = url_filter.judge(table, everywhere).collect()
    assert [r.verdict for r in found] == [brute_judge(r.url, [("block", "", "/en/")])[3] for r in found]


LABELS = [(5, 1, 0), (5, 0, 1), (6, 1, 1), (7, 0, 1), (8, None, None), (20, 1, 0), (200, 1, 1), (30, 1, 0), (310, 1, 1), (None, 1, 1), (999, 1, 1), (0, 1, 1)]


def brute_interactions(rows, labels):
    low, marks = {}, {}
    for i, text, _, _ in rows:
        if i is not None:
            low[text or ""] = min(low.get(text or "", i), i)
    for i, q, t in labels:
        if i is not None:
            old = marks.get(i, (0, 0))
            marks[i] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    parts = collections.defaultdict(list)
    for i, text, lang, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > low[text]}
        parts[lang or ""].append((fails, *marks.get(i, (0, 0))))
    out = []
    for part, found in parts.items():
        shapley, mine = collections.Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = found
            for step, f in enumerate(order, start=1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                shapley[f] += len(gone)
                mine.append((part, order, step, f, len(left), len(gone), sum(d[0][f] for d in found) - len(gone),
                             sum(d[0][f] and sum(d[0].values()) == 1 for d in found), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*m, shapley[m[3]]) for m in mine]
    return sorted(out)


def test_interactions(spark, docs, rows):
    labels = spark.createDataFrame([(*x, "z") for x in LABELS], "doc_id long, quality int, toxic int, lang string")
    got = sorted(tuple(r) for r in interactions.audit(docs, labels).collect())
    assert got == brute_interactions(rows, LABELS)
    assert interactions.audit(docs.filter("doc_id < 0"), labels).count() == 0
    bare = interactions.audit(docs, labels.limit(0)).collect()
    assert len(bare) == 3 * 600 and all(r.good_lost == r.toxic_lost == 0 for r in bare)


def test_diagram_swaps_keep_what_every_set_counts():
    rng = random.Random(4)
    counts = {frozenset(f for f in "ABCDE" if rng.random() < 0.4): (rng.randint(1, 9), rng.randint(0, 3)) for _ in range(14)}
    diagram = interactions.Diagram("ABCDE", counts)

    def sets(at):
        node = diagram.node[at]
        if node is None:
            return {frozenset(): diagram.weight[at]} if at != diagram.ZERO else {}
        return sets(node[1]) | {s | {node[0]}: w for s, w in sets(node[2]).items()}

    orders = set()
    for place in [None, *interactions.adjacent_swaps(5)]:
        if place is not None:
            diagram.swap(place)
        orders.add("".join(diagram.order))
        assert sets(diagram.root) == counts
        for at, node in diagram.node.items():  # levels in order, equal nodes shared, no empty high branch
            if node:
                assert node[2] != diagram.ZERO and diagram.weight[at] == tuple(map(sum, zip(diagram.weight[node[1]], diagram.weight[node[2]], strict=True)))
                assert all(not diagram.node[x] or diagram.order.index(diagram.node[x][0]) > diagram.order.index(node[0]) for x in node[1:])
        inner = [n for n in diagram.node.values() if n]
        assert len(inner) == len(set(inner))
    assert len(orders) == 120
