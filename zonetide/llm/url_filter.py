"""URL filters: a trie over reversed host labels, and below each host over path segments.

A rule (verdict, host, path) fits its host and every subdomain, where the url's path starts with the rule's; an empty host
fits every host. Of the fitting rules the one with the most host labels decides, among these the one with the longest
path: the walk goes down the labels as far as they lead and comes back until a host's paths hold a match. The last piece of
a rule's path, behind its last ``/``, is compared by characters, so ``/en`` fits ``/english`` and ``/en/`` does not.

The trie is broadcast. A block of rules holds at most ``RULES`` of them and ``CHARACTERS`` characters, which bounds what
the driver collects and a worker holds; further rules come in further blocks, each with one more pass over the urls, and
the best rule of all blocks decides. Urls are never shuffled, so a hot host costs nothing.

Null url, or one without ``://``: host and path are empty. No rule fits: ``otherwise``. Rules without a host (null) or with
another verdict are ignored; of equal host and path, block wins. Ties cannot arise otherwise. Repeated urls are judged each
for itself. Further columns stay; those named like an added one are replaced. An empty table gives an empty result,
an empty rule table gives ``otherwise`` everywhere.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.session import written

RULES = 1_000_000
CHARACTERS = 64 << 20
BEST = "labels int, chars int, rule string, verdict string"


class Trie:
    """Numbered nodes and one table of edges, so that a path of any depth can be sent to the workers."""

    def __init__(self, rules: Iterable[tuple[str, str, str]] = ()):
        self.edges: dict[tuple[int, str], int] = {}
        self.paths: dict[int, int] = {}  # host node -> its first path node
        self.whole: dict[int, tuple] = {}  # host node -> rule without a path
        self.tails: dict[int, dict[str, tuple]] = {}  # path node -> last pieces that end a rule here
        self.sizes: dict[int, list[int]] = {}  # path node -> lengths of these, longest first
        self.nodes = 1
        for verdict, host, path in rules:
            self.add(verdict, host, path)

    def _node(self) -> int:
        self.nodes += 1
        return self.nodes - 1

    def _down(self, node: int, name: str) -> int:
        if (node, name) not in self.edges:
            self.edges[node, name] = self._node()
        return self.edges[node, name]

    def add(self, verdict: str, host: str, path: str) -> None:
        node, labels = 0, host.split(".")[::-1] if host else []
        for label in labels:
            node = self._down(node, label)
        end = (len(labels), len(path), host + path, verdict)
        if not path:
            self.whole[node] = end
            return
        if node not in self.paths:
            self.paths[node] = self._node()
        node = self.paths[node]
        *segments, tail = path.split("/")
        for segment in segments:
            node = self._down(node, segment)
        self.tails.setdefault(node, {})[tail] = end
        self.sizes[node] = sorted({len(t) for t in self.tails[node]}, reverse=True)

    def hosts(self, host: str) -> list[int]:
        """Nodes of the host and the domains above it that are in the trie, longest first."""
        out, node = [0], 0
        for label in reversed(host.split(".")):
            node = self.edges.get((node, label))
            if node is None:
                break
            out.append(node)
        return out[::-1]

    def find(self, hosts: list[int], path: str) -> tuple | None:
        segments = path.split("/")
        for host in hosts:
            best, node = self.whole.get(host), self.paths.get(host)
            for i, segment in enumerate(segments):
                if node is None:
                    break
                ends = self.tails.get(node)
                if ends:
                    best = next((ends[segment[:n]] for n in self.sizes[node] if segment[:n] in ends), best)
                node = self.edges.get((node, segment)) if i + 1 < len(segments) else None
            if best is not None:
                return best
        return None


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _best(trie) -> Column:
    """The deciding rule of one block, null without any. ``trie`` is a broadcast."""

    @F.pandas_udf(BEST)
    def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        known, rules = {}, trie.value
        found = []
        for host, path in zip(hosts, paths, strict=True):
            nodes = known.get(host)
            if nodes is None:
                nodes = known[host] = rules.hosts(host)
            found.append(rules.find(nodes, path) or (None, None, None, None))
        return pd.DataFrame(found, columns=["labels", "chars", "rule", "verdict"]).astype({"labels": "Int32", "chars": "Int32"})

    return decide("host", "path")


def judge(urls: DataFrame, rules: DataFrame, otherwise: str = "allow", url: str = "url", block_rules: int = RULES,
          block_characters: int = CHARACTERS) -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict. ``rules``: verdict, host, path."""
    spark = urls.sparkSession
    lowered = F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host")
    clean = (rules.filter(F.col("host").isNotNull() & F.col("verdict").isin("allow", "block"))
             .select(lowered, F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    size = clean.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0)).alias("c")).first()
    blocks = max(1, -(-size["n"] // block_rules), -(-size["c"] // block_characters))
    out = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "_best": F.lit(None).cast(f"struct<{BEST.replace(' ', ':').replace(',:', ',')}>")})
    for k in range(blocks):
        block = clean.filter(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == k)
        trie = spark.sparkContext.broadcast(Trie((r["verdict"], r["host"], r["path"]) for r in block.collect()))
        found = out.withColumn("_new", _best(trie))
        # Structs compare by labels, then characters; a row without a rule is a null.
        new = F.when(F.col("_new.rule").isNotNull(), F.col("_new"))
        out = found.withColumn("_best", F.greatest("_best", new) if k else new).drop("_new")
        if blocks > 1:
            out = written(out, "urls")  # one trie in a worker at a time
    return out.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(otherwise))}).drop("_best")
