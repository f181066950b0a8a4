"""Quality rules: plain counts of a text, and a hashed n-gram log-likelihood ratio against a trusted target.

Column expressions and aggregates only. The n-grams of a text, its words and its pairs of neighbours, are hashed to ``BUCKETS`` numbers.
One multinomial is counted over the documents whose ``labels.quality`` is 1, one over all documents. A document's score
is the mean, over its n-grams, of ``log p(target) - log p(all)``; it is kept if the score reaches ``threshold``
(at a tie too) and the counts pass.

Null or empty text: no words, so it fails the counts. Repeated rows are judged each for itself. Without trusted
documents every score is 0 and only the counts decide. Further columns of ``docs`` stay where they are; a column that
has the name of an added one is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
THRESHOLD = -0.15
#: Added to each bucket's count, as a share of a mean bucket.
SMOOTHING = 0.05
#: Trusted ids up to which they are broadcast; more of them meet the documents in a shuffled join, with the same counts.
TRUSTED = 1_000_000
WINDOW = 8
_BLANK = " \t\n\x0b\x0c\r"
_RUN = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _RUN))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash is there twice or more."""

    def count(sorted_: Column) -> Column:
        same = lambda a, b: F.get(sorted_, a)["h"] == F.get(sorted_, b)["h"]
        again = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1),
                         lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        places = F.sort_array(F.transform(again, lambda k: F.get(sorted_, k)["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    return _let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), count)


def _joined(k: int) -> Callable[[Column], Column]:
    """Each hash with the one ``k`` places behind it."""
    return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + k)))


def repeated_words(pairs: Column) -> Column:
    """Words inside 8-word windows found twice or more, from the hashes of each word and the next."""
    n = F.size(pairs)
    # Hashes of two, then four, then eight words; the last seven places have no window.
    windows = F.slice(_let(_let(pairs, _joined(2)), _joined(4)), F.lit(1), n - WINDOW + 1)
    per_text = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(per_text)


def _whole(pairs: Column) -> Column:
    """Pairs without that of the last word, which has no next one."""
    return F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0)))


def _measures(text: Column, weights_: Column, buckets: int) -> Column:
    """All that needs the words, from one pass over them."""

    def of_hashes(w: Column, h: Column, pairs: Column) -> Column:
        weight = lambda acc, x: acc + F.get(w, F.pmod(x, F.lit(buckets)).cast("int"))
        total = F.aggregate(_whole(pairs), F.aggregate(h, F.lit(0.0), weight), weight)
        return F.struct(repeated_words(pairs).cast("long").alias("n_repeat_words"), F.try_divide(total, 2 * F.size(h) - 1).alias("ratio"))

    def of_words(s: Column) -> Column:
        h = F.transform(s["x"], lambda x: F.xxhash64(x))
        return F.struct(F.size(s["x"]).cast("long").alias("n_words"),
                        F.length(F.array_join(s["x"], "")).cast("long").alias("word_chars"),
                        _let(F.struct(s["w"].alias("w"), h.alias("h")), lambda p: _let(
                            F.struct(p["w"].alias("w"), p["h"].alias("h"), _joined(1)(p["h"]).alias("p")),
                            lambda q: of_hashes(q["w"], q["h"], q["p"]))).alias("of"))

    return _let(F.struct(words(text).alias("x"), weights_.alias("w")), of_words)


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``w``: log p(target) - log p(all) for each bucket. Its size depends on ``buckets`` alone."""
    spark = docs.sparkSession
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("_id")).distinct()
    few = good.limit(TRUSTED + 1).count() <= TRUSTED
    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    hashed = F.transform(_let(hashes, lambda h: F.concat(h, _whole(_joined(1)(h)))), lambda x: F.pmod(x, F.lit(buckets)))
    # A row without an id is no trusted one; in a shuffled join it goes where its text's hash puts it.
    named = docs.select("text", F.col("doc_id").isNotNull().alias("_named"), F.coalesce("doc_id", F.xxhash64("text")).alias("_key"))
    marked = named.join(F.broadcast(good) if few else good, F.col("_named") & (F.col("_key") == F.col("_id")), "left")
    seen = (marked.select(F.col("_id").isNotNull().cast("long").alias("good"), F.explode(hashed).alias("b"))
            .groupBy("b").agg(F.sum("good").alias("t"), F.count("*").alias("r")))
    every = spark.range(buckets).join(seen, F.col("id") == F.col("b"), "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in "tr"])
    one = every.agg(F.sum("t").alias("ts"), F.sum("r").alias("rs"), F.array_sort(F.collect_list(F.struct("id", "t", "r"))).alias("all"))
    add = F.lit(SMOOTHING / buckets)
    part = lambda x, total: F.log(x / total + add)
    return one.select(F.when(F.col("ts") == 0, F.array_repeat(F.lit(0.0).cast("double"), buckets)).otherwise(
        F.transform("all", lambda x: part(x["t"], F.col("ts")) - part(x["r"], F.col("rs")))).alias("w"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio and kept.

    ``ratio`` is the length-normalised log-likelihood ratio, 0 without words.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_BLANK)) != "")
    symbols = sum((F.length(text) - F.length(F.replace(text, F.lit(c))) for c in "#*$%&|<>"), F.lit(0))
    # The weights are a scalar subquery: worked out once, and the same object for every row.
    scored = docs.withColumn("_w", weights(docs, labels, buckets).scalar())
    scored = scored.withColumn("_m", _measures(F.col("text"), F.col("_w"), buckets)).drop("_w")
    out = scored.withColumns({
        "n_words": F.col("_m.n_words"), "word_chars": F.col("_m.word_chars"), "n_symbols": symbols.cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_m.of.n_repeat_words"), "ratio": F.coalesce(F.round("_m.of.ratio", 9), F.lit(0.0))}).drop("_m")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= threshold))
