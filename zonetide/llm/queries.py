"""The queries opN_<name>: each applies one operator to its whole table and returns digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.llm import (
    backoff, decontamination, divergence, interactions, jaccard, language, packing, quality, recompression, secrets, sql, toxicity,
    url_filter, wrappers,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns.split())


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op1_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents", "doc_id text"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "sequence_tokens")


@_query
def op10_likelihood_ratio_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(_table(spark, folder, "documents", "doc_id text"), _table(spark, folder, "labels", "doc_id quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


@_query
def op9_recursive_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(_table(spark, folder, "documents", "doc_id text"))
    base = F.filter("spans", lambda s: s["depth"] == 0)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in secrets.KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


@_query
def op4_prefix_filtered_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.hits(_table(spark, folder, "documents", "doc_id text"), _table(spark, folder, "benchmark", "item_id text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@_query
def op7_metric_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(_table(spark, folder, "documents", "doc_id text"))


@_query
def op6_recompression_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = recompression.remove_repeats(_table(spark, folder, "documents", "doc_id text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op2_katz_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    return backoff.score(_table(spark, folder, "documents", "doc_id text"))


@_query
def op3_counterfactual_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(_table(spark, folder, "documents", "doc_id text"), _table(spark, folder, "labels", "doc_id toxic"))


@_query
def op8_output_code_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents", "doc_id text lang"))


@_query
def op5_union_free_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    texts = wrappers.main_text(_table(spark, folder, "pages", "page_id url html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op11_iceberg_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents", "text lang source"))


@_query
def op12_trie_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(sql.URL_RULES, "verdict string, host string, path string")
    return url_filter.judge(_table(spark, folder, "pages", "page_id url"), rules).select("page_id", "host", "path", "rule", "verdict")


@_query
def op13_diagram_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return interactions.audit(_table(spark, folder, "documents", "doc_id text lang"), _table(spark, folder, "labels", "doc_id quality toxic"))


SQL |= {"op11_iceberg_source_divergence": sql.SOURCE_DIVERGENCE, "op12_trie_url_filter": sql.URL_FILTER,
        "op13_diagram_filter_interactions": sql.FILTER_INTERACTIONS}
