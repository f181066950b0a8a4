from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from zonetide.operators.quantiles import _cells, counted_quantiles, exact_quantiles, running_totals


def _values(kind: str):
    rng = np.random.default_rng(5)
    if kind == "smooth":
        return rng.normal(size=5000)
    if kind == "third_is_one_value":
        return np.concatenate([np.full(2000, 3.5), rng.normal(size=4000)])
    if kind == "far_outlier":
        return np.concatenate([rng.uniform(0, 1, 3000), [1e12]])
    return np.full(100, 2.0)


@pytest.mark.parametrize("kind", ["smooth", "third_is_one_value", "far_outlier", "constant"])
@pytest.mark.parametrize("band,sketch", [(0.005, 2048), (0.001, 8), (0.0, 8)])
def test_quantiles_are_exact(spark, kind, band, sketch):
    """Also with a sketch so small that the first bands miss the ranks."""
    v = _values(kind)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = exact_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.9, "d": 0.0, "e": 1.0}, band=band, sketch=sketch).first()
    assert [got[x] for x in "abcde"] == pytest.approx(list(np.quantile(v, [0.1, 0.5, 0.9, 0.0, 1.0])), rel=1e-12)
    counted = counted_quantiles(df, "v", {"a": 0.1}).first()
    assert counted["a"] == pytest.approx(np.quantile(v, 0.1), rel=1e-12)


def test_second_scan_keeps_only_values_near_the_ranks(spark):
    df = spark.range(100_000).select((F.pmod(F.col("id") * 7919, 100_003) / 3.0).alias("v"))
    cells = _cells(df, [0.25, 0.5, 0.75], [], 0.005, 2048)
    assert cells.filter("exact IS NOT NULL").count() < 0.05 * 100_000 and cells.agg(F.sum("n")).first()[0] == 100_000
    assert cells.filter("exact IS NULL").count() == 4


def test_quantiles_without_values_and_with_nan(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert tuple(exact_quantiles(empty, "v", {"a": 0.5}).first()) == (None,)
    some = spark.createDataFrame([("x", None), ("y", float("nan")), ("y", 1.0), ("z", float("nan"))], "g string, v double")
    got = {r["g"]: r["a"] for r in exact_quantiles(some, "v", {"a": 0.0}, ["g"]).collect()}
    assert got["y"] == 1.0 and np.isnan(got["z"]) and "x" not in got


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(x)) for g, n in (("a", 501), ("b", 40), ("c", 1)) for x in rng.exponential(size=n)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "v", {"q": 0.25}, ["g"]).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.quantile([x for k, x in rows if k == g], 0.25), rel=1e-12)


@pytest.mark.parametrize("range_rows", [50, 250_000])
def test_running_totals_match_a_plain_cumulative_sum(spark, range_rows):
    rng = np.random.default_rng(7)
    scores = np.unique(np.concatenate([rng.uniform(0, 1e-6, 300), rng.uniform(0, 1, 300)]))
    rows = [(float(s), int(n)) for s, n in zip(scores, rng.integers(0, 9, len(scores)))]
    df = spark.createDataFrame(rows, "s double, n long")
    got = {r["s"]: r["t"] for r in running_totals(df, "s", {"t": "n"}, range_rows=range_rows).collect()}
    total = 0
    for s, n in sorted(rows, reverse=True):
        total += n
        assert got[s] == total


def test_running_totals_of_a_heavy_tail_with_an_outlier(spark):
    rng = np.random.default_rng(8)
    values = np.unique(np.concatenate([rng.pareto(0.5, 3000), [1e15]]))
    df = spark.createDataFrame([(float(v), 1) for v in values], "s double, n long")
    got = sorted((r["s"], r["t"]) for r in running_totals(df, "s", {"t": "n"}, descending=False, range_rows=200).collect())
    assert [t for _, t in got] == list(range(1, len(values) + 1))


def test_running_totals_of_groups_grow_in_ranges_not_in_size(spark):
    rows = [(g, float(i), 1) for g, n in (("a", 900), ("b", 5), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, s double, n long").repartition(5)
    out = running_totals(df, "s", {"t": "n"}, descending=False, groups=["g"], range_rows=100)
    assert sorted((r["g"] or "", r["s"], r["t"]) for r in out.collect()) == sorted((g or "", s, int(s) + 1) for g, s, _ in rows)
