"""Queries against the same question in SQL. ``check_queries.py`` runs all of them; here is a cross-section."""

from __future__ import annotations

import duckdb
import pytest

from check_queries import TABLES, table_of
from zonetide.plans.catalogue import catalogue

NAMES = """zone_hour_rollup zone_hour_mean_bround zone_lags_long_series zone_percentile_flags_long_series feature_table imbalance driver_counts
ranked_current_zones validate_failed profile_nulls describe_column mutual_information zone_hour_as_of_join nearest_centroid_by_grid neighbor_surplus
train_only_baseline persistence_counter_long_series best_action budget_fold_with_cooldown recommendation_cards context_ladder resolve_outcomes psi_features
best_f1_threshold error_by_group run_kpis zone_performance merged_alerts version_lineage promotion_gate stratified_folds nearest_neighbours stream_tumbling""".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, small, con, name):
    q = catalogue()[name]
    df = q.build(spark, small)
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert table_of([tuple(r) for r in df.collect()], df.columns) == table_of(want, names)


def test_every_query_is_built_without_a_session_at_import():
    assert len(catalogue()) > 150 and all(q.covers for q in catalogue().values())


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
