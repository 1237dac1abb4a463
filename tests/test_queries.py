"""Every query with a SQL twin gives the same rows, with and without big groups."""

import pytest

from compare import difference, duck
from plantwatch.plans.catalog import CHECKS, QUERIES

SPLIT_PATHS = [
    "alert_timeline", "alert_events", "reaction_times", "incident_window_join", "machine_history", "labelled_replay",
    "debounce", "flagged_subset", "semi_join_leakage", "duplicate_members", "drop_conflicting_groups", "duplicate_groups",
    "exact_stratified_split", "stratified_kfold", "describe_features", "stats_by_class", "roc_auc", "average_precision",
    "sequential_row_id", "positional_alignment", "unseen_family_eval", "stream_debounce", "stream_events",
]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_equals_sql(name, spark, sf, con):
    assert difference(QUERIES[name](spark, sf).toPandas(), con.execute(CHECKS[name]).df()) is None


@pytest.mark.parametrize("name", SPLIT_PATHS)
def test_split_groups_give_the_same_rows(name, spark, sf, con, tiny_tasks):
    assert difference(QUERIES[name](spark, sf).toPandas(), con.execute(CHECKS[name]).df()) is None


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
