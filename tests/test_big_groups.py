"""Both sides of every size switch give the same rows."""

import math

import pytest

from plantwatch.operators import duplicates, incidents, metrics, ordering, preparation, profile, quantiles, splits, timeline as tl
from plantwatch.session import ROWS_PER_TASK_KEY


def both_sides(spark, make):
    """Sorted rows of a frame, made with tasks of all rows and of 25 rows."""
    out = []
    for limit in (None, "25"):
        if limit:
            spark.conf.set(ROWS_PER_TASK_KEY, limit)
        try:
            out.append(sorted(map(str, make().collect())))
        finally:
            spark.conf.unset(ROWS_PER_TASK_KEY)
    return out


def test_percentiles_keep_features_without_values_and_missing_keys(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else "k", float(i), None) for i in range(200)], "g string, x double, empty double")
    a, b = both_sides(spark, lambda: quantiles.exact_percentiles(df, ["x", "empty"], [0.25, 0.5], ["g"]))
    assert a == b and len(a) == 8
    a, b = both_sides(spark, lambda: profile.describe_features(df, ["x", "empty"]))
    assert a == b and len(a) == 2


def test_ranking_with_missing_scores(spark):
    rows = [(i % 3 == 0, None if i % 5 == 0 else math.nan if i % 7 == 0 else i / 200) for i in range(200)]
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "y int, s double")
    a, b = both_sides(spark, lambda: metrics.ranking(df, "y", "s").selectExpr("round(roc_auc, 9)", "round(average_precision, 9)"))
    assert a == b and "None" not in a[0]


def test_text_order_keys(spark):
    df = spark.createDataFrame([(f"flow-{i * 37 % 300:05d}",) for i in range(300)], "id string")
    a, b = both_sides(spark, lambda: incidents.spread_subset(df, "id", 24))
    assert a == b and len(a) == 24
    a, b = both_sides(spark, lambda: ordering.ordered_index(df, [], ["id"], "at", by=df["id"]))
    assert a == b and len(a) == 300


def test_gapped_ticks_and_unmatched_rows(spark):
    tel = spark.createDataFrame([(m, t * 10, (t * 7 % 13) / 13) for m in range(2) for t in range(90)], "machine long, tick long, p double")
    flows = spark.createDataFrame([(m, t * 4, t % 3 != 0, 0.9, "c", True) for m in range(1, 3) for t in range(100)],
                                  "machine long, tick long, flagged boolean, attack_p double, true_class string, true_attack boolean")
    a, b = both_sides(spark, lambda: tl.build_timeline(tel, flows))
    assert a == b
    line = tl.build_timeline(tel, flows)
    assert line.filter("p is not null").count() == 180 and line.filter("flagged is not null").count() == 200
    assert line.filter("p is null and status <> 'NORMAL'").count() == 0
    assert line.filter("machine = 0 and (confirmed or n_seen > 0)").count() == 0
    a, b = both_sides(spark, lambda: tl.level_events(tl.build_timeline(tel, flows)))
    assert a == b and a


def test_missing_labels(spark):
    df = spark.createDataFrame([(i, f"g{i // 2}", None if i % 4 == 1 else "A" if i % 3 else "B") for i in range(120)], "id long, g string, y string")
    for make in (lambda: splits.exact_stratified_split(df, "y", "id"), lambda: preparation.with_class_weight(df, "y")):
        a, b = both_sides(spark, make)
        assert a == b and len(a) == 120
    report = duplicates.conflict_report(spark.createDataFrame([("a", "A"), ("a", None), ("b", "A"), ("b", "B"), ("b", None)], "g string, y string"), "g", "y")
    assert [(r.g, r.n_labels, r.rows, r.labels) for r in report.collect()] == [("b", 2, 3, "A, B")]


def test_reaction_times_both_sides(spark):
    line = spark.createDataFrame([(0, t, "HIGH RISK" if t % 17 == 5 else "NORMAL", t % 31 == 7) for t in range(200)],
                                 "machine long, tick long, status string, confirmed boolean")
    inc = spark.createDataFrame([(i, 0, i * 13) for i in range(15)], "incident long, machine long, start long")
    a, b = both_sides(spark, lambda: tl.reaction_times(line, inc))
    assert a == b and len(a) == 15
    for r in tl.reaction_times(line, inc).collect():
        first = next((t for t in range(r.start, 200) if t % 17 == 5), None)
        assert r.first_reaction_tick == first


def test_correlations_of_complete_pairs(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5)) + 1e6
    x[:, 1] += 2 * x[:, 0]
    x[:, 2] = 7.1
    x[rng.random(500) < .3, 3] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double, e double")
    got = {(r.a, r.b): r.r for r in profile.correlation_matrix(df, list("abcde")).collect()}
    assert len(got) == 25
    for i, p in enumerate("abcde"):
        for j, q in enumerate("abcde"):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = None if "c" in (p, q) else np.corrcoef(x[ok, i], x[ok, j])[0, 1]
            assert got[p, q] == (None if want is None else pytest.approx(want, abs=1e-7))


def test_small_tables_are_broadcast(spark):
    df = spark.range(2000).selectExpr("id", "cast(id % 2 as int) as y", "cast(id as double) as x")
    plan = preparation.with_class_weight(df, "y")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_timeline_without_big_machines_is_counted_before_the_join(spark, monkeypatch):
    """Of a table of many small machines only the keys are counted; the joined series is numbered by nobody."""
    tel = spark.range(400).selectExpr("id % 20 as machine", "id div 20 as tick", "0.9D as p")
    flows = tel.selectExpr("machine", "tick", "true as flagged", "0.9D as attack_p", "'c' as true_class", "true as true_attack")
    spark.conf.set(ROWS_PER_TASK_KEY, "100")
    try:
        counted = []
        real = ordering.big_keys
        monkeypatch.setattr(ordering, "big_keys", lambda parts, keys, limit: counted.append([p.columns for p in parts]) or real(parts, keys, limit))
        plan = tl.build_timeline(tel, flows)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(ROWS_PER_TASK_KEY)
    assert counted == [[["machine"], ["machine"]]] and " _at#" not in plan and "explode" not in plan
