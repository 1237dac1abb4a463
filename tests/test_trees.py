"""The tree learner against direct sums, and its two ways of running against each other."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plantwatch.operators import trees as R, training as T

NAMES = ["a", "b", "c", "d"]


def table(n=600, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(n, 4)), columns=NAMES)
    pdf["d"] = rng.integers(0, 3, n)
    pdf["y"] = (pdf["a"] + pdf["b"] * pdf["c"] + 0.3 * rng.normal(size=n) > 0.4).astype(int)
    pdf["k"] = range(n)
    return pdf


@pytest.fixture(scope="module")
def data(spark):
    df = spark.createDataFrame(table()).repartition(3, "k")
    return VectorAssembler(inputCols=NAMES, outputCol="x").transform(df).cache()


def rows_of(pdf, bins=16):
    x = pdf[NAMES].to_numpy(float)
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower")) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(x.shape[1])]).astype(np.uint8)
    y = pdf["y"].to_numpy(np.uint8)
    return R.Rows(codes, y, np.full(len(y), 255, np.uint8), R._row_keys(1, len(y))), cuts, x


def test_first_split_has_the_largest_gain():
    rows, _, _ = rows_of(table())
    for lam, alpha, child in ((1.0, 0.0, 1.0), (10.0, 2.0, 4.0), (0.0, 5.0, 30.0)):
        spec = R.Spec(n_estimators=1, max_depth=1, colsample_bytree=1.0, gamma=0.0, reg_lambda=lam, reg_alpha=alpha, min_child_weight=child,
                      learning_rate=1.0)
        tree, margin = R.fit_here(rows, spec, 16)
        g, h = 0.5 - rows.y, np.full(len(rows.y), 0.25)
        cut = lambda s: np.sign(s) * max(abs(s) - alpha, 0)
        worth = lambda m: cut(g[m].sum()) ** 2 / (h[m].sum() + lam)
        options = {}
        for f in range(4):
            for b in range(15):
                left = rows.bins[f] <= b
                if min(h[left].sum(), h[~left].sum()) >= child:
                    options[f, b] = worth(left) + worth(~left)
        f, b = tree[0].feature[0], tree[0].bin[0]
        assert options[f, b] == pytest.approx(max(options.values()))
        left = rows.bins[f] <= b
        assert np.allclose(margin[left], -cut(g[left].sum()) / (h[left].sum() + lam))
        assert np.allclose(margin[~left], -cut(g[~left].sum()) / (h[~left].sum() + lam))


def test_siblings_by_subtraction_equal_direct_counts(monkeypatch):
    rows, _, _ = rows_of(table())
    spec = R.Spec(n_estimators=8, max_depth=6, gamma=0.0, min_child_weight=1)
    _, margin = R.fit_here(rows, spec, 16)
    monkeypatch.setattr(R, "MAX_CELLS", 70)
    _, direct = R.fit_here(rows, spec, 16)
    assert np.allclose(margin, direct)


def test_penalties_change_the_fit():
    rows, _, _ = rows_of(table())
    fits = [R.fit_here(rows, R.Spec(n_estimators=20, max_depth=4, gamma=g, reg_lambda=lam, reg_alpha=a), 16)[1]
            for g, lam, a in ((0.0, 1.0, 0.0), (0.0, 10.0, 0.0), (0.0, 1.0, 5.0), (5.0, 1.0, 0.0))]
    assert np.abs(fits[0]).mean() > np.abs(fits[1]).mean() and np.abs(fits[0]).mean() > np.abs(fits[2]).mean()
    assert not np.allclose(fits[0], fits[3])


def test_rows_outside_the_fit_are_scored_not_learnt():
    rows, _, _ = rows_of(table())
    rows.fold[:] = np.arange(len(rows.y)) % 4
    other = R.Rows(rows.bins, np.where(rows.fold == 2, 1 - rows.y, rows.y).astype(np.uint8), rows.fold, rows.keys)
    spec = R.Spec(n_estimators=10, max_depth=3, fold=2, subsample=0.7)
    a, b = R.fit_here(rows, spec, 16)[1], R.fit_here(other, spec, 16)[1]
    assert np.allclose(a, b)
    seen = rows.fold == 2
    assert ((a[seen] > 0) == rows.y[seen]).mean() > 0.8


def test_scores_follow_the_nodes_and_survive_a_frame():
    rows, cuts, x = rows_of(table())
    spec = R.Spec(n_estimators=12, max_depth=5)
    trees, margin = R.fit_here(rows, spec, 16)
    model = R.TreeModel.from_frame("boosted", R.finish("boosted", trees, cuts))
    assert np.allclose(model.raw(x), margin)
    again = R.TreeModel.from_frame("boosted", model.frame().sample(frac=1, random_state=1))
    assert np.allclose(again.raw(x), margin) and again.depth == model.depth <= 5
    root = model.frame().query("id == 0")
    assert np.allclose(root["cover"].iloc[0], len(x) / 4)


def test_forest_trees_balance_their_own_bootstrap_and_grow_deep():
    pdf = table(900)
    rows, cuts, x = rows_of(pdf)
    spec = R.Spec(kind="forest", n_estimators=30, max_depth=None, min_leaf=1)
    weights = [R.row_weights(spec, t, rows.keys, rows.y, rows.fold) for t in range(3)]
    for w in weights:
        assert w[rows.y == 1].sum() == pytest.approx(w[rows.y == 0].sum())
        assert 0.3 < (w == 0).mean() < 0.44
    assert len({round(float(w[rows.y == 1].max()), 9) for w in weights}) == 3
    trees, _ = R.fit_here(rows, spec, 16)
    model = R.TreeModel.from_frame("forest", R.finish("forest", trees, cuts, 1 / 30))
    assert model.depth > 8
    assert ((model.probability(x) > 0.5) == rows.y).mean() > 0.97
    w = R.row_weights(spec, 0, rows.keys, rows.y, rows.fold)
    first = R.TreeModel.from_frame("forest", R.finish("forest", trees[:1], cuts))
    used = w > 0
    same = pd.DataFrame(rows.bins.T[used]).groupby([0, 1, 2, 3])[0].transform("size").to_numpy() == 1
    assert ((first.raw(x)[used] > 0.5) == rows.y[used])[same].all()


@pytest.mark.parametrize("options", [dict(), dict(subsample=0.7, colsample_bytree=0.5, reg_alpha=0.1)])
def test_levels_over_many_tasks_give_the_same_models(spark, data, options, tiny_tasks):
    specs = [R.Spec(n_estimators=3, max_depth=3, **options), R.Spec(n_estimators=2, max_depth=4, seed=7, **options)]
    blocks, cuts, small = R._one_table(data, "x", 4, "y", None)
    assert not small
    trees, _ = R._fit_by_levels(blocks, specs, cuts)
    nodes = R._fit_in_tasks(blocks, specs, cuts, scores=False).toPandas()
    x = table()[NAMES].to_numpy(float)
    for m, s in enumerate(specs):
        a = R.TreeModel.from_frame("boosted", R.finish("boosted", trees[m], cuts))
        b = R.TreeModel.from_frame("boosted", nodes[nodes.model == m].drop(columns="model"))
        assert len(a.roots) == len(b.roots) == s.n_estimators and np.allclose(a.raw(x), b.raw(x))


def test_search_on_one_table(spark, data, monkeypatch):
    space = {"n_estimators": [5, 8], "max_depth": [2, 3], "learning_rate": [0.1, 0.3]}
    history, best, model = T.random_search(data, "y", "k", NAMES, space=space, n_iter=4, folds=3)
    rows = history.collect()
    assert [r["rank_test_score"] for r in rows] == sorted(r["rank_test_score"] for r in rows) and len(rows) == 4
    assert all(0.5 < r["mean_test_score"] <= r["mean_train_score"] <= 1 for r in rows)
    assert set(best) == set(space) and len(model.model.roots) == best["n_estimators"]


def test_search_beyond_one_task_scores_alike(spark, data, monkeypatch):
    from plantwatch.session import ROWS_PER_TASK_KEY
    space = {"n_estimators": [3], "max_depth": [2, 3], "learning_rate": [0.3]}
    small = T.random_search(data, "y", "k", NAMES, space=space, n_iter=2, folds=2, refit=False)[0].collect()
    spark.conf.set(ROWS_PER_TASK_KEY, "100")
    big = T.random_search(data, "y", "k", NAMES, space=space, n_iter=2, folds=2, refit=False)[0].collect()
    spark.conf.unset(ROWS_PER_TASK_KEY)
    for a, b in zip(small, big):
        assert a["candidate"] == b["candidate"] and a["mean_test_score"] == pytest.approx(b["mean_test_score"], abs=0.02)


def test_odd_features(spark):
    rows = [(float(i % 7), None, None if i % 5 == 0 else float("nan") if i % 5 == 1 else 1.0, i % 2 if i else None, i) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, k int")
    det = T.fit_boosted(df, "y", ["a", "b", "c"], n_estimators=4, max_depth=3)
    out = det.score(df).agg(F.count("probability"), F.min("probability"), F.max("probability")).first()
    assert out[0] == 60 and 0 < out[1] <= out[2] < 1
    with pytest.raises(ValueError):
        T.fit_boosted(df.filter("y = 0"), "y", ["a"])


def coarse(spark, copies=5):
    """Few different rows, each many times."""
    pdf = table(300)
    pdf[["a", "b", "c"]] = pdf[["a", "b", "c"]].round(0)
    pdf = pd.concat([pdf.assign(k=pdf["k"] + 300 * i) for i in range(copies)], ignore_index=True)
    return pdf, VectorAssembler(inputCols=NAMES, outputCol="x").transform(spark.createDataFrame(pdf).repartition(3, "k"))


def test_equal_rows_are_one_entry_and_fit_alike(spark):
    pdf, df = coarse(spark)
    blocks, cuts, _ = R._one_table(df, "x", 4, "y", None)
    rows = R.Rows.of(blocks.toPandas())
    codes = R._codes(pdf[NAMES].to_numpy(float), cuts)
    assert len(rows.y) == len(np.unique(np.column_stack([codes, pdf["y"]]), axis=0)) < 250 and rows.count.sum() == len(pdf)
    plain = R.Rows(np.ascontiguousarray(codes.T), pdf["y"].to_numpy(np.uint8), np.full(len(pdf), 255, np.uint8), R._row_keys(1, len(pdf)))
    spec = R.Spec(n_estimators=6, max_depth=4, pos_weight=1.7)
    bins = max(len(c) for c in cuts) + 1
    a, b = (R.TreeModel.from_frame("boosted", R.finish("boosted", R.fit_here(r, spec, bins)[0], cuts)) for r in (rows, plain))
    assert np.allclose(a.raw(pdf[NAMES].to_numpy(float)), b.raw(pdf[NAMES].to_numpy(float)))


def test_samples_of_entries_are_samples_of_their_rows(spark):
    _, df = coarse(spark, 40)
    rows = R.Rows.of(R._one_table(df, "x", 4, "y", None)[0].toPandas())
    n = rows.count.sum()
    w, seen = rows.weights(R.Spec(kind="forest"), 3)
    assert np.array_equal(w, rows.weights(R.Spec(kind="forest"), 3)[0]) and not np.array_equal(w, rows.weights(R.Spec(kind="forest"), 4)[0])
    assert (seen <= rows.count).all() and abs(seen.sum() / n - (1 - np.exp(-1))) < 0.02
    assert w[rows.y == 1].sum() == pytest.approx(w[rows.y == 0].sum())
    part = rows.weights(R.Spec(subsample=0.7), 0)[0]
    assert (part <= rows.count).all() and abs(part.sum() / n - 0.7) < 0.02


def test_levels_over_many_tasks_take_entries_too(spark, tiny_tasks):
    pdf, df = coarse(spark)
    spec = R.Spec(n_estimators=3, max_depth=3, subsample=0.7)
    blocks, cuts, small = R._one_table(df, "x", 4, "y", None)
    assert not small
    trees, _ = R._fit_by_levels(blocks, [spec], cuts)
    nodes = R._fit_in_tasks(blocks, [spec], cuts, scores=False).toPandas()
    x = pdf[NAMES].to_numpy(float)
    b = R.TreeModel.from_frame("boosted", nodes.drop(columns="model"))
    assert np.allclose(R.TreeModel.from_frame("boosted", R.finish("boosted", trees[0], cuts)).raw(x), b.raw(x))


def test_forest_nodes_weigh_only_the_bins_they_hold(monkeypatch):
    """Every cut is the best of a direct count, and a full-depth tree does not weigh 64 bins for each of its small nodes."""
    rng = np.random.default_rng(1)
    n = 12_000
    rows = R.Rows(rng.integers(0, 64, (4, n)).astype(np.uint8), rng.integers(0, 2, n).astype(np.uint8), np.full(n, 255, np.uint8), R._row_keys(1, n))
    node, use, weights = rng.integers(0, 300, n), rng.integers(1, 4, n).astype(float), np.array([1.0, 2.0])
    sums = [use * (1 - rows.y), use * rows.y, np.ones(n)]
    got = R._present_splits(rows, R.Spec(kind="forest", min_leaf=2), np.arange(4), np.arange(n), node, np.tile(np.arange(4), (300, 1)), 64, sums, weights)
    w = use * weights[rows.y]
    want = R.best_splits(R._histogram(rows, np.arange(4), np.arange(n), node, 300, 64, [-w * rows.y, w, np.ones(n)]), R.Spec(kind="forest", min_leaf=2))
    assert all(np.allclose(got[c], want[c]) for c in ("split", "col", "bin", "g", "h"))
    weighed, dense = [], R.best_splits
    monkeypatch.setattr(R, "best_splits", lambda hist, spec: weighed.append(hist.size) or dense(hist, spec))
    trees, _ = R.fit_here(rows, R.Spec(kind="forest", n_estimators=1, max_depth=None), 64)
    assert len(trees[0].feature) > 5_000 and sum(weighed) < 20 * n


def test_a_task_of_a_search_holds_one_model_and_its_different_scores(spark, data):
    n = 4 * spark.sparkContext.defaultParallelism + 3
    specs = [R.Spec(n_estimators=1, max_depth=2, seed=i, fold=0) for i in range(n)]
    cuts = R.quantile_cuts(data, "x", 4)
    blocks = R.binned(data.withColumn("f", F.col("k") % 3), "x", 4, "y", cuts, "f")
    got = R._fit_in_tasks(blocks, specs, cuts, scores=True).withColumn("task", F.spark_partition_id()).toPandas()
    assert (got.groupby("task")["model"].nunique() == 1).all() and sorted(set(got["model"])) == list(range(n))
    assert not got.duplicated(["model", "y", "outside", "score"]).any()
    sums = got.groupby(["model", "y", "outside"])["n"].sum().unstack("model")
    want = table().assign(outside=lambda p: p["k"] % 3 == 0).groupby(["y", "outside"]).size()
    assert (sums.T == want).all().all()


@pytest.mark.parametrize("options", [dict(), dict(depth=3, min_leaf=5)])
def test_forests_beyond_one_task_are_the_same_forests(spark, data, monkeypatch, options):
    """The number of rows decides how a forest is grown, not what it becomes: same depth, same splits, same scores."""
    from plantwatch.session import ROWS_PER_TASK_KEY
    fit = lambda: T.fit_forests(data, "y", NAMES, [42, 7], trees=4, **options)
    small = fit()
    spark.conf.set(ROWS_PER_TASK_KEY, "100")
    monkeypatch.setattr(R, "SIDE_BY_SIDE", 3 * 600)
    monkeypatch.setattr(R, "PRESENT_CELLS", 1 << 11)
    try:
        big = fit()
    finally:
        spark.conf.unset(ROWS_PER_TASK_KEY)
    for a, b in zip(small, big):
        assert a.model.depth == b.model.depth and (a.model.depth > 8 or options)
        pd.testing.assert_frame_equal(a.model.frame(), b.model.frame())
    assert not np.array_equal(small[0].model.value, small[1].model.value)


def test_files_hold_few_trees(spark, data, monkeypatch):
    """A task reads a file of big rows at once, so it holds a few trees only."""
    monkeypatch.setattr(R, "MAX_LOCAL_NODES", 10)
    model = T.fit_forest(data, "y", NAMES, trees=20).model
    sizes = [r["count"] for r in model.rows.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 20 and max(sizes) <= 2


def test_entries_that_differ_in_their_fold_only_are_counted_as_one(monkeypatch):
    """The same trees and margins, from fewer entries and fewer counts."""
    rng = np.random.default_rng(5)
    n = 800
    bins = np.repeat(np.stack([rng.integers(0, w, n) for w in (16, 3, 4, 2)]).astype(np.uint8), 3, axis=1)
    y = np.repeat((bins[0, ::3] + 3 * bins[1, ::3] + rng.integers(0, 9, n) > 14).astype(np.uint8), 3)
    rows = R.Rows(bins, y, np.tile(np.arange(3), n).astype(np.uint8), R._row_keys(1, 3 * n), rng.integers(1, 4, 3 * n))
    spec = R.Spec(n_estimators=6, max_depth=4, fold=1, subsample=0.8, gamma=0.0)
    seen, counted = [], R._histogram
    monkeypatch.setattr(R, "_histogram", lambda rows, *a: seen.append((len(rows.y), rows.joint is not None)) or counted(rows, *a))
    monkeypatch.setattr(R, "JOINT_ROWS", 10)
    trees, margin = R.fit_here(rows, spec, 16)
    assert max(m for m, _ in seen) <= n and all(j for _, j in seen)
    monkeypatch.setattr(R, "_without_folds", lambda rows: (rows, np.arange(len(rows.y))))
    plain, want = R.fit_here(rows, spec, 16)
    assert np.allclose(margin, want) and all(np.array_equal(a.feature, b.feature) for a, b in zip(trees, plain))
