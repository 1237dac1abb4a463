import math

import pytest
from pyspark.sql import functions as F

from plantwatch.functions import expressions as X
from plantwatch.functions.keys import content_key
from plantwatch.operators import errors as E, metrics as M, profile as P


@pytest.mark.parametrize("status,attack,level", [
    ("NORMAL", False, "OK"), ("EARLY WARNING", False, "WARNING"), ("HIGH RISK", False, "ALARM"),
    ("NORMAL", True, "NETWORK ALERT"), ("EARLY WARNING", True, "CRITICAL"), ("HIGH RISK", True, "CRITICAL"),
    ("UNKNOWN", True, "NETWORK ALERT"), (None, None, "OK")])
def test_fusion(spark, status, attack, level):
    row = spark.createDataFrame([(status, attack)], "s string, a boolean").select(
        X.fuse("s", "a").alias("l"), X.severity(X.fuse("s", "a")).alias("v")).first()
    assert row["l"] == level
    assert row["v"] == ["OK", "WARNING", "NETWORK ALERT", "ALARM", "CRITICAL"].index(level)


def test_texts(spark):
    row = spark.range(1).select(
        X.percent_text(F.lit(0.8235)).alias("p"), X.clock_text(F.lit(63)).alias("c"),
        X.strip_prefix(F.lit("num__a__b")).alias("n"),
        X.explain_fusion(F.lit("CRITICAL"), F.lit("HIGH RISK"), F.lit(0.912), F.lit(2), F.lit(3)).alias("w")).first()
    assert row["p"] == "82.4%" and row["c"] == "T+02:06" and row["n"] == "a__b"
    assert row["w"] == ("Machine is high risk (91.2% failure probability) AND 2/3 recent flows were classified as "
                        "attacks: possible cyber-physical incident.")


def test_nan_is_never_positive(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.5,), (0.49,)], "s double")
    assert [r[0] for r in df.select(X.decision("s", 0.5)).collect()] == [0, 0, 1, 0]


def test_unknown_label_stops(spark):
    df = spark.createDataFrame([("Normal",), ("Other",)], "t string")
    with pytest.raises(Exception, match="no code for label"):
        df.select(X.encode_label("t", {"Normal": 0, "Attack": 1})).collect()


def test_wilson(spark):
    lo, hi = X.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(9, 10), (26, 29), (0, 0)], "k long, n long").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert 0.55 < rows[0]["lo"] < 0.9 < rows[0]["hi"] <= 1
    assert rows[1]["lo"] == pytest.approx(0.736146, abs=1e-6)
    assert rows[2]["lo"] is None and rows[2]["hi"] is None


@pytest.mark.parametrize("counts,want", [
    ((1920, 12, 16, 52), {"precision": 0.8125, "recall": 0.7647, "f1": 0.7879}),
    ((1827, 105, 5, 63), {"precision": 0.3750, "recall": 0.9265, "f1": 0.5339}),
    ((2476, 10, 25, 22087), {"precision": 0.999547, "recall": 0.998869, "f1": 0.999208}),
    ((5, 0, 0, 0), {"precision": 0.0, "recall": 0.0, "f1": 0.0, "accuracy": 1.0})])
def test_published_rates(spark, counts, want):
    row = M.with_rates(spark.createDataFrame([counts], "tn long, fp long, fn long, tp long")).first()
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=6e-5)


def test_ranking_edges(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.1), (0, 0.0)], "y int, s double")
    row = M.ranking(df, "y", "s").first()
    assert row["roc_auc"] == pytest.approx(0.625)
    assert row["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    one = M.ranking(df.filter("y = 1"), "y", "s").first()
    assert one["roc_auc"] is None and one["average_precision"] == 1.0


def test_thresholds_may_be_unreachable(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.1)], "y int, s double")
    sweep = M.threshold_sweep(df, "y", "s")
    assert sweep.count() == 91
    assert M.best_recall(sweep, "precision", 0.3).count() == 0
    assert M.choose_thresholds(sweep).count() == 1


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (2.0, 5.0, 1), (float("nan"), 5.0, 1)], "a double, b double, y int")
    assert [r["feature"] for r in P.target_correlations(df, ["a", "b"], "y").collect()] == ["a"]
    m = {(r["a"], r["b"]): r["r"] for r in P.correlation_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "a")] == pytest.approx(1.0) and m[("a", "b")] is None and m[("b", "a")] is None


def test_profile_flags_and_missing(spark):
    df = spark.createDataFrame([(1, 7.0, float(i)) if i else (1, None, float("nan")) for i in range(400)],
                               "k int, n double, u double")
    rows = {r["feature"]: r for r in P.numeric_profile(df, ["k", "n", "u"]).collect()}
    assert rows["k"]["is_constant"] and not rows["n"]["is_constant"] and rows["n"]["is_near_constant"]
    assert rows["u"]["missing_count"] == 1 and rows["u"]["n_unique"] == 400 and rows["u"]["is_id_like"]
    assert [r["feature"] for r in P.near_constant(P.numeric_profile(df, ["k", "n"])).collect()] == ["n"]


def test_content_key_normalises(spark):
    df = spark.createDataFrame([(0.0, "a|"), (-0.0, "a|"), (float("nan"), "x"), (None, "x"), (None, None), (1.0, "|0")],
                               "d double, s string")
    k = [r[0] for r in df.select(content_key(df, ["d", "s"])).collect()]
    assert k[0] == k[1] and k[2] == k[3] and len(set(k)) == 4


def test_mode_recall_fixture(spark):
    modes = spark.createDataFrame([(i, int(i < 4), int(i >= 4)) for i in range(6)], "row_id long, HDF int, PWF int")
    preds = spark.createDataFrame([(i, int(i >= 4), int(i >= 4 or i == 2)) for i in range(6)], "row_id long, p int, e int")
    out = {(r["mode"], r["operating_mode"]): r for r in E.mode_recall(
        preds, modes, "row_id", {"HDF": "heat", "PWF": "power"}, {"primary": "p", "early": "e"}).collect()}
    assert out[("HDF", "primary")]["recall"] == 0.0 and 0 <= out[("HDF", "primary")]["ci_high"] < 0.6
    assert out[("HDF", "early")]["detected"] == 1 and out[("PWF", "primary")]["recall"] == 1.0
    assert not math.isnan(out[("PWF", "primary")]["ci_low"])


def test_unmatched_prediction_stops(spark):
    preds = spark.createDataFrame([(1, 1), (2, 0)], "row_id long, predicted int")
    labels = spark.createDataFrame([(1, "A")], "row_id long, cls string")
    with pytest.raises(Exception, match="no row in the evaluated split"):
        E.class_breakdown(preds, labels, "row_id", "predicted", "cls", ["A"]).collect()
