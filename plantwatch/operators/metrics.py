"""Evaluation of binary scores as aggregations; nothing is ranked in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plantwatch import constants as K
from plantwatch.functions.expressions import at_least, decision, nan_to_null, ratio
from plantwatch.operators.ordering import range_splits, running_totals
from plantwatch.operators.quantiles import exact_percentiles
from plantwatch.session import pin_small

COUNTS = ["tn", "fp", "fn", "tp"]
THRESHOLDS = [i / 100 for i in range(5, 96)]


def confusion(df: DataFrame, y: str, pred: Column | str, keys: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp in one aggregation, per key if any."""
    p = F.col(pred) if isinstance(pred, str) else pred
    cell = lambda a, b: F.coalesce(F.sum(((F.col(y) == a) & (p == b)).cast("bigint")), F.lit(0))
    return df.groupBy(*(keys or [])).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                                         cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def confusion_table(df: DataFrame, y: str, pred: str) -> DataFrame:
    """2 x 2 table: a row per actual class, a column per predicted class."""
    return df.groupBy(y).pivot(pred, [0, 1]).count().na.fill(0).toDF("actual", "predicted_0", "predicted_1")


def with_rates(counts: DataFrame) -> DataFrame:
    """All decision metrics from tn, fp, fn, tp; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    n = tn + fp + fn + tp
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    # A class without rows takes no part in the balanced accuracy.
    balanced = (F.when(tn + fp == 0, recall).when(tp + fn == 0, specificity)
                .otherwise((recall + specificity) / 2))
    return counts.withColumns({
        "accuracy": ratio(tp + tn, n), "balanced_accuracy": balanced,
        "precision": ratio(tp, tp + fp), "recall": recall, "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "negative_recall": specificity, "predicted_positive_rate": ratio(tp + fp, n)})


def metric_row(df: DataFrame, y: str, score: str, threshold: float = K.ATTACK_THRESHOLD,
               keys: list[str] | None = None) -> DataFrame:
    return with_rates(confusion(df, y, decision(score, threshold), keys))


def ranking(df: DataFrame, y: str, score: str, keys: list[str] | None = None, count: str | None = None) -> DataFrame:
    """ROC-AUC (ties count one half) and step-wise average precision; a row stands for ``count`` equal ones.

    Rows collapse to distinct scores first; running totals over those are cut into
    score ranges. NULL when there is no positive (or, for AUC, no negative) row.
    """
    keys = keys or []
    s = F.coalesce(nan_to_null(F.col(score).cast("double")), F.lit(float("-inf")))
    one = F.col(count).cast("bigint") if count else F.lit(1).cast("bigint")
    cells = df.groupBy(*keys, (-s).alias("_neg")).agg(F.sum(F.col(y).cast("bigint") * one).alias("tp"), F.sum(one).alias("n"))
    run = running_totals(cells, keys, "_neg", {"ctp": "tp", "cn": "n"}, range_splits(df, -s))
    tp, n, ctp, cn = (F.col(c).cast("double") for c in ("tp", "n", "ctp", "cn"))
    p, m = F.sum("tp").cast("double"), F.sum(F.col("n") - F.col("tp")).cast("double")
    return run.groupBy(*keys).agg(
        F.try_divide(F.sum((n - tp) * (ctp - tp / 2)), F.nullif(p * m, F.lit(0.0))).alias("roc_auc"),
        F.try_divide(F.sum(tp * ctp / cn), F.nullif(p, F.lit(0.0))).alias("average_precision"))


def evaluate(df: DataFrame, y: str, score: str, threshold: float = K.ATTACK_THRESHOLD,
             keys: list[str] | None = None) -> DataFrame:
    """Decision and ranking metrics together, one row per key."""
    ks = keys or ["_one"]
    work = df if keys else df.withColumn("_one", F.lit(1))
    out = metric_row(work, y, score, threshold, ks).join(ranking(work, y, score, ks), ks)
    return out if keys else out.drop("_one")


def compare_models(df: DataFrame, y: str, scores: dict[str, str], threshold: float = K.ATTACK_THRESHOLD) -> DataFrame:
    """Metrics of several score columns in one job."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score"))
                      for m, c in scores.items()])
    return evaluate(df.select(y, F.inline(cells)), y, "score", threshold, ["model"])


def threshold_sweep(df: DataFrame, y: str, score: str, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Metrics at every threshold from one histogram of the scores.

    Rows fall into the bucket between two thresholds; suffix sums over the buckets
    give the counts at each threshold, so the rows are read once.
    """
    cuts = sorted(thresholds)
    work = df.select(y, nan_to_null(F.col(score).cast("double")).alias("_s"))
    work = work.withColumn("_s", F.coalesce("_s", F.lit(float("-inf"))))
    bucket = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_s", outputCol="_b").transform(work)
    hist = pin_small(bucket.groupBy(F.col("_b").cast("int").alias("i")).agg(
        F.sum(F.col(y).cast("bigint")).alias("tp"), F.count(F.lit(1)).alias("n")))
    total = hist.agg(F.struct(F.sum("tp").alias("p"), F.sum("n").alias("n"))).scalar()
    grid = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(cuts)], "i int, threshold double")
    up = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    at = grid.join(hist, "i", "left").select(
        "threshold", F.coalesce(F.sum("tp").over(up), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("n").over(up), F.lit(0)).alias("pp"), total.alias("t"))
    counts = at.select("threshold", (F.col("t.n") - F.col("t.p") - (F.col("pp") - F.col("tp"))).alias("tn"),
                       (F.col("pp") - F.col("tp")).alias("fp"), (F.col("t.p") - F.col("tp")).alias("fn"), "tp")
    return with_rates(counts)


def best_f1(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def best_recall(sweep: DataFrame, metric: str, bound: float) -> DataFrame:
    """Highest recall where a metric reaches its bound (ties: f1, then threshold); may be empty."""
    return (sweep.filter(F.col(metric) >= bound)
            .orderBy(F.desc("recall"), F.desc("f1"), "threshold").limit(1))


def choose_thresholds(sweep: DataFrame, min_precision: float = K.MIN_PRECISION, min_f1: float = K.MIN_F1) -> DataFrame:
    picks = {"best_f1": best_f1(sweep),
             "recall_at_precision": best_recall(sweep, "precision", min_precision),
             "recall_at_f1": best_recall(sweep, "f1", min_f1)}
    out = None
    for rule, row in picks.items():
        row = row.select(F.lit(rule).alias("rule"), "threshold", "precision", "recall", "f1")
        out = row if out is None else out.unionByName(row)
    return out


def operating_modes(df: DataFrame, y: str, score: str, modes: dict[str, float]) -> DataFrame:
    """One row per named threshold; all share the ranking metrics of the scores."""
    cells = F.array(*[F.struct(F.lit(m).alias("operating_mode"), F.lit(float(t)).alias("threshold"),
                               decision(score, t).alias("pred")) for m, t in modes.items()])
    counts = confusion(df.select(y, F.inline(cells)), y, "pred", ["operating_mode", "threshold"])
    rank = pin_small(ranking(df, y, score))
    return with_rates(counts).withColumns({
        c: rank.select(c).scalar() for c in ("roc_auc", "average_precision")})


def score_summary(df: DataFrame, y: str, score: str, threshold: float = K.ATTACK_THRESHOLD) -> DataFrame:
    """Median score of the positives and false-positive rate of the negatives."""
    median = exact_percentiles(df.filter(F.col(y) == 1), [score], [0.5]).select("value").scalar()
    fpr = F.avg(F.when(F.col(y) == 0, at_least(score, threshold).cast("int")))
    return df.agg(fpr.alias("fpr_normal")).withColumn("median_attack_score", median)
