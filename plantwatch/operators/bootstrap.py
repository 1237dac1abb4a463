"""Bootstrap intervals from sufficient statistics; rows are never resampled one by one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plantwatch import constants as K
from plantwatch.functions.expressions import decision, nan_to_null
from plantwatch.functions.keys import poisson_weight
from plantwatch.operators.metrics import confusion, ranking, with_rates
from plantwatch.operators.ordering import ordered_index
from plantwatch.session import materialise, pin_small, ship_package

METRICS = ["precision", "recall", "f1"]
CELLS_PER_TASK = 2_000
REPLICATES_PER_TASK = 500
MOST_CHUNKS = 1 << 16
MOST_TASKS = 4_096


def _modes_long(df: DataFrame, keep: list[str], score: str, modes: dict[str, float]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("mode"), decision(score, t).alias("pred")) for m, t in modes.items()])
    return df.select(*keep, F.inline(cells))


def _intervals(replicates: DataFrame, points: DataFrame, metrics: list[str]) -> DataFrame:
    """Long table mode, metric, point, ci_low, ci_high from replicate and point tables."""
    ends = F.array(F.lit(0.025), F.lit(0.975))
    low_high = replicates.groupBy("mode").agg(*[F.percentile(m, ends).alias(m) for m in metrics])
    ci = low_high.select("mode", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m)[0].alias("ci_low"), F.col(m)[1].alias("ci_high"))
        for m in metrics])))
    pt = points.select("mode", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("point")) for m in metrics])))
    return pt.join(ci, ["mode", "metric"], "left").select("mode", "metric", "point", "ci_low", "ci_high")


def hash_bootstrap(df: DataFrame, key: str, y: str, score: str, modes: dict[str, float],
                   replicates: int = 20) -> DataFrame:
    """Intervals whose resampling weight is a hash of (row, replicate): repeatable anywhere.

    Every row meets every replicate, but the sums per replicate combine on the map
    side, so only replicates x modes rows are shuffled per task.
    """
    cell = F.col(y) * 2 + F.col("pred")
    # Weight first, once per row and replicate; the modes share it.
    base = (df.select(key, y, score)
            .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
            .withColumn("w", poisson_weight(key, F.col("rep")).cast("bigint")))
    sums = _modes_long(base.filter(F.col("w") > 0), ["rep", "w", y], score, modes).groupBy("mode", "rep").agg(*[
        F.coalesce(F.sum(F.when(cell == i, F.col("w"))), F.lit(0)).alias(c)
        for i, c in enumerate(["tn", "fp", "fn", "tp"])])
    reps = with_rates(sums.filter(F.col("fn") + F.col("tp") > 0))
    points = with_rates(confusion(_modes_long(df, [y], score, modes), y, "pred", ["mode"]))
    return _intervals(reps, points, METRICS)


def count_bootstrap(df: DataFrame, y: str, score: str, modes: dict[str, float],
                    replicates: int = K.BOOTSTRAP_RESAMPLES, seed: int = K.SEED) -> DataFrame:
    """Intervals of decision metrics from multinomial draws of the four counts.

    Resampling rows with replacement only changes the counts, and those follow a
    multinomial law; so the rows are read once and the replicates are independent
    of the size of the table.
    """
    counts = pin_small(confusion(_modes_long(df, [y], score, modes), y, "pred", ["mode"]))
    cells = {r["mode"]: [r["tn"], r["fp"], r["fn"], r["tp"]] for r in counts.collect()}

    def draw(batches):
        for pdf in batches:
            for mode, c in cells.items():
                n = sum(c)
                out = np.array([np.random.default_rng([seed, int(r)]).multinomial(n, np.array(c) / n)
                                for r in pdf["id"]]).reshape(-1, 4)
                yield pd.DataFrame(out, columns=["tn", "fp", "fn", "tp"]).assign(mode=mode)

    spark = df.sparkSession
    reps = spark.range(replicates).mapInPandas(draw, "tn bigint, fp bigint, fn bigint, tp bigint, mode string")
    return _intervals(with_rates(reps.filter(F.col("fn") + F.col("tp") > 0)), with_rates(counts), METRICS)


def _descend(seed: list[int], ends: np.ndarray, chunk: int, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``drawn`` rows (one number a replicate): how many fall before the chunk, and how many into it.

    ``ends`` are running sums of the rows of all chunks. A range of chunks is halved, and its
    rows are split by a binomial draw seeded by the range, until the chunk is left; so every
    chunk finds the same split without hearing of the others.
    """
    before, lo, hi = np.zeros_like(drawn), 0, len(ends) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        whole = ends[hi] - ends[lo]
        share = (ends[mid] - ends[lo]) / whole if whole else 0.0
        left = np.random.default_rng([*seed, lo, hi]).binomial(drawn, share)
        if chunk < mid:
            drawn, hi = left, mid
        else:
            before, drawn, lo = before + left, drawn - left, mid
    return before, drawn


def _pieces(seed: list[int], counts: np.ndarray, drawn: np.ndarray, size: int):
    """Copies (replicates x cells) of each run of ``size`` cells of one chunk that receives ``drawn`` rows."""
    rest = int(counts.sum())
    for start in range(0, len(counts), size):
        part = counts[start:start + size]
        rows = int(part.sum())
        rng = np.random.default_rng([*seed, start])
        # The last rows of a chunk all go to its last piece that has any.
        here = drawn if rows == rest else rng.binomial(drawn, rows / rest)
        yield rng.multinomial(here, part / rows) if rows else np.zeros((len(drawn), len(part)), np.int64)
        drawn, rest = drawn - (here if rows else 0), rest - rows


def ranking_replicates(df: DataFrame, y: str, score: str, replicates: int = K.BOOTSTRAP_RESAMPLES,
                       seed: int = K.SEED) -> DataFrame:
    """rep, positives, negatives, roc_auc and average_precision of resamples of exactly as many rows.

    Drawing rows with replacement gives each distinct score a multinomial number of
    positives and negatives. Scores are numbered and cut into chunks, and the multinomial
    law is drawn along a binary tree of chunks (``_descend``), so a chunk needs only the
    table of chunk totals (at most MOST_CHUNKS + 1 rows) to know its copies and what ranks
    before it: one pass, and no score meets a replicate outside its task. A resample
    without one of the classes has no metrics.
    """
    s = F.coalesce(nan_to_null(F.col(score).cast("double")), F.lit(float("-inf")))
    target = F.col(y).cast("bigint")
    cells = df.filter(F.col(y).isNotNull()).groupBy((-s).alias("_neg")).agg(
        F.sum(target).alias("pos"), F.sum(1 - target).alias("neg"))
    numbered = materialise(ordered_index(cells, [], ["_neg"], "_i", by=F.col("_neg")).select("_i", "pos", "neg"), "score-cells")
    per_task = CELLS_PER_TASK
    size = max(per_task, -(-numbered.count() // MOST_CHUNKS))
    chunk = F.floor(F.col("_i") / size).cast("int")
    totals = numbered.groupBy(chunk.alias("chunk")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).orderBy("chunk").toPandas()
    ends = [np.concatenate([[0], np.cumsum(totals[c].to_numpy(np.int64))]) for c in ("pos", "neg")]
    n_pos, n_neg = (int(e[-1]) for e in ends)
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ends)

    def parts(key, pdf):
        at, pdf = int(key[0]), pdf.sort_values("_i")
        counts = [pdf[c].to_numpy(np.int64) for c in ("pos", "neg")]
        for block, first in enumerate(range(0, replicates, REPLICATES_PER_TASK)):
            many = min(REPLICATES_PER_TASK, replicates - first)
            positives = np.random.default_rng([seed, 2, block]).binomial(np.full(many, n_pos + n_neg), n_pos / (n_pos + n_neg))
            drawn = [positives, n_pos + n_neg - positives]
            found = [_descend([seed, k, block], shared.value[k], at, drawn[k]) for k in (0, 1)]
            tp, fp = (f[0].astype(float)[:, None] for f in found)
            out = np.zeros((4, many))
            for pos, neg in zip(*[_pieces([seed, 3 + k, block, at], counts[k], found[k][1], per_task) for k in (0, 1)]):
                tps, fps = tp + np.cumsum(pos, 1), fp + np.cumsum(neg, 1)
                out += [pos.sum(1), neg.sum(1), (neg * (tps - pos / 2)).sum(1), (pos * tps / np.maximum(tps + fps, 1)).sum(1)]
                tp, fp = tps[:, -1:], fps[:, -1:]
            yield pd.DataFrame({"rep": np.arange(first, first + many), "p": out[0].astype(np.int64), "n": out[1].astype(np.int64),
                                "auc": out[2], "ap": out[3]})

    # The rows are few bytes and much work: a stated number of tasks is not merged by their bytes.
    tasks = max(1, min(len(totals), MOST_TASKS))
    sums = (numbered.withColumn("chunk", chunk).repartition(tasks, "chunk").groupBy("chunk")
            .applyInPandas(lambda key, pdf: pd.concat(parts(key, pdf), ignore_index=True),
                           "rep int, p bigint, n bigint, auc double, ap double")
            .groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("p", "n", "auc", "ap")]))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select("rep", F.col("p").alias("positives"), F.col("n").alias("negatives"),
                       F.when(both, F.col("auc") / F.col("p") / F.col("n")).alias("roc_auc"),
                       F.when(both, F.col("ap") / F.col("p")).alias("average_precision"))


def ranking_bootstrap(df: DataFrame, y: str, score: str, replicates: int = K.BOOTSTRAP_RESAMPLES,
                      seed: int = K.SEED) -> DataFrame:
    """Intervals of ROC-AUC and average precision over resamples that have both classes."""
    reps = ranking_replicates(df, y, score, replicates, seed).filter(F.col("roc_auc").isNotNull())
    points = ranking(df, y, score).withColumn("mode", F.lit("ranking"))
    return _intervals(reps.withColumn("mode", F.lit("ranking")), points, ["roc_auc", "average_precision"])
