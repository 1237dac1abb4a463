"""Exact percentiles (linear between ranks) that stay exact on big tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from plantwatch.functions.expressions import nan_to_null
from plantwatch.session import fits_one_task, pin_small

ACCURACY = 100_000


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where two missing keys are equal."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]
    return left.join(named, reduce(lambda a, b: a & b, same), how).drop(*[f"_r_{k}" for k in keys])


def melt(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Long form (keep..., feature, v) of numeric columns; NaN becomes NULL.

    The plan has the same size for any number of columns, and every aggregate over
    it combines per feature before the shuffle.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("v"))
                      for c in columns])
    return df.select(*(keep or []), F.inline(cells)).withColumn("v", nan_to_null("v"))


def _by_sort(long: DataFrame, ks: list[str], shares: list[float]) -> DataFrame:
    """Ranks from running counts over the sorted values of each feature."""
    # Missing values count 0, so a feature without any value keeps its row, with NULLs.
    counts = long.groupBy(*ks, "v").agg(F.count("v").alias("n"))
    w = W.partitionBy(*ks)
    ranked = counts.withColumns({
        "cum": F.sum("n").over(w.orderBy("v").rowsBetween(W.unboundedPreceding, 0)),
        "total": F.sum("n").over(w)})
    cells = []
    for s in shares:
        place = F.lit(s) * (F.col("total") - 1)
        at = lambda rank: F.min(F.when(F.col("cum") > rank, F.col("v")))
        f = F.first(place - F.floor(place))
        a, b = at(F.floor(place)), at(F.ceil(place))
        cells.append(F.struct(F.lit(s).alias("share"), F.when(f == 0, a).otherwise(a * (1 - f) + b * f).alias("value")))
    return ranked.groupBy(*ks).agg(F.array(*cells).alias("q")).select(*ks, F.inline("q"))


def exact_percentiles(df: DataFrame, columns: list[str], shares: list[float],
                      keys: list[str] | None = None) -> DataFrame:
    """Long table: keys, feature, share, value.

    When the table fits one task per feature, the value counts are sorted. A bigger
    table is read twice: once for a
    narrow bracket around each wanted rank, and once to count what lies below the
    bracket and to list what lies inside it. The exact rank is picked from that list.
    """
    keys = keys or []
    long = melt(df, columns, keys)
    ks = [*keys, "feature"]
    if fits_one_task(df):
        return _by_sort(long, ks, shares)

    e = 2.0 / ACCURACY
    marks = [m for s in shares for m in (max(s - e, 0.0), min(s + e, 1.0))]
    brackets = long.groupBy(*ks).agg(
        F.count("v").alias("total"), F.min("v").alias("lowest"), F.max("v").alias("highest"),
        F.percentile_approx("v", F.array(*[F.lit(m) for m in marks]), F.lit(ACCURACY)).alias("q"))
    ranges = F.array(*[F.struct(
        F.lit(s).alias("share"),
        (F.col("lowest") if s - e <= 0 else F.col("q")[2 * j]).alias("lo"),
        (F.col("highest") if s + e >= 1 else F.col("q")[2 * j + 1]).alias("hi"))
        for j, s in enumerate(shares)])
    brackets = pin_small(brackets.select(*ks, "total", ranges.alias("ranges")))
    rows = _join(long, brackets.select(*ks, "ranges"), ks).filter(F.col("v").isNotNull())
    inside = (rows.select(*ks, "v", F.explode(F.filter("ranges", lambda r: F.col("v").between(r["lo"], r["hi"])
                                                       )["share"]).alias("share"))
              .groupBy(*ks, "share", "v").agg(F.count(F.lit(1)).alias("n")))
    # A bracket may miss the wanted rank by one on either side; the neighbours cover that.
    edges = []
    for j in range(len(shares)):
        lo, hi = F.col("ranges")[j]["lo"], F.col("ranges")[j]["hi"]
        edges += [F.sum((F.col("v") < lo).cast("bigint")).alias(f"n{j}"),
                  F.max(F.when(F.col("v") < lo, F.col("v"))).alias(f"a{j}"),
                  F.min(F.when(F.col("v") > hi, F.col("v"))).alias(f"b{j}")]
    outside = rows.groupBy(*ks).agg(*edges).select(*ks, F.inline(F.array(*[
        F.struct(F.lit(s).alias("share"), F.col(f"n{j}").alias("below"), F.col(f"a{j}").alias("under"),
                 F.col(f"b{j}").alias("over")) for j, s in enumerate(shares)])))
    ranks = pin_small(_join(outside, brackets.select(*ks, "total"), ks))
    w = W.partitionBy(*ks, "share").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    place = F.col("share") * (F.col("total") - 1)

    def at(rank):
        found = F.min(F.when(F.col("cum") > rank, F.col("v")))
        return (F.when(F.first(rank) < F.first("below"), F.first("under"))
                .otherwise(F.coalesce(found, F.first("over"))))

    picked = (_join(inside, ranks, [*ks, "share"])
              .withColumn("cum", F.sum("n").over(w) + F.col("below"))
              .groupBy(*ks, "share").agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"),
                                         F.first(place - F.floor(place)).alias("f")))
    value = F.when(F.col("f") == 0, F.col("a")).otherwise(
        F.col("a") * (1 - F.col("f")) + F.col("b") * F.col("f"))
    wanted = brackets.select(*ks, F.explode(F.col("ranges")["share"]).alias("share"))
    # A feature without any value keeps its row, with NULL.
    return _join(wanted, picked.select(*ks, "share", value.alias("value")), [*ks, "share"], "left").select(*ks, "share", "value")
