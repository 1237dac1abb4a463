"""Profiles of tables and features. Each is one or two passes, whatever the column count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from plantwatch import constants as K
from plantwatch.functions.expressions import nan_to_null, ratio
from plantwatch.operators.quantiles import exact_percentiles, melt
from plantwatch.session import pin_small, ship_package


def numeric_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def value_counts(df: DataFrame, column: str, k: int | None = 20, missing: bool = True) -> DataFrame:
    """Rows per value, most first; missing values are a value of their own if wanted."""
    base = df if missing else df.filter(F.col(column).isNotNull())
    out = base.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)
    return out.limit(k) if k else out


def class_distribution(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per class and their percentage of all rows, taken before any limit."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    out = (counts.filter(F.col(column).isNotNull())
           .withColumn("percentage", F.col("count") / total * 100)
           .orderBy(F.desc("count"), column))
    return out.limit(k) if k else out


def rate_by_group(df: DataFrame, group: str, target: str) -> DataFrame:
    return (df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.sum(target).alias("failures"),
                                  F.avg(target).alias("failure_rate"))
            .withColumn("failure_rate_pct", F.col("failure_rate") * 100)
            .orderBy(F.desc("failure_rate"), group))


def stats_by_class(df: DataFrame, label: str, columns: list[str], digits: int = 4) -> DataFrame:
    """Mean, median and sample deviation per class and feature."""
    long = melt(df, columns, [label]).groupBy(label, "feature").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    medians = exact_percentiles(df, columns, [0.5], [label])
    return (long.join(medians, [label, "feature"])
            .select(label, "feature", F.round("mean", digits).alias("mean"),
                    F.round("value", digits).alias("median"), F.round("std", digits).alias("std")))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs; NULL when a side is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


GRAM = "i int, j int, n double, x double, y double, xx double, yy double, xy double"


def _gram(low: list[float]):
    """Sums over complete pairs of columns, one row per pair and task, from matrix products of Arrow batches."""
    def run(batches):
        total = None
        for batch in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns]) - low
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            sums = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = sums if total is None else total + sums
        if total is not None:
            i, j = np.triu_indices(total.shape[1])
            columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t[i, j]) for t in total]]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in GRAM.split(", ")])
    return run


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long matrix (a, b, r) of Pearson correlations over complete pairs; NULL when a side is constant.

    One pass that expands no row: a task adds up the Gram matrix of its batches, and only
    columns x columns sums per task are shuffled. Values are taken from the column's
    minimum, so that large offsets cost no digits and a constant column is exactly 0.
    """
    clean = df.select(*[nan_to_null(F.col(f"`{c}`").cast("double")).alias(f"c{k}") for k, c in enumerate(columns)])
    low = [v or 0.0 for v in clean.agg(*[F.min(c) for c in clean.columns]).first()]
    ship_package(df.sparkSession)
    sums = clean.mapInArrow(_gram(low), GRAM).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    var_x, var_y = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    cov = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    varies = (F.col("n") > 0) & (var_x > F.col("xx") * 1e-13) & (var_y > F.col("yy") * 1e-13)
    r = F.when(F.col("n") > 0, F.when(varies, cov / F.sqrt(var_x * var_y)))
    names = F.array(*[F.lit(c) for c in columns])
    a, b = F.element_at(names, F.col("i") + 1), F.element_at(names, F.col("j") + 1)
    upper = sums.select(a.alias("a"), b.alias("b"), r.alias("r"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", "r"))).otherwise(F.array(
        F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r")))
    return upper.select(F.inline(both))


def target_correlations(df: DataFrame, columns: list[str], target: Column | str, k: int | None = None) -> DataFrame:
    """Correlation of each feature with a target, by absolute size; undefined ones dropped."""
    t = F.col(target) if isinstance(target, str) else target
    work = df.select(*[F.col(f"`{c}`") for c in columns], t.cast("double").alias("_t"))
    long = melt(work, columns, ["_t"]).groupBy("feature").agg(safe_corr(F.col("v"), F.col("_t")).alias("r"))
    out = long.filter(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "feature")
    return out.limit(k) if k else out


def _moments(count: str) -> list[Column]:
    return [F.count("v").alias(count), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
            F.min("v").alias("min"), F.max("v").alias("max")]


def describe_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per feature, one row per feature."""
    long = melt(df, columns).groupBy("feature").agg(*_moments("count"))
    q = exact_percentiles(df, columns, [0.25, 0.5, 0.75]).groupBy("feature").pivot(
        "share", [0.25, 0.5, 0.75]).agg(F.first("value")).toDF("feature", "p25", "p50", "p75")
    return long.join(q, "feature").select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
                                          ).orderBy("feature")


def _modes(long: DataFrame) -> DataFrame:
    """From (feature, v): distinct values (missing counts as one), the most common and its rows.

    Values are counted per (feature, v) with map-side combining, so a dominant
    value never gathers in one task; ties go to the smaller value, missing last.
    """
    counts = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("neg"), F.col("v").isNull().alias("null"), F.col("v")))
    return counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"), top.alias("t")).select(
        "feature", "n_unique", F.col("t.v").alias("most_common_value"), (-F.col("t.neg")).alias("most_common_count"))


#: Texts up to this many characters are counted as they are, longer ones by their start and a hash.
PLAIN_TEXT = 64


def _text_modes(values: DataFrame) -> DataFrame:
    """``_modes`` for texts: what is shuffled per value does not grow with its length.

    A long text is counted under its first characters and its md5. Only if the most common value
    of a feature is a long one are the rows read again, to fetch it (the smallest of equally
    frequent ones); each task then sends one text per feature.
    """
    start = F.substring("v", 1, PLAIN_TEXT)
    keyed = values.withColumn("k", F.when(F.length("v") <= PLAIN_TEXT, F.col("v")).otherwise(F.concat(start, F.md5("v"))))
    counts = keyed.groupBy("feature", "k").agg(F.count(F.lit(1)).alias("n"))
    long, start = F.length("k") > PLAIN_TEXT, F.substring("k", 1, PLAIN_TEXT)
    top = F.min(F.struct((-F.col("n")).alias("neg"), F.col("k").isNull().alias("null"), start.alias("start"), long.alias("long")))
    winners = pin_small(counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"), top.alias("t")).select(
        "feature", "n_unique", F.col("t.start").alias("most_common_value"), (-F.col("t.neg")).alias("most_common_count"),
        F.coalesce("t.long", F.lit(False)).alias("is_long")))
    to_fetch = winners.filter("is_long")
    if to_fetch.isEmpty():
        return winners.drop("is_long")
    w = to_fetch.select("feature", F.col("most_common_value").alias("_start"), F.col("most_common_count").alias("_n"))
    tied = counts.filter(long).join(w, "feature").filter((F.col("n") == F.col("_n")) & (start == F.col("_start")))
    whole = keyed.join(pin_small(tied.select("feature", "k")), ["feature", "k"]).groupBy("feature").agg(F.min("v").alias("_whole"))
    return winners.join(whole, "feature", "left").select(
        "feature", "n_unique", F.coalesce("_whole", "most_common_value").alias("most_common_value"), "most_common_count")


def _dtype(df: DataFrame, columns: list[str]) -> Column:
    """Type name of the column that ``feature`` names."""
    names = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return F.create_map(*[F.lit(x) for c in columns for x in (c, names[c])])[F.col("feature")]


def _flags(df: DataFrame, near: float) -> DataFrame:
    constant = F.col("n_unique") <= 1
    return df.withColumns({"is_constant": constant,
                           "is_near_constant": F.col("dominant_pct") >= near * 100})


def numeric_profile(df: DataFrame, columns: list[str], near: float = K.NEAR_CONSTANT_SHARE,
                    id_like: float = K.ID_LIKE_RATIO) -> DataFrame:
    long = melt(df, columns)
    out = (long.groupBy("feature").agg(F.count(F.lit(1)).alias("_rows"), *_moments("n"))
           .withColumn("dtype", _dtype(df, columns)).join(_modes(long), "feature"))
    out = out.select(
        "feature", "dtype", "n_unique", (F.col("_rows") - F.col("n")).alias("missing_count"),
        (ratio(F.col("_rows") - F.col("n"), F.col("_rows")) * 100).alias("missing_pct"),
        "mean", "std", "min", "max",
        (ratio(F.col("most_common_count"), F.col("_rows")) * 100).alias("dominant_pct"),
        (ratio(F.col("n_unique"), F.col("_rows")) >= id_like).alias("is_id_like"))
    return _flags(out, near)


def near_constant(profile: DataFrame) -> DataFrame:
    """Features with one dominant value that are not constant."""
    return profile.filter(F.col("is_near_constant") & ~F.col("is_constant"))


def _text_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    texts = {}
    for c in columns:
        col = F.col(f"`{c}`")
        if df.schema[c].dataType.typeName() in ("double", "float"):
            col = nan_to_null(col)
        texts[c] = col.cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), t.alias("v")) for c, t in texts.items()])
    values = df.select(F.inline(cells))
    long = (values.groupBy("feature").agg(F.count(F.lit(1)).alias("_rows"), F.count("v").alias("n"))
            .withColumn("dtype", _dtype(df, columns)))
    return long.join(_text_modes(values), "feature").select(
        "feature", "dtype", "n_unique", ratio(F.col("n_unique"), F.col("_rows")).alias("unique_ratio"),
        (F.col("_rows") - F.col("n")).alias("missing_count"),
        (ratio(F.col("_rows") - F.col("n"), F.col("_rows")) * 100).alias("missing_pct"),
        "most_common_value", "most_common_count",
        (ratio(F.col("most_common_count"), F.col("_rows")) * 100).alias("dominant_pct"))


def categorical_profile(df: DataFrame, columns: list[str], high_ratio: float = K.HIGH_CARDINALITY_RATIO,
                        high_count: int = K.HIGH_CARDINALITY_COUNT) -> DataFrame:
    return _text_profile(df, columns).withColumn(
        "is_high_cardinality", (F.col("unique_ratio") >= high_ratio) | (F.col("n_unique") >= high_count))


def mixed_profile(df: DataFrame, columns: list[str], near: float = K.NEAR_CONSTANT_SHARE) -> DataFrame:
    """Numeric and text columns together; the most common value as text."""
    return _flags(_text_profile(df, columns).drop("unique_ratio"), near)


def class_histograms(df: DataFrame, label: str, column: str, bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram per class; the edges come from the class's own range."""
    v = nan_to_null(F.col(column).cast("double"))
    base = df.select(label, v.alias("v")).filter(F.col("v").isNotNull())
    lo, hi = F.min("v"), F.max("v")
    ranges = pin_small(base.groupBy(label).agg(
        F.when(lo < hi, lo).otherwise(lo - 0.5).alias("lo"), F.when(lo < hi, hi).otherwise(hi + 0.5).alias("hi")))
    cell = F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))),
                   F.lit(bins - 1)).cast("int")
    counts = base.join(ranges, label).groupBy(label, cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    edges = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return edges.join(counts, [label, "bin"], "left").select(
        label, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), F.coalesce("n", F.lit(0)).alias("count"))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """Negatives, positives, their ratio (NULL without positives) and the positive share."""
    pos = F.sum((F.col(target) == 1).cast("bigint"))
    neg = F.sum((F.col(target) == 0).cast("bigint"))
    return df.agg(neg.alias("negatives"), pos.alias("positives"),
                  ratio(neg, pos, None).alias("scale_pos_weight"),
                  (F.avg((F.col(target) == 1).cast("int")) * 100).alias("positive_pct"))
