"""Duplicate, conflict and leakage audit of a labelled table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, FloatType

from plantwatch.functions.keys import content_key
from plantwatch.operators.ordering import spread_join, with_group_stats


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_counts(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and percent, most first. One pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.sum(is_missing(df, c).cast("bigint")).alias(c) for c in df.columns])
    long = counts.unpivot("_rows", [F.col(f"`{c}`") for c in df.columns], "column", "missing_count")
    return (long.filter(F.col("missing_count") > 0)
            .select("column", "missing_count",
                    (F.col("missing_count") / F.col("_rows") * 100).alias("missing_pct"))
            .orderBy(F.desc("missing_count"), "column"))


def with_group_id(df: DataFrame, features: list[str], name: str = "gid") -> DataFrame:
    return df.withColumn(name, content_key(df, features))


def group_labels(df: DataFrame, gid: str, label: str) -> DataFrame:
    """Rows and distinct labels per duplicate group; combines before the shuffle."""
    return df.groupBy(gid).agg(F.count(F.lit(1)).alias("rows"),
                               F.min(label).alias("lo"), F.max(label).alias("hi"))


def duplicate_rows(df: DataFrame, gid: str) -> DataFrame:
    """Rows that repeat an earlier one, and rows in groups with more than one row."""
    n = F.col("count")
    return df.groupBy(gid).count().agg(
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows_in_duplicate_groups"))


def duplicate_members(df: DataFrame, gid: str, row_id: str) -> DataFrame:
    """Every row of every group that has more than one row."""
    return (with_group_stats(df, gid, [F.count(F.lit(1)).alias("group_size")], F.col(row_id))
            .filter(F.col("group_size") > 1))


def label_audit(df: DataFrame, gid: str, label: str) -> DataFrame:
    """How many duplicate groups agree on the label and how many do not."""
    dup = F.col("rows") > 1
    clash = F.col("lo") != F.col("hi")
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return group_labels(df, gid, label).agg(
        F.count(F.lit(1)).alias("groups"),
        count(dup).alias("duplicate_groups"),
        count(dup & ~clash).alias("same_label_groups"),
        count(clash).alias("conflicting_groups"),
        F.coalesce(F.sum(F.when(clash, F.col("rows"))), F.lit(0)).alias("rows_in_conflict"))


def largest_groups(df: DataFrame, features: list[str], k: int = 10) -> DataFrame:
    return (df.groupBy(*features).agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col("rows") > 1).orderBy(F.desc("rows"), *features).limit(k))


def conflict_report(df: DataFrame, gid: str, label: str) -> DataFrame:
    """Conflicting groups: rows, number of labels and the sorted label list; a missing label is none.

    Labels are made distinct per group before they are listed, so the list is as
    long as the label set, however many rows the group has.
    """
    per_label = df.groupBy(gid, label).agg(F.count(F.lit(1)).alias("n"))
    return (per_label.groupBy(gid).agg(
        F.count(label).alias("n_labels"), F.sum("n").alias("rows"),
        F.array_join(F.array_sort(F.collect_list(label)), ", ").alias("labels"))
        .filter(F.col("n_labels") > 1))


def drop_conflicting(df: DataFrame, gid: str, label: str, row_id: str) -> DataFrame:
    """Remove every row of a group whose rows disagree on the label."""
    stats = [F.min(label).alias("_lo"), F.max(label).alias("_hi")]
    return (with_group_stats(df, gid, stats, F.col(row_id))
            .filter(F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(True))).drop("_lo", "_hi"))


def with_group_size(df: DataFrame, gid: str, row_id: str) -> DataFrame:
    return with_group_stats(df, gid, [F.count(F.lit(1)).alias("group_size")], F.col(row_id))


def crossing_groups(df: DataFrame, gid: str, split: str = "split") -> DataFrame:
    """Number of groups whose rows are in more than one split."""
    per = df.groupBy(gid).agg((F.min(split) != F.max(split)).cast("bigint").alias("x"))
    return per.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("crossing_groups"))


def assert_no_leakage(df: DataFrame, gid: str, split: str = "split") -> None:
    n = crossing_groups(df, gid, split).first()[0]
    if n:
        raise RuntimeError(f"leakage check failed: {n} duplicate groups cross splits")


def remaining_conflicts(df: DataFrame, gid: str, label: str) -> DataFrame:
    return group_labels(df, gid, label).agg(F.coalesce(
        F.sum((F.col("lo") != F.col("hi")).cast("bigint")), F.lit(0)).alias("conflicting_groups"))


def assert_no_conflicts(df: DataFrame, gid: str, label: str) -> None:
    n = remaining_conflicts(df, gid, label).first()[0]
    if n:
        raise RuntimeError(f"{n} conflicting duplicate groups remain after cleaning")


def unique_patterns(df: DataFrame, gid: str, row_id: str) -> DataFrame:
    """First row of each duplicate group.

    Spark keeps only the first row of a group per task before the shuffle
    (WindowGroupLimit), so a flood of copies does not travel.
    """
    w = W.partitionBy(gid).orderBy(row_id)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def value_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``a`` that ``b`` does not have."""
    return a.select(column).subtract(b.select(column))


def shared_rows(a: DataFrame, b: DataFrame, key: str, row_id: str) -> DataFrame:
    """Leakage probe: rows of ``a`` whose content key also occurs in ``b``."""
    return spread_join(a, b.select(key).distinct(), key, F.col(row_id), "left_semi")
