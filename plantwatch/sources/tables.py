"""Reading and writing tables: typed CSV, missing values, row positions, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from plantwatch.functions.expressions import nan_to_null
from plantwatch.operators.ordering import ordered_index

# --- Fixed values: cell texts that mean "no value" ----------------------------
MISSING_TEXTS = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "<NA>", "n/a", "#N/A"]


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """CSV with a declared schema; missing-value texts and NaN become NULL.

    Cells are read as text and cast afterwards, so a missing-value text in a numeric
    column neither fails nor turns the column into text. A cell that is neither a
    number nor a missing value stops the query.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields])
    raw = spark.read.schema(texts).option("header", header).option("mode", "FAILFAST").csv(path)
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        value = F.when(c.isNotNull() & ~c.isin(*MISSING_TEXTS), c).cast(f.dataType)
        if isinstance(f.dataType, (DoubleType, FloatType)):
            value = nan_to_null(value)
        cols.append(value.alias(f.name))
    return raw.select(*cols)


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Replace dots in column names by underscores; returns the map back to the old names."""
    names = {c: c.replace(".", "_") for c in df.columns}
    if len(set(names.values())) < len(names):
        raise ValueError("column names collide once dots are replaced")
    return df.toDF(*names.values()), {new: old for old, new in names.items()}


def with_file_position(df: DataFrame, name: str = "row_id") -> DataFrame:
    """0-based position of each row in its text files, in path order.

    Rows of one file block keep their order; block totals give the offsets. Only the
    block totals are put in sequence, never the rows.
    """
    marked = df.select("*", F.col("_metadata.file_path").alias("_f"),
                       F.col("_metadata.file_block_start").alias("_b"),
                       F.monotonically_increasing_id().alias("_m"))
    slot = F.struct("_f", "_b")
    return ordered_index(marked, [], ["_f", "_b", "_m"], name, by=F.col("_b"), slot=slot).drop("_f", "_b", "_m")


def dense_row_id(df: DataFrame, order: list[str], by: Column, name: str = "row_id") -> DataFrame:
    """Dense 0..n-1 id over a declared order."""
    return ordered_index(df, [], order, name, by=by)


def align_by_key(left: DataFrame, right: DataFrame, key: str, unmatched: str = "refuse") -> DataFrame:
    """Join two tables that have at most one row per key on both sides.

    ``refuse`` stops if a key is on one side only. ``report`` keeps such rows and adds ``side``
    (both, left or right). Rows without a key match nothing and are kept likewise.
    """
    for side, df in (("left", left), ("right", right)):
        if not df.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > 1).isEmpty():
            raise ValueError(f"{side} table has several rows for one {key}")
    joined = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), key, "full")
    if unmatched == "report":
        side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
        return joined.withColumn("side", side).drop("_l", "_r")
    if not joined.filter(F.col("_l").isNull() | F.col("_r").isNull()).isEmpty():
        raise ValueError(f"the tables do not have the same {key} values")
    return joined.drop("_l", "_r")


def align_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two text tables side by side by row position; both need the same length."""
    a, b = with_file_position(left, "row_id"), with_file_position(right, "row_id")
    return align_by_key(a, b, "row_id")


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Modelling table partitioned by split, so that a split filter prunes files."""
    df.write.partitionBy(split).parquet(path)
