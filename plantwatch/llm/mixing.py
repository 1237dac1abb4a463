"""Operator 4: mixing sources to target weights, in DataFrame functions only.

Sizes are added up per source, targets follow from the weights, and a source's repetition
rate is target / size. A document is taken floor(rate) times, plus once more when a uniform
number hashed from seed and id is below the fraction.

Targets share ``share`` times all sizes by weight, but stop at ``most`` times a source's size;
what is over goes to the other sources by weight until none is above. That is the water level
L at which the sum of min(most * size, L * weight) is the total, found in one sorted pass over
the sources: with sources ordered by most * size / weight, the first k of them are full.

Only the table of sources (one row each, combined before the shuffle) is ever sorted. It is
written once, so that its size is known when Spark picks how to join it: it is broadcast below
Spark's threshold and joined by shuffle, with skewed keys split, beyond it.

Defined results: a null or empty text has size 0 and a null source is a source of its own, the
last; a source without words has target 0 and its documents rate 0; rows of one id share one
draw, so repeated rows are taken equally often; a null id has a draw of its own; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plantwatch.session import materialise

# Weights go round in this order, over sources in code point order, null last.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Hex digits of a draw; 13 digits are 52 bits, which a double holds exactly.
DIGITS = 13


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than space and \\x09-\\x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def draw(id_col: str, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from the hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint").cast("double") / F.lit(float(16**DIGITS))


def source_targets(sizes: DataFrame, source_col: str = "source", size_col: str = "size", weights: tuple = WEIGHTS,
                   share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source_size, target, rate."""
    if not weights or min(weights) <= 0 or share < 0 or most < share:
        raise ValueError("weights must be above 0, and share between 0 and most")
    totals = sizes.groupBy(F.col(source_col).alias("_source")).agg(F.sum(size_col).alias("source_size"))
    order = W.orderBy(F.col("_source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    table = totals.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))
    table = table.withColumn("_full", F.col("source_size") * F.lit(most)).withColumn("_at", F.col("_full") / F.col("_w"))
    by_level = W.orderBy("_at", F.col("_source").asc_nulls_last())
    everything = W.orderBy("_at", F.col("_source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, W.unboundedFollowing)
    table = (table.withColumn("_total", F.sum("source_size").over(everything) * F.lit(share))
             .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
             .withColumn("_place", F.row_number().over(by_level))
             # The level is that of the first source that is not full.
             .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_place", "_level"))).over(everything)["_level"])
             .withColumn("target", F.when(F.col("_level").isNull() | (F.col("_at") <= F.col("_level")), F.col("_full"))
                         .otherwise(F.col("_level") * F.col("_w"))))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(F.lit(0.0))
    return table.select("_source", "source_size", "target", rate.alias("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED,
        keep: list[str] | None = None, names: tuple[str, str, str, str] = ("size", "source_size", "target", "copies"),
        **targets) -> DataFrame:
    """The kept columns (all of them by default) with size, source_size, target and number of copies."""
    keep = docs.columns if keep is None else keep
    sized = docs.select(F.struct(*keep).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_of"),
                        word_count(F.col(text_col)).alias("_size"))
    table = materialise(source_targets(sized, "_of", "_size", **targets), "sources")
    joined = sized.join(table, sized["_of"].eqNullSafe(table["_source"]), "left")
    whole = F.floor("rate")
    copies = whole + F.when(draw("_id", seed) < F.col("rate") - whole, F.lit(1)).otherwise(F.lit(0))
    new = (F.col("_size"), F.col("source_size"), F.col("target"), copies.cast("bigint"))
    return joined.select("_row.*", *[c.alias(n) for c, n in zip(new, names)])


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns only."""
    columns = docs.columns
    n = "_copies"
    mixed = mix(docs, names=("_size", "_source_size", "_target", n), **options)
    return (mixed.filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))))
            .select(*columns))
