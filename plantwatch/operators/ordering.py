"""Order-dependent work without putting one group into one task.

A window over ``partitionBy(asset)`` sends a whole asset to one task. Here a big
group is cut into slots that follow the order of the rows; a small table of slot
totals gives every slot its offset, and the window runs inside a slot only.
"""

from __future__ import annotations

from functools import reduce
from math import isfinite
from os.path import commonprefix

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BinaryType, StringType

from plantwatch.session import fits_one_task, pin_small, rows_per_task

MAX_SLOTS = 8_192


def range_splits(df: DataFrame, value: Column, limit: int | None = None) -> list[float]:
    """Cut points that leave about ``limit`` rows between neighbours; [] if df is small.

    One narrow pass. The points reach the driver (at most MAX_SLOTS numbers) and
    become constants of the plan, so every branch of the plan sees the same ones.
    """
    limit = limit or rows_per_task(df.sparkSession)
    rows = df.count()
    if rows <= limit:
        return []
    slots = min(MAX_SLOTS, -(-rows * 2 // limit))
    shares = [i / slots for i in range(1, slots)]
    row = df.agg(F.percentile_approx(
        value.cast("double"), F.array(*[F.lit(s) for s in shares]), F.lit(slots * 20)).alias("q")).first()
    # Missing values stand at an end of the order and are no cut.
    return sorted({float(x) for x in (row["q"] or []) if isfinite(x)})


def order_number(df: DataFrame, value: Column) -> Column:
    """A number that grows with the value; texts and bytes count by six bytes after what all of them begin with."""
    kind = df.select(value.alias("v")).schema["v"].dataType
    if not isinstance(kind, (StringType, BinaryType)):
        return value.cast("double")
    ends = df.agg(F.hex(F.min(value).cast("binary")).alias("lo"), F.hex(F.max(value).cast("binary")).alias("hi")).first()
    common = len(commonprefix([ends["lo"] or "", ends["hi"] or ""])) // 2
    part = F.rpad(F.hex(F.substring(value.cast("binary"), common + 1, 6)), 12, "0")
    return F.conv(part, 16, 10).cast("double")


def assign_slot(df: DataFrame, value: Column, splits: list[float], name: str = "_slot") -> DataFrame:
    """Number of the range a value lies in: slot i holds splits[i-1] <= value < splits[i]."""
    if not splits:
        return df.withColumn(name, F.lit(0))
    bounds = [float("-inf"), *splits, float("inf")]
    tmp = f"{name}_in"
    out = Bucketizer(splits=bounds, inputCol=tmp, outputCol=name, handleInvalid="keep").transform(
        df.withColumn(tmp, value.cast("double")))
    return out.withColumn(name, F.col(name).cast("int")).drop(tmp)


def _match(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def add_offsets(df: DataFrame, keys: list[str], slot: str, sums: dict[str, Column],
                only: Column | None = None) -> DataFrame:
    """Add to each row the totals of all earlier slots of its key, one column per sum.

    ``only`` limits the slot table to the rows that are slotted; others get 0. The
    join and a window over (keys, slot) need the same partitioning, so the rows are
    shuffled once for both.
    """
    names = list(sums)
    slotted = df if only is None else df.filter(only)
    totals = slotted.groupBy(*keys, slot).agg(*[F.sum(sums[n]).alias(n) for n in names])
    earlier = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(slot).rowsBetween(
        W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys], F.col(slot).alias("_o_slot"),
        *[F.sum(n).over(earlier).alias(f"_off_{n}") for n in names])
    pairs = [(k, f"_o_{k}") for k in keys] + [(slot, "_o_slot")]
    out = df.join(offsets, _match(df, offsets, pairs), "left").drop(*[b for _, b in pairs])
    return out.withColumns({f"_off_{n}": F.coalesce(f"_off_{n}", F.lit(0)) for n in names})


def big_keys(parts: list[DataFrame], keys: list[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows in all parts together, or None when there are none.

    Only the key columns are read. At most rows / limit keys can be big, so the table is small by construction.
    """
    counts = reduce(DataFrame.unionByName, [p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) for p in parts])
    big = pin_small(counts.groupBy(*keys).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > limit).select(*keys))
    return None if big.isEmpty() else big


def ordered_index(df: DataFrame, keys: list[str], order: list, name: str,
                  by: Column, slot: Column | None = None, counted: list[DataFrame] | None = None) -> DataFrame:
    """0-based position of each row inside its key, dense and exact.

    ``by`` grows with ``order`` (its leading part): a number, a time as a number, or a text. When no key
    is big, this is one plain window. Otherwise rows of big keys are cut into
    slots along ``by``; ``slot`` replaces the measured cut when the caller has an
    even one, such as leading digits of a hash. Rows without a key are one group.
    ``counted``: tables that hold at least the rows of every key, when they are cheaper to count than ``df``.
    """
    limit = rows_per_task(df.sparkSession)
    big = big_keys(counted or [df], keys, limit) if keys else None
    if big is None if keys else fits_one_task(df, limit):
        w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    if slot is not None:
        work = df.withColumn("_slot", slot)
    else:
        by = order_number(df, by)
        work = assign_slot(df, by, range_splits(df, by, limit))
    only = None
    if keys:
        big = big.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.lit(True).alias("_big"))
        pairs = [(k, f"_b_{k}") for k in keys]
        same = reduce(lambda a, b: a & b, [work[x].eqNullSafe(big[y]) for x, y in pairs])
        work = (work.join(F.broadcast(big), same, "left")
                .withColumn("_slot", F.when(F.col("_big"), F.col("_slot")).otherwise(F.lit(-1)))
                .drop("_big", *[b for _, b in pairs]))
        only = F.col("_slot") >= 0
    work = add_offsets(work, keys, "_slot", {"n": F.lit(1)}, only)
    w = W.partitionBy(*keys, "_slot").orderBy(*order)
    return (work.withColumn(name, (F.col("_off_n") + F.row_number().over(w) - 1).cast("bigint"))
            .drop("_slot", "_off_n"))


def running_totals(df: DataFrame, keys: list[str], value: str, sums: dict[str, str],
                   splits: list[float] | None = None) -> DataFrame:
    """Inclusive running sums along ascending ``value`` (unique inside a key).

    ``sums`` maps an output name to the summed column. ``splits`` are cut points of
    ``value`` from range_splits; when not given they are measured on ``df``.
    """
    if splits is None:
        splits = range_splits(df, F.col(value))
    work = assign_slot(df, F.col(value), splits)
    if splits:
        work = add_offsets(work, keys, "_slot", {out: F.col(c) for out, c in sums.items()})
    w = (W.partitionBy(*keys, "_slot").orderBy(value)
         .rowsBetween(W.unboundedPreceding, W.currentRow))
    cols = {out: F.sum(c).over(w) + (F.col(f"_off_{out}") if splits else F.lit(0))
            for out, c in sums.items()}
    return work.withColumns(cols).drop("_slot", *[f"_off_{o}" for o in sums])


def tick_chunks(df: DataFrame, tick: str, overlap: int, size: int | None = None,
                counted: list[DataFrame] | None = None) -> DataFrame:
    """Cut the series of each machine into chunks for windows that look back ``overlap`` rows.

    Chunks are runs of row positions, so ticks may have gaps. The last rows of a chunk are repeated at the head of the next one and marked
    in ``_halo``; drop those rows after the window. A chunk never exceeds
    ``size + overlap`` rows, whatever the length of the series. When no machine has more rows than that,
    every series is one chunk and its rows are not numbered. ``counted`` as in ``ordered_index``.
    """
    size = size or rows_per_task(df.sparkSession)
    size = max(size, overlap + 1)
    if big_keys(counted or [df], ["machine"], size) is None:
        return df.withColumns({"_chunk": F.lit(0).cast("bigint"), "_halo": F.lit(False)})
    rows = ordered_index(df, ["machine"], [tick], "_at", by=F.col(tick), counted=counted)
    base = F.floor(F.col("_at") / F.lit(size))
    chunks = F.when(F.pmod(F.col("_at"), F.lit(size)) >= size - overlap, F.array(base, base + 1)
                    ).otherwise(F.array(base))
    return (rows.withColumn("_base", base).withColumn("_chunk", F.explode(chunks))
            .withColumn("_halo", F.col("_chunk") > F.col("_base")).drop("_base", "_at"))


def with_group_stats(df: DataFrame, key: str, stats: list[Column], row_key: Column,
                     fanout: int = 64) -> DataFrame:
    """Aggregate per key and put the result on every row of that key.

    The aggregate combines on the map side first. Rows of big keys are spread over
    ``fanout`` salts before the join, and only the few rows of big keys in the
    aggregate are repeated for it.
    """
    limit = rows_per_task(df.sparkSession)
    totals = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *stats)
    if fits_one_task(df, limit):
        right = totals.withColumnRenamed(key, "_k").drop("_n")
        return df.join(right, df[key] == right["_k"], "inner").drop("_k")
    big = totals.filter(F.col("_n") > limit).select(F.col(key).alias("_b"), F.lit(True).alias("_big"))
    left = df.join(F.broadcast(big), df[key] == big["_b"], "left").withColumn(
        "_salt", F.when(F.col("_big"), F.pmod(F.xxhash64(row_key), F.lit(fanout))).otherwise(F.lit(0))
    ).drop("_b", "_big")
    right = totals.withColumnRenamed(key, "_k").withColumn(
        "_s", F.explode(F.when(F.col("_n") > limit, F.sequence(F.lit(0), F.lit(fanout - 1)))
                        .otherwise(F.array(F.lit(0))))).drop("_n")
    return left.join(right, (left[key] == right["_k"]) & (left["_salt"] == right["_s"]),
                     "inner").drop("_k", "_s", "_salt")


def spread_join(df: DataFrame, lookup: DataFrame, key: str, row_key: Column, how: str = "inner",
                fanout: int = 64) -> DataFrame:
    """Join rows with a table that has one row per key, whatever share of the rows a key has.

    Rows of big keys are spread over ``fanout`` salts and only the lookup rows of
    those keys are repeated.
    """
    limit = rows_per_task(df.sparkSession)
    if fits_one_task(df, limit):
        return df.join(lookup, key, how)
    big = (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
           .select(key, F.lit(True).alias("_big")))
    salts = F.sequence(F.lit(0), F.lit(fanout - 1))
    left = (df.join(F.broadcast(big), key, "left")
            .withColumn("_salt", F.when(F.col("_big"), F.pmod(F.xxhash64(row_key), F.lit(fanout))).otherwise(F.lit(0))
                        .cast("int")).drop("_big"))
    right = (lookup.join(F.broadcast(big), key, "left")
             .withColumn("_salt", F.explode(F.when(F.col("_big"), salts).otherwise(F.array(F.lit(0))))).drop("_big"))
    return left.join(right, [key, "_salt"], how).drop("_salt")
