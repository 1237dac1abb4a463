"""Splits and samples that depend on hashes of keys, never on row order or chance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from plantwatch import constants as K
from plantwatch.functions.keys import hash_hex, hash_mod, hex_cut, key_text
from plantwatch.operators.ordering import ordered_index, spread_join
from plantwatch.session import materialise, pin_small

SHARES = (("train", 0.64), ("validation", 0.16), ("test", 0.20))
MOST_SIGNATURES = 10_000


def hash_split(df: DataFrame, key: str, seed: int = K.SEED, shares=SHARES, name: str = "split") -> DataFrame:
    """Row-local split by hash share; needs no shuffle and never changes for a key."""
    h = hash_hex(key, seed)
    out, bound = F.lit(shares[-1][0]), 1.0
    for split, share in reversed(shares[:-1]):
        bound = sum(s for _, s in shares[:[x for x, _ in shares].index(split) + 1])
        out = F.when(h < hex_cut(bound), split).otherwise(out)
    return df.withColumn(name, out)


def _hash_position(df: DataFrame, by: list[str], key: str, seed: int | str, name: str) -> DataFrame:
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    work = df.withColumn("_h", h)
    lead = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    return ordered_index(work, by, ["_h", key], name, by=lead, slot=lead).drop("_h")


def exact_stratified_split(df: DataFrame, label: str, key: str, seed: int = K.SEED,
                           shares=SHARES, name: str = "split") -> DataFrame:
    """Split with exact counts per class: position by hash inside the class; missing labels are a class."""
    totals = pin_small(df.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n")))
    work = _hash_position(df, [label], key, seed, "_i")
    work = work.join(totals, work[label].eqNullSafe(totals["_class"])).drop("_class")
    out, bound = F.lit(shares[-1][0]), 0.0
    bounds = []
    for split, share in shares[:-1]:
        bound += share
        bounds.append((split, bound))
    for split, b in reversed(bounds):
        out = F.when(F.col("_i") < F.round(F.col("_n") * F.lit(b)), split).otherwise(out)
    return work.withColumn(name, out).drop("_i", "_n")


def stratified_kfold(df: DataFrame, label: str, key: str, k: int = 4, seed: int = K.SEED,
                     name: str = "fold") -> DataFrame:
    """Fold column with class counts that differ by one at most between folds."""
    return (_hash_position(df, [label], key, seed, "_i")
            .withColumn(name, F.pmod("_i", F.lit(k)).cast("int")).drop("_i"))


def fold_scores(df: DataFrame, label: str, group: str, target_fraction: float = 0.20,
                n_splits: int = 5, salt: int | str = K.SEED) -> DataFrame:
    """Distance of each hash fold of groups from the wanted size and class mix.

    Columns: fold, size, size_error, distribution_error, score. Only the table of
    (fold, class) counts is looked at after the first aggregation.
    """
    fold = hash_mod(group, salt, n_splits).cast("int")
    counts = pin_small(df.groupBy(fold.alias("fold"), F.col(label).alias("label"))
                       .agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.groupBy("label").agg(F.sum("n").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("label", "n")))).scalar()
    per = counts.groupBy("fold").agg(
        F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"))
    per = per.withColumns({"classes": classes, "total": total})
    # Every class of the whole table takes part; one that a fold lacks counts as 0.
    gap = F.aggregate("classes", F.lit(0.0).cast("double"), lambda acc, c: acc + F.abs(
        F.coalesce(F.try_element_at("m", c["label"]), F.lit(0)) / F.col("size") - c["n"] / F.col("total")))
    size_error = F.abs(F.col("size") / F.col("total") - F.lit(float(target_fraction)))
    return per.select("fold", "size", size_error.alias("size_error"), gap.alias("distribution_error"),
                      (size_error + gap).alias("score"))


def select_best_group_fold(df: DataFrame, label: str, group: str, target_fraction: float = 0.20,
                           n_splits: int = 5, salt: int | str = K.SEED) -> int | None:
    """The fold of the lowest score, the lower number among equal ones; None if there are no rows."""
    scores = fold_scores(df, label, group, target_fraction, n_splits, salt)
    # Sums of shares differ in their last bits: equal scores are told apart by the fold alone.
    best = scores.orderBy(F.round("score", 12), "fold").first()
    return best["fold"] if best else None


def group_split(df: DataFrame, label: str, group: str, n_splits: int = 5, seed: int = K.SEED,
                name: str = "split") -> DataFrame:
    """64/16/20 split where a group is never divided; folds are hashes of the group id.

    The second choice uses another salt: the first hash modulo k would leave the
    rest with k-1 folds only. Where no row is left to choose from, no row gets the part.
    """
    def in_best(rows: DataFrame, salt: str):
        fold = select_best_group_fold(rows, label, group, 0.20, n_splits, salt)
        return F.lit(False) if fold is None else hash_mod(group, salt, n_splits) == fold

    is_test = in_best(df, f"{seed}t")
    is_val = in_best(df.filter(~is_test), f"{seed}v")
    return df.withColumn(name, F.when(is_test, "test").when(is_val, "validation").otherwise("train"))


def _deal(levels: np.ndarray, shares: np.ndarray, step: float, groups: int) -> np.ndarray:
    """How many of ``groups`` equal groups each part receives; a group lifts a part's level by step / share.

    Parts are filled like vessels: the lowest levels rise together; what is left after whole
    numbers goes where the level stays lowest.
    """
    if step <= 0:
        return np.bincount(np.arange(groups) % len(shares), minlength=len(shares)) if groups < len(shares) else _deal(
            np.zeros(len(shares)), shares, 1.0, groups)
    order = np.argsort(levels, kind="stable")
    width, volume = 0.0, 0.0
    for n, f in enumerate(order):
        width, volume = width + shares[f], volume + shares[f] * levels[f]
        top = (groups * step + volume) / width
        if n + 1 == len(order) or top <= levels[order[n + 1]]:
            break
    out = np.floor(np.maximum(0.0, top - levels) * shares / step + 1e-9).astype(np.int64)
    while (left := groups - int(out.sum())) != 0:
        f = int(np.argmin(levels + (out + 1) * step / shares)) if left > 0 else int(np.argmax(out))
        out[f] += 1 if left > 0 else -1
    return out


def _plan(signatures: list, rest: dict, totals: dict, shares: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """Groups of each signature per part, as running sums, and the shares of the parts in all other groups."""
    classes = {c: i for i, c in enumerate(totals)}
    whole = np.array([totals[c] for c in classes], float)
    filled = np.zeros((len(shares), len(classes)))
    bounds = []
    for counts, groups in signatures:
        v = np.zeros(len(classes))
        for c, n in counts:
            v[classes[c]] = n / whole[classes[c]]
        many = _deal(filled @ v / shares, shares, float(v @ v), groups)
        filled += many[:, None] * v
        bounds.append([int(x) for x in np.cumsum(many)])
    v = np.array([rest.get(c, 0) for c in classes], float) / np.maximum(whole, 1.0)
    if not v.any():
        return bounds, shares
    units = 1_000_000
    return bounds, _deal(filled @ v / shares, shares, float(v @ v) / units, units) / units


def balanced_groups(df: DataFrame, label: str, group: str, row_key: str, shares=SHARES, seed: int = K.SEED,
                    name: str = "split") -> DataFrame:
    """Deal whole groups to named parts so that every class keeps the wanted shares, however unequal the groups are.

    Groups with equal class counts (one signature) are alike: a signature is dealt at once,
    those of the biggest groups first, each to the parts that lack its classes most. Only
    the MOST_SIGNATURES signatures of the biggest groups come to the driver. Any other group
    holds at most 1 / MOST_SIGNATURES of the rows; those are dealt by hash, with the shares
    that even out what is left. Inside a signature groups go by the hash of their id, so the
    result does not depend on the order or the place of rows. A missing group id is one group, a
    missing label one class.
    """
    work = df.withColumn("_g", key_text(df, [group]))
    counts = work.groupBy("_g", F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("_counts"), F.sum("n").alias("_rows"))
    groups = materialise(groups.withColumn("_sig", F.md5(F.to_json(F.struct("_counts")))), "groups")
    kinds = groups.groupBy("_sig").agg(F.count(F.lit(1)).alias("many"), F.max("_rows").alias("rows"), F.any_value("_counts").alias("counts"))
    big = kinds.orderBy(F.desc("rows"), "_sig").limit(MOST_SIGNATURES).collect()
    totals = {r["c"]: r["n"] for r in groups.select(F.inline("_counts")).groupBy("c").agg(F.sum("n").alias("n")).collect()}
    rest = dict(totals)
    for r in big:
        for c, n in r["counts"]:
            rest[c] -= n * r["many"]
    names = [s for s, _ in shares]
    bounds, others = _plan([(r["counts"], r["many"]) for r in big], rest, dict(sorted(totals.items(), key=str)),
                           np.array([float(x) for _, x in shares]))
    plan = df.sparkSession.createDataFrame([(r["_sig"], b) for r, b in zip(big, bounds)], "_sig string, _bounds array<bigint>")
    dealt = _hash_position(groups.join(F.broadcast(plan), "_sig", "left"), ["_sig"], "_g", seed, "_i")
    by_hash = F.lit(names[-1])
    for part, end in reversed(list(zip(names[:-1], np.cumsum(others)[:-1]))):
        by_hash = F.when(hash_hex("_g", seed) < hex_cut(float(end)), part).otherwise(by_hash)
    at = F.size(F.filter("_bounds", lambda b: b <= F.col("_i")))
    part = F.when(F.col("_bounds").isNull(), by_hash).otherwise(F.element_at(F.array(*[F.lit(n) for n in names]), at + 1))
    out = spread_join(work, dealt.select("_g", part.alias("_part")), "_g", F.col(row_key))
    return out.select(*df.columns, F.col("_part").alias(name))


def balanced_group_folds(df: DataFrame, label: str, group: str, row_key: str, k: int = 5, seed: int = K.SEED,
                         name: str = "fold") -> DataFrame:
    """Fold number of whole groups, balanced in size and class mix (see ``balanced_groups``)."""
    out = balanced_groups(df, label, group, row_key, [(str(i), 1 / k) for i in range(k)], seed, name)
    return out.withColumn(name, F.col(name).cast("int"))


def split_crosstab(df: DataFrame, label: str, labels: list, split: str = "split") -> DataFrame:
    """Rows per split and class, one column per class, 0 where there are none."""
    return df.groupBy(split).pivot(label, labels).count().na.fill(0)


def pick_samples(df: DataFrame, label: str, key: str, per_class: int = K.SAMPLES_PER_CLASS,
                 seed: int = K.SEED, split: str | None = "validation") -> DataFrame:
    """Up to ``per_class`` rows of each class from one split, chosen by hash.

    The row limit is applied per task before the shuffle, so big classes stay put.
    """
    work = df.filter(F.col("split") == split) if split else df
    w = W.partitionBy(label).orderBy(hash_hex(key, seed, 32), key)
    return work.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_class).drop("_rn")


def deterministic_sample(df: DataFrame, key: str, n: int = K.MAX_EXPLAINED_ROWS, seed: int = K.SEED) -> DataFrame:
    return df.orderBy(hash_hex(key, seed, 32), key).limit(n)


def split_manifest(df: DataFrame, row_id: str = "row_id", split: str = "split") -> DataFrame:
    return df.select(F.col(row_id).alias("row_id"), F.col(split).alias("split"))
