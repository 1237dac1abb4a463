"""Incident windows and labelled replay of flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantwatch import constants as K
from plantwatch.functions.keys import hash_hex, hash_mod, hex_cut
from plantwatch.operators.ordering import ordered_index
from plantwatch.session import SMALL_TABLE_ROWS, rows_per_task


def readings_in_incidents(series: DataFrame, incidents: DataFrame, bucket: int | None = None) -> DataFrame:
    """Readings with start <= tick < start + duration of an incident on their machine.

    incidents: incident, machine, start, duration. Both sides are put into tick
    buckets, so the range test becomes an equi-join and a busy machine spreads out.
    """
    bucket = bucket or min(rows_per_task(series.sparkSession), 4096)
    last = F.col("start") + F.col("duration") - 1
    spread = (incidents.filter(F.col("duration") > 0)
              .withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / F.lit(bucket)),
                                                     F.floor(last / F.lit(bucket))))))
    rows = series.withColumn("_b", F.floor(F.col("tick") / F.lit(bucket)))
    return (rows.join(spread, ["machine", "_b"])
            .filter((F.col("tick") >= F.col("start")) & (F.col("tick") < F.col("start") + F.col("duration")))
            .drop("_b"))


def labelled_replay(series: DataFrame, incidents: DataFrame, pool: DataFrame, normal: list[str],
                    family: list[str], intensity: float = 0.8, seed: int = K.SEED) -> DataFrame:
    """Give every reading one flow of the pool.

    series: machine, tick; pool: flow_id, true_class. Inside an incident window a
    hash coin draws from the attack classes with probability ``intensity``; all other
    readings draw from the normal classes.
    """
    parts = [pool.filter(F.col("true_class").isin(*normal)).withColumn("_atk", F.lit(False)),
             pool.filter(F.col("true_class").isin(*family)).withColumn("_atk", F.lit(True))]
    numbered = [ordered_index(p, [], ["flow_id"], "_pos", by=F.col("flow_id")) for p in parts]
    benign_n, attack_n = parts[0].count(), parts[1].count()
    if not benign_n:
        raise ValueError("the flow pool has no flows of a normal class")
    if not attack_n:
        raise ValueError(f"the flow pool has no flows of {family}")
    inside = (readings_in_incidents(series.select("machine", "tick"), incidents)
              .select("machine", "tick").distinct().withColumn("in_window", F.lit(True)))
    key = F.concat_ws("-", "machine", "tick")
    drawn = (series.select("machine", "tick").join(inside, ["machine", "tick"], "left")
             .withColumn("in_window", F.coalesce("in_window", F.lit(False)))
             .withColumn("_atk", F.col("in_window") & (hash_hex(key, f"coin{seed}") < hex_cut(intensity)))
             .withColumn("_pos", hash_mod(key, f"pick{seed}", F.when(
                 F.col("_atk"), F.lit(attack_n)).otherwise(F.lit(benign_n)))))
    source = numbered[0].unionByName(numbered[1])
    if benign_n + attack_n <= SMALL_TABLE_ROWS:
        # Few flows mean few join keys with many readings each; a big pool spreads by itself.
        source = F.broadcast(source)
    return (drawn.join(source, ["_atk", "_pos"]).drop("_pos")
            .withColumnRenamed("_atk", "true_attack"))


def spread_subset(df: DataFrame, order: str, most: int = K.MAX_EXPLAINED_FLOWS) -> DataFrame:
    """At most ``most`` rows, evenly spaced over the rows in order, ends included."""
    n = df.count()
    k = min(most, n)
    if k == 0:
        return df.limit(0).withColumn("position", F.lit(0).cast("bigint"))
    wanted = sorted({(i * (n - 1)) // (k - 1) if k > 1 else 0 for i in range(k)})
    indexed = ordered_index(df, [], [order], "position", by=F.col(order))
    return indexed.filter(F.col("position").isin(wanted))
