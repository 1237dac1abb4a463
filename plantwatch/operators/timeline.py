"""Alert timeline: score -> status -> debounce -> fuse, then events, KPIs and views.

Series are keyed by (machine, tick); ticks may have gaps. Windows run over chunks of
row positions (see ordering.tick_chunks), so one busy machine is still many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plantwatch import constants as K
from plantwatch.functions import expressions as X
from plantwatch.operators.ordering import tick_chunks
from plantwatch.session import rows_per_task

KEY = ["machine", "tick"]


def trailing_flags(flows: DataFrame, flag: str = "flagged", window: int = K.CONFIRM_WINDOW,
                   count: int = K.CONFIRM_COUNT) -> DataFrame:
    """Add n_flagged and n_seen over the last rows of the machine, and confirmed."""
    w = W.partitionBy("machine", "_chunk").orderBy("tick").rowsBetween(1 - window, 0)
    return (tick_chunks(flows, "tick", window - 1)
            .withColumns({
                "n_flagged": F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).over(w),
                "n_seen": F.count(F.lit(1)).over(w)})
            .filter(~F.col("_halo")).drop("_chunk", "_halo")
            .withColumn("confirmed", F.col("n_flagged") >= count))


def align(telemetry: DataFrame, flows: DataFrame | None, how: str = "full") -> DataFrame:
    """Put the flow of the same machine and tick next to each reading.

    Every reading and every flow is kept: a tick without a flow is not flagged, a tick
    without a reading has no probability and counts as healthy. Without flows the result is machine-only: nothing is flagged and the network
    columns are absent.
    """
    if flows is None:
        return telemetry.withColumn("flagged", F.lit(False))
    return telemetry.join(flows, KEY, how)


def build_timeline(telemetry: DataFrame, flows: DataFrame | None, how: str = "full",
                   primary: float = K.PRIMARY_THRESHOLD, early: float = K.EARLY_WARNING_THRESHOLD,
                   window: int = K.CONFIRM_WINDOW, count: int = K.CONFIRM_COUNT) -> DataFrame:
    """One row per (machine, tick) with status, debounced attack, level, reason and change.

    telemetry: machine, tick, p [, drivers: array<struct<feature, shap>>]
    flows:     machine, tick, flagged, attack_p, true_class, true_attack (optional)

    ``prev_level`` is the level of the machine one tick earlier (OK at the start).
    Debounce and level change share one shuffle: the overlap covers both look-backs. Rows are counted
    before the join, which is the work of the whole plan.
    """
    joined = align(telemetry, flows, how)
    recent = W.partitionBy("machine", "_chunk").orderBy("tick").rowsBetween(1 - window, 0)
    step = W.partitionBy("machine", "_chunk").orderBy("tick")
    out = (tick_chunks(joined, "tick", window, counted=[telemetry] if flows is None else [telemetry.select("machine"), flows.select("machine")])
           .withColumn("status", X.machine_status("p", primary, early))
           .withColumn("n_flagged", F.sum(F.coalesce("flagged", F.lit(False)).cast("int")).over(recent))
           .withColumn("n_seen", (F.count("flagged") if flows is not None else F.count(F.lit(1))).over(recent))
           .withColumn("confirmed", (F.col("n_flagged") >= count) if flows is not None else F.lit(False))
           .withColumn("level", X.fuse("status", "confirmed"))
           .withColumn("prev_level", F.lag("level", 1, "OK").over(step))
           .filter(~F.col("_halo")).drop("_chunk", "_halo")
           .withColumn("severity", X.severity("level"))
           .withColumn("reason", X.explain_fusion("level", "status", "p", "n_flagged", "n_seen"))
           .withColumn("p", F.round("p", 5)))
    if flows is not None:
        out = out.withColumn("attack_p", F.round("attack_p", 5))
    return out


def machine_name(machine: Column | str) -> Column:
    return F.concat(F.lit("CNC-"), (X.as_col(machine) + 1).cast("string"))


def level_events(timeline: DataFrame) -> DataFrame:
    """A row whenever the level of a machine differs from the tick before."""
    name = machine_name("machine")
    text = F.concat(name, F.lit(" "), F.col("level"), F.lit(": "), F.col("reason"))
    if "drivers" in timeline.columns:
        top = F.try_element_at(F.col("drivers"), F.lit(1))["feature"]
        text = F.concat(text, F.when(F.col("level").isin("ALARM", "CRITICAL") & top.isNotNull(),
                                     F.concat(F.lit(" Top driver: "), top, F.lit("."))).otherwise(""))
    return (timeline.filter(F.col("level") != F.col("prev_level"))
            .select("tick", "machine", F.col("level"),
                    F.when(F.col("level") == "OK", F.concat(name, F.lit(" returned to OK")))
                    .otherwise(text).alias("text")))


def incident_log(events: DataFrame) -> DataFrame:
    """Export form of the events: clock text, machine name, level, text."""
    return events.select(X.clock_text("tick").alias("time"), machine_name("machine").alias("machine"),
                         "level", "text")


def timeline_kpis(timeline: DataFrame, net_on: bool = True) -> DataFrame:
    """Peak probability, machines at high risk, critical ticks and flow counts, in one row."""
    count_if = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    aggs = [F.max("p").alias("peak_failure_probability"),
            F.count_distinct(F.when(F.col("status") == "HIGH RISK", F.col("machine"))
                             ).alias("machines_with_alarm")]
    if net_on:
        hit, miss = F.col("true_attack"), ~F.col("true_attack")
        aggs += [count_if(hit).alias("attack_flows"),
                 count_if(hit & F.col("flagged")).alias("attack_flows_flagged"),
                 count_if(miss).alias("benign_flows"),
                 count_if(miss & F.col("flagged")).alias("benign_flows_flagged"),
                 count_if(F.col("level") == "CRITICAL").alias("critical_ticks")]
    return timeline.agg(*aggs)


def reaction_times(timeline: DataFrame, incidents: DataFrame) -> DataFrame:
    """First reaction and first confirmed alert at or after the start of each incident.

    incidents: incident, machine, start. Starts and reactions are merged into one
    series per machine and chunk, where a look-ahead minimum finds the next
    reaction; a small table of chunk minima covers what lies beyond the chunk.
    """
    size = rows_per_task(timeline.sparkSession)
    none = F.lit(None)
    marks = (timeline.filter((F.col("status") != "NORMAL") | F.col("confirmed"))
             .select("machine", "tick", none.cast("string").alias("incident"),
                     F.when(F.col("status") != "NORMAL", F.col("tick")).alias("r"),
                     F.when(F.col("confirmed"), F.col("tick")).alias("c")))
    starts = incidents.select("machine", F.col("start").cast("bigint").alias("tick"),
                              F.col("incident").cast("string"), none.cast("bigint").alias("r"),
                              none.cast("bigint").alias("c"))
    series = marks.unionByName(starts).withColumn("_c", F.floor(F.col("tick") / F.lit(size)))
    later = W.partitionBy("machine").orderBy("_c").rowsBetween(1, W.unboundedFollowing)
    beyond = (series.groupBy("machine", "_c").agg(F.min("r").alias("r"), F.min("c").alias("c"))
              .select("machine", "_c", F.min("r").over(later).alias("far_r"),
                      F.min("c").over(later).alias("far_c")))
    # Looking back along falling ticks keeps a running minimum; a frame that looks ahead is summed anew for each row.
    ahead = W.partitionBy("machine", "_c").orderBy(F.desc("tick")).rangeBetween(W.unboundedPreceding, W.currentRow)
    near = (series.withColumns({"near_r": F.min("r").over(ahead), "near_c": F.min("c").over(ahead)})
            .filter(F.col("incident").isNotNull()))
    r, c = F.coalesce("near_r", "far_r"), F.coalesce("near_c", "far_c")
    return near.join(beyond, ["machine", "_c"]).select(
        "incident", "machine", F.col("tick").alias("start"),
        r.alias("first_reaction_tick"), (r - F.col("tick")).alias("lead_time_ticks"),
        c.alias("first_confirmed_tick"), (c - F.col("tick")).alias("detection_delay_ticks"))


def worst_moments(timeline: DataFrame) -> DataFrame:
    """Most severe tick per machine: by level, then probability, then earliest."""
    rank = F.struct("severity", "p", (-F.col("tick")).alias("early"))
    return (timeline.groupBy("machine").agg(F.max(rank).alias("top"))
            .select("machine", (-F.col("top.early")).alias("tick"),
                    F.col("top.severity").alias("severity"), F.col("top.p").alias("p")))


def level_grid(timeline: DataFrame, width: int = 10) -> DataFrame:
    """Severity grid: one row per tick and block of ``width`` machines, one column each.

    Blocks keep the row narrow however many machines there are; none is left out.
    """
    cell = timeline.select("tick", F.floor(F.col("machine") / width).alias("block"),
                           F.pmod("machine", F.lit(width)).cast("int").alias("m"), "severity")
    grid = cell.groupBy("tick", "block").pivot("m", list(range(width))).agg(F.max("severity"))
    return grid.withColumnsRenamed({str(i): f"m{i}" for i in range(width)})


def asset_peaks(timeline: DataFrame) -> DataFrame:
    """Machines by highest severity * 10 + probability; the first row is the riskiest."""
    score = F.col("severity") * 10 + F.coalesce("p", F.lit(0.0))
    return (timeline.groupBy("machine").agg(F.round(F.max(score), 5).alias("peak"))
            .orderBy(F.desc("peak"), "machine"))


def log_until(events: DataFrame, tick: int) -> DataFrame:
    """Events up to a tick, newest first."""
    return events.filter(F.col("tick") <= tick).orderBy(F.desc("tick"), F.desc("machine"))


def flags_per_tick(flows: DataFrame, flag: str = "flagged") -> DataFrame:
    return flows.groupBy("tick").agg(F.sum(F.col(flag).cast("bigint")).alias("flagged"),
                                     F.count(F.lit(1)).alias("flows"))


def site_status(timeline: DataFrame) -> DataFrame:
    """Worst level per tick and how many machines share it (0 when all are OK)."""
    per_level = timeline.groupBy("tick", "severity").agg(F.count(F.lit(1)).alias("n"))
    worst = per_level.groupBy("tick").agg(F.max(F.struct("severity", "n")).alias("w"))
    names = F.array(*[F.lit(x) for x in K.LEVELS])
    return worst.select(
        "tick", F.col("w.severity").alias("severity"),
        F.element_at(names, F.col("w.severity") + 1).alias("level"),
        F.when(F.col("w.severity") > 0, F.col("w.n")).otherwise(F.lit(0)).cast("bigint").alias("machines"))


def history_until(timeline: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Probability series of each machine up to its cut-off tick, with the running peak.

    cutoffs: machine, tick. The cut-offs are spread over the chunks of the series,
    so a long series meets its cut-off in many tasks. The running peak restarts from
    the peak of the chunks before.
    """
    size = rows_per_task(timeline.sparkSession)
    cut = cutoffs.select("machine", F.col("tick").alias("cutoff")).withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("cutoff") / F.lit(size)))))
    rows = timeline.select("machine", "tick", "p", F.floor(F.col("tick") / F.lit(size)).alias("_c"))
    kept = rows.join(cut, ["machine", "_c"]).filter(F.col("tick") <= F.col("cutoff"))
    peaks = kept.groupBy("machine", "_c").agg(F.max("p").alias("m"))
    before = W.partitionBy("machine").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    peaks = peaks.select("machine", "_c", F.max("m").over(before).alias("peak_before"))
    run = W.partitionBy("machine", "_c").orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    return (kept.join(peaks, ["machine", "_c"])
            .select("machine", "tick", "p",
                    F.greatest(F.col("peak_before"), F.max("p").over(run)).alias("peak_so_far")))
