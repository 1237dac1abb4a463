"""Validation, sources and sinks, and the streaming twins of the batch rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from plantwatch.operators import timeline as tl, training as T, validation as VA
from plantwatch.operators.metrics import metric_row
from plantwatch.plans import views as V
from plantwatch.plans.audit_queries import SPLIT
from plantwatch.plans.metric_queries import counts_sql
from plantwatch.plans.model_queries import machines
from plantwatch.plans.profile_queries import NUM
from plantwatch.plans.registry import query
from plantwatch.plans.timeline_queries import EVENT_TEXT
from plantwatch.session import fresh_path, materialise, rows_per_task
from plantwatch.sources import artifacts as A, tables as S
from plantwatch.streaming import streams as ST

READINGS = """readings as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice*100) as bigint)) as row_id,
  case l_returnflag when 'A' then 'L' when 'N' then 'M' else 'X' end as "Type",
  case when l_orderkey % 97 = 0 then null else 265 + l_quantity * 1.25::double end as air,
  290 + l_quantity::double as process, l_extendedprice / 30 as speed, l_quantity * 2.1::double as torque,
  l_discount * 2800 as wear from lineitem)"""
BOUNDS = {"Air temperature": "air", "Process temperature": "process", "Rotational speed": "speed",
          "Torque": "torque", "Tool wear": "wear"}


def readings(spark, sf):
    """Machine readings from lineitem; some are missing, out of range or of an unknown type."""
    q = F.col("l_quantity")
    return V.table(spark, sf, "lineitem").select(
        V.line_id().alias("row_id"),
        F.when(F.col("l_returnflag") == "A", "L").when(F.col("l_returnflag") == "N", "M").otherwise("X").alias("Type"),
        F.when(F.col("l_orderkey") % 97 == 0, F.lit(float("nan"))).otherwise(265 + q * F.lit(1.25)).alias("Air temperature"),
        (q + 290).alias("Process temperature"), (F.col("l_extendedprice") / 30).alias("Rotational speed"),
        (q * F.lit(2.1)).alias("Torque"), (F.col("l_discount") * 2800).alias("Tool wear"))


def reasons_sql() -> str:
    from plantwatch.constants import MACHINE_BOUNDS
    cases = ["case when \"Type\" not in ('L', 'M', 'H') then 'domain:Type' end"]
    cases += [f"case when {c} is null then 'finite:{n}' end" for n, c in BOUNDS.items()]
    cases += [f"case when {BOUNDS[n]} < {lo}::double or {BOUNDS[n]} > {hi}::double then 'range:{n}' end"
              for n, (lo, hi) in MACHINE_BOUNDS.items()]
    return "concat_ws('; ', " + ", ".join(cases) + ")"


QUARANTINE = V.with_views(READINGS) + f"select row_id, {reasons_sql()} as reasons, {reasons_sql()} = '' as valid from readings"


@query("quarantine", QUARANTINE)
def quarantine(spark, sf):
    out = VA.with_reasons(readings(spark, sf), VA.machine_rules("row_id"))
    return out.select("row_id", F.array_join("reasons", "; ").alias("reasons"), (F.size("reasons") == 0).alias("valid"))


@query("flow_quarantine", """select event_id, concat_ws('; ', case when abs(value * power(10::double, event_id % 13)) > 1e12::double then 'magnitude:value' end) as reasons from events""")
def flow_quarantine(spark, sf):
    ev = V.table(spark, sf, "events").select("event_id", (F.col("value") * F.pow(F.lit(10.0), F.col("event_id") % 13)).alias("value"))
    out = VA.with_reasons(ev, VA.flow_rules(["value"], "event_id"))
    return out.select("event_id", F.array_join("reasons", "; ").alias("reasons"))


@query("csv_round_trip", "select p_partkey, p_name, case when p_size % 5 = 0 then null else p_size end as p_size, p_retailprice from part")
def csv_round_trip(spark, sf):
    part = V.table(spark, sf, "part").select(
        "p_partkey", "p_name", F.when(F.col("p_size") % 5 == 0, "NA").otherwise(F.col("p_size").cast("string")).alias("p_size"),
        "p_retailprice")
    return S.read_csv(spark, A.write_table(part, "part", fmt="csv"),
                      "p_partkey bigint, p_name string, p_size int, p_retailprice double")


@query("aligned_tables", """select doc_id, lang, source, n_chars, quality, toxic,
  case when d.doc_id is null then 'right' when l.doc_id is null then 'left' else 'both' end as side
  from documents d full join labels l using (doc_id)""")
def aligned_tables(spark, sf):
    """All documents and all labels side by side; ``side`` reports the rows that lack a partner."""
    return S.align_by_key(V.table(spark, sf, "documents").drop("text"), V.table(spark, sf, "labels"), "doc_id", unmatched="report")


@query("positional_alignment", "select row_number() over (order by c_custkey) - 1 as row_id, c_custkey, c_acctbal, c_mktsegment from customer")
def positional_alignment(spark, sf):
    """Features and targets as two headed CSV files in the same order, put together by position."""
    ordered = V.table(spark, sf, "customer").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    left = A.write_table(ordered.select("c_custkey", "c_acctbal"), "features", fmt="csv")
    right = A.write_table(ordered.select("c_mktsegment"), "targets", fmt="csv")
    return S.align_by_position(S.read_csv(spark, left, "c_custkey bigint, c_acctbal double"),
                               S.read_csv(spark, right, "c_mktsegment string"))


@query("sequential_row_id", "select row_number() over (order by ts, event_id) - 1 as row_id, event_id from events")
def sequential_row_id(spark, sf):
    ev = V.table(spark, sf, "events").select("ts", "event_id")
    return S.dense_row_id(ev, ["ts", "event_id"], F.unix_timestamp(F.col("ts").cast("timestamp"))).drop("ts")


@query("split_manifest", "select event_id as row_id, case when substr(md5(event_id || ':42'), 1, 8) < 'a3d70a3d' then 'train' "
       "when substr(md5(event_id || ':42'), 1, 8) < 'cccccccc' then 'validation' else 'test' end as split from events")
def split_manifest(spark, sf):
    from plantwatch.operators.splits import hash_split, split_manifest as manifest
    path = fresh_path(spark, "modelling")
    S.write_splits(hash_split(V.table(spark, sf, "events"), "event_id"), path)
    return manifest(spark.read.parquet(path), "event_id")


METRICS = V.with_views(V.SCORED) + f"select l_returnflag, tn, fp, fn, tp from (select l_returnflag, {counts_sql('score >= 0.5::double')} from scored group by 1)"


def metrics(spark, sf):
    return metric_row(V.scored(spark, sf), "y", "score", keys=["l_returnflag"])


@query("metadata_round_trip", METRICS)
def metadata_round_trip(spark, sf):
    nested = metrics(spark, sf).select("l_returnflag", F.struct("tn", "fp", "fn", "tp").alias("counts"))
    path = A.write_metadata(nested, "metadata")
    back = A.read_metadata(spark, path, "l_returnflag string, counts struct<tn:bigint,fp:bigint,fn:bigint,tp:bigint>")
    return back.select("l_returnflag", "counts.*")


@query("text_report", V.with_views(V.SCORED) + f"""select l_returnflag || ': TN=' || tn || ' FP=' || fp || ' FN=' || fn || ' TP=' || tp as value
  from (select l_returnflag, {counts_sql('score >= 0.5::double')} from scored group by 1)""")
def text_report(spark, sf):
    line = F.format_string("%s: TN=%d FP=%d FN=%d TP=%d", "l_returnflag", "tn", "fp", "fn", "tp")
    return spark.read.text(A.write_report(metrics(spark, sf), line, "report"))


@query("artifact_manifest")
def artifact_manifest(spark, sf):
    root = fresh_path(spark, "artifacts")
    table = metrics(spark, sf)
    table.write.csv(f"{root}/table", header=True)
    table.write.json(f"{root}/metadata")
    return A.artifact_manifest(spark, root, "part-*")


VALIDATION_ROWS = V.with_views(V.SCORED, "s as (select *, " + SPLIT.format(key="row_id") + " as split from scored)")


@query("stored_model", VALIDATION_ROWS + "select row_id, true as same from s where split = 'validation'")
def stored_model(spark, sf):
    """Whether a stored and reloaded model gives each row the score it had before."""
    df = machines(spark, sf)
    det = T.fit_logistic(df.filter("split = 'train'"), "y", NUM)
    path = fresh_path(spark, "model")
    det.save(spark, path)
    val = df.filter("split = 'validation'")
    out = T.load_detector(path).score(det.score(val, "before"), "after")
    return out.select("row_id", (F.col("before") == F.col("after")).alias("same"))


@query("stream_quarantine", QUARANTINE)
def stream_quarantine(spark, sf):
    src = A.write_table(readings(spark, sf), "readings")
    schema = spark.read.parquet(src).schema
    valid, rejected = fresh_path(spark, "valid"), fresh_path(spark, "rejected")
    ST.quarantine_stream(ST.read_stream(spark, src, schema), VA.machine_rules("row_id"), valid, rejected)
    ok = ST.read_batches(spark, valid).select("row_id", F.lit("").alias("reasons"), F.lit(True).alias("valid"))
    bad = ST.read_batches(spark, rejected).select("row_id", F.array_join("reasons", "; ").alias("reasons"),
                                                  F.lit(False).alias("valid"))
    return ok.unionByName(bad)


@query("stream_score", VALIDATION_ROWS + "select row_id, true as same from s")
def stream_score(spark, sf):
    """Whether the stream gives each row the score and tier that the batch gives it."""
    df = machines(spark, sf)
    det = T.fit_logistic(df.filter("split = 'train'"), "y", NUM)
    src = A.write_table(df, "machines")
    out = fresh_path(spark, "scored")
    columns = ["row_id", "attack_probability", "attack", "classification", "risk_level"]
    ST.run_available(ST.score_stream(ST.read_stream(spark, src, df.schema), det).select(*columns), out)
    twin = ST.score_stream(spark.read.parquet(src), det).select(
        "row_id", F.struct(*columns[1:]).alias("batch"))
    both = spark.read.parquet(out).select("row_id", F.struct(*columns[1:]).alias("stream")).join(twin, "row_id", "full")
    return both.select("row_id", F.coalesce(F.col("batch") == F.col("stream"), F.lit(False)).alias("same"))


def feed(df, label: str, by, late=None, close: bool = False, slices: int = 4):
    """Rows as files that a stream reads in time order, a slice a batch; returns (path, schema, files per batch).

    ``late`` rows come after all others. ``close`` ends with a row that has a time only, long after the rest, so that
    the watermark passes every row.
    """
    df = materialise(df.withColumn("_by", by), label)
    return sliced(df, df.approxQuantile("_by", shares(slices), 0.01), late, close)


def shares(slices: int) -> list[float]:
    return [i / slices for i in range(1, slices)]


def sliced(df, cuts: list[float], late=None, close: bool = False, end_of=None):
    """Rows with ``_by`` as a feed whose slices end at the cuts; ``end_of`` gives the time of a cut, and a slice then ends with rows of that time only."""
    spark = df.sparkSession
    files = 1 + df.count() // ((len(cuts) + 1) * rows_per_task(spark))
    path = fresh_path(spark, "feed")
    parts = []
    # As many rows of a time only as files: every slice is one batch, however few rows it has.
    only = lambda ts: df.limit(0).unionByName(ts.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(files)))).drop("_n"), allowMissingColumns=True)
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = df.filter((F.lit(True) if lo is None else F.col("_by") > lo) & (F.lit(True) if hi is None else F.col("_by") <= hi))
        parts.append(part if end_of is None or hi is None else part.unionByName(only(spark.range(1).select(end_of(F.lit(hi)).alias("ts")))))
    if late is not None:
        parts.append(df.filter(late))
    if close:
        parts.append(only(df.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 2 days")).alias("ts"))))
    for part in parts:
        part.drop("_by").repartition(files).write.mode("append").parquet(path)
    return path, StructType(df.drop("_by").schema.fields), files


def flow_feed(spark, sf, **options):
    """Flows by event time; every 20th flow of the first day comes once more after the last one, far too late."""
    rows = V.flow_rows(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    first = rows.agg(F.min(F.unix_timestamp("ts"))).scalar()
    rows = rows.withColumn("first_day", F.unix_timestamp("ts") < first + 86_400)
    return feed(rows, "flows", F.unix_timestamp("ts"), F.col("first_day") & (F.col("event_id") % 20 == 0), **options)


def read_feed(spark, source):
    path, schema, files = source
    return ST.read_stream(spark, path, schema, files_per_batch=files)


def state_partitions(spark) -> int:
    """Partitions of the state of an order rule: each is loaded and committed in every batch, however few rows it has."""
    return 2 * spark.sparkContext.defaultParallelism


@query("stream_debounce", V.with_views(V.FLOW, V.CONFIRM) + "select machine, event_id, n_flagged, n_seen, confirmed from conf")
def stream_debounce(spark, sf):
    out = fresh_path(spark, "debounced")
    ST.run_available(ST.debounce_stream(read_feed(spark, flow_feed(spark, sf, close=True))), out, partitions=state_partitions(spark))
    return spark.read.parquet(out).select("machine", "event_id", "n_flagged", "n_seen", "confirmed")


def tick_time(tick):
    return F.timestamp_seconds(tick * 120 + 1_704_067_200)


def at_tick(df):
    return df.withColumn("ts", tick_time(F.col("tick")))


def tick_feed(spark, df, label):
    """Rows with ticks by event time; the rows of tick 0 come once more after the last tick."""
    return feed(at_tick(df), label, F.col("tick"), F.col("tick") == 0, close=True)


#: Most rows of both sides of a join in one batch, in tasks' worth: what the state holds at a time.
BATCH_TASKS = 2


def paired_feeds(spark, frames: dict, slices: int = 4) -> list:
    """Feeds whose slices end at the same times, also where one of them has no row left; at least ``slices`` of them.

    The watermark of a join is that of its slower side, so what one side is ahead of the other waits in the state.
    """
    kept = [materialise(at_tick(df).withColumn("_by", F.col("tick")), label) for label, df in frames.items()]
    both = reduce(DataFrame.unionByName, [df.select("_by") for df in kept])
    slices = max(slices, -(-both.count() // (BATCH_TASKS * rows_per_task(spark))))
    cuts = both.approxQuantile("_by", shares(slices), 0.1 / slices)
    return [sliced(df, cuts, F.col("tick") == 0, close=True, end_of=tick_time) for df in kept]


@query("stream_events", V.TIMELINE_SQL + f"select tick, machine, level, {EVENT_TEXT} as text from line where level <> prev_level")
def stream_events(spark, sf):
    series = tl.align(V.telemetry(spark, sf), V.flows(spark, sf)).select("machine", "tick", "p", "attack_p", "flagged")
    out = fresh_path(spark, "events")
    stream = read_feed(spark, tick_feed(spark, series, "series"))
    ST.run_available(ST.event_stream(stream, primary=V.PRIMARY, early=V.EARLY), out, partitions=state_partitions(spark))
    return spark.read.parquet(out)


@query("stream_join", V.with_views(V.SCORED, V.TEL, V.FLOW) + """select machine, tick, t.p, coalesce(f.flagged, false) as flagged, f.event_id
  from tel t full join flow f using (machine, tick)""")
def stream_join(spark, sf):
    a, b = paired_feeds(spark, {"telemetry": V.telemetry(spark, sf),
                                "flows": V.flows(spark, sf).select("machine", "tick", "flagged", "event_id")})
    out = fresh_path(spark, "joined")
    ST.run_available(ST.join_stream(read_feed(spark, a), read_feed(spark, b)), out, store=ST.MEMORY,
                     partitions=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(out).filter(F.col("machine").isNotNull()).select(
        "machine", "tick", "p", F.coalesce("flagged", F.lit(False)).alias("flagged"), "event_id")


@query("stream_kpis", V.with_views(V.FLOW) + """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, machine,
  cast(sum(case when flagged then 1 else 0 end) as bigint) as flagged, count(*) as flows, max(attack_p) as peak from flow group by 1, 2""")
def stream_kpis(spark, sf):
    out = fresh_path(spark, "kpis")
    ST.kpi_stream(read_feed(spark, flow_feed(spark, sf)), out)
    return ST.latest_kpis(spark, out).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "machine", "flagged", "flows", "peak")
