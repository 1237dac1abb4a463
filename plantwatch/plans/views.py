"""Views over the input tables that play the part of telemetry, flows and scores.

Each view exists twice: as a DataFrame and as the same view in SQL text, from
which the checking queries are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantwatch.functions.expressions import at_least
from plantwatch.operators.ordering import ordered_index

PRIMARY, EARLY = 0.77, 0.50
NORMAL_EVENTS = ["click", "view", "purchase", "signup"]
EVENT_FAMILIES = {"errors": ["error"], "conversions": ["purchase", "signup"]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_id():
    """Key of an order line; the price tells apart the few lines that share all keys."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       F.round(F.col("l_extendedprice") * 100).cast("bigint"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Score with many ties and a correlated 0/1 label."""
    s = F.round(F.lit(0.7) * F.col("l_quantity") / 50 + F.lit(0.3) * F.col("l_tax") / F.lit(0.08), 6)
    return table(spark, sf, "lineitem").select(
        line_id().alias("row_id"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", s.alias("score"),
        (F.col("l_quantity") + F.col("l_orderkey") % 20 > 35).cast("int").alias("y"))


SCORED = """scored as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice*100) as bigint)) as row_id,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus, l_shipdate,
  round(cast(0.7 as double)*l_quantity/50 + cast(0.3 as double)*l_tax/cast(0.08 as double), 6) as score,
  case when l_quantity + (l_orderkey % 20) > 35 then 1 else 0 end as y from lineitem)"""


def dup_items(spark: SparkSession, sf: str) -> DataFrame:
    """Small-domain feature vectors, so many duplicates, with a label that conflicts."""
    return table(spark, sf, "lineitem").select(
        line_id().alias("row_id"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"),
        "l_linestatus", "l_linenumber", F.col("l_returnflag").alias("label"))


DUP_FEATURES = ["qty", "disc", "tax", "l_linestatus", "l_linenumber"]
DUP = """dup as (select *, md5(concat_ws('|;', qty, disc, tax, l_linestatus, l_linenumber)) as gid from (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice*100) as bigint)) as row_id,
  cast(l_quantity as bigint) as qty, cast(round(l_discount*100) as bigint) as disc,
  cast(round(l_tax*100) as bigint) as tax, l_linestatus, l_linenumber, l_returnflag as label from lineitem))"""


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Machine = supplier, tick = order of shipment, p = score."""
    base = scored(spark, sf).select(
        F.col("l_suppkey").alias("machine"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        F.col("score").alias("p"))
    days = F.datediff(F.col("l_shipdate"), F.lit("1970-01-01"))
    return (ordered_index(base, ["machine"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"],
                          "tick", by=days)
            .select("machine", "tick", "p"))


TEL = """tel as (select l_suppkey as machine, row_number() over (partition by l_suppkey
  order by l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 as tick, score as p from scored)"""


def flow_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Network flows without ticks: class, attack score, decision and truth."""
    attack_p = F.col("value") / (F.col("value") + 50)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("machine"), "event_id", "ts", F.col("event_type").alias("true_class"),
        attack_p.alias("attack_p"), at_least(attack_p, 0.5).alias("flagged"),
        (F.col("event_type") == "error").alias("true_attack"))


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Machine = user, tick = order of event."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return ordered_index(flow_rows(spark, sf), ["machine"], ["ts", "event_id"], "tick", by=seconds)


FLOW = """flow as (select user_id as machine, row_number() over (partition by user_id order by ts, event_id) - 1 as tick,
  event_id, ts, event_type as true_class, value/(value + 50) as attack_p,
  value/(value + 50) >= cast(0.5 as double) as flagged, event_type = 'error' as true_attack from events)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """64 numeric features, family label 0-9, binary target, hash-based split."""
    from plantwatch.operators.splits import hash_split
    base = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)],
        (F.col("label") >= 5).cast("int").alias("y"))
    return hash_split(base, "row_id")


FEATURES = [f"f{i}" for i in range(64)]
FEAT = "feat as (select vec_id as row_id, label, " + ", ".join(
    f"cast(embedding[{i + 1}] as double) as f{i}" for i in range(64)
) + ", case when label >= 5 then 1 else 0 end as y from embeddings)"

CONFIRM = """conf as (select *, n_flagged >= 2 as confirmed from (select *,
  cast(sum(case when flagged then 1 else 0 end) over w as bigint) as n_flagged, count(*) over w as n_seen
  from flow window w as (partition by machine order by tick rows between 2 preceding and current row)))"""

LINE = """line as (select *, case level when 'CRITICAL' then 'Machine is ' || lower(status) || ' (' || pct ||
    ' failure probability) AND ' || n_flagged || '/' || n_seen ||
    ' recent flows were classified as attacks: possible cyber-physical incident.'
  when 'NETWORK ALERT' then n_flagged || '/' || n_seen || ' recent flows classified as attacks; machine health is normal.'
  when 'ALARM' then 'Failure probability ' || pct || ' is above the primary threshold.'
  when 'WARNING' then 'Failure probability ' || pct || ' is above the early-warning threshold.'
  else 'No warning from either model.' end as reason,
  lag(level, 1, 'OK') over (partition by machine order by tick) as prev_level,
  cast(case level when 'OK' then 0 when 'WARNING' then 1 when 'NETWORK ALERT' then 2 when 'ALARM' then 3 else 4 end as int) as severity
  from (select *, (t10 // 10) || '.' || (t10 % 10) || '%' as pct,
    case when confirmed and status <> 'NORMAL' then 'CRITICAL' when confirmed then 'NETWORK ALERT'
      when status = 'HIGH RISK' then 'ALARM' when status = 'EARLY WARNING' then 'WARNING' else 'OK' end as level
    from (select *, n_flagged >= 2 as confirmed from (select machine, tick, round(t.p, 5) as p, cast(round(t.p*1000) as bigint) as t10,
      case when t.p >= cast(0.77 as double) then 'HIGH RISK' when t.p >= cast(0.5 as double) then 'EARLY WARNING' else 'NORMAL' end as status,
      c.event_id, c.true_class, c.true_attack, c.flagged, round(c.attack_p, 5) as attack_p,
      cast(sum(case when c.flagged then 1 else 0 end) over w as bigint) as n_flagged, count(c.flagged) over w as n_seen
      from tel t full join flow c using (machine, tick)
      window w as (partition by machine order by tick rows between 2 preceding and current row)))))"""


def with_views(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


TIMELINE_SQL = with_views(SCORED, TEL, FLOW, CONFIRM, LINE)
