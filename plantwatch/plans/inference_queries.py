"""Batch inference, explanation and the scored timeline, with detectors of fixed coefficients that SQL recomputes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch import api
from plantwatch.operators import timeline as tl, validation as VA
from plantwatch.operators.ordering import ordered_index
from plantwatch.operators.training import linear_detector
from plantwatch.plans import views as V
from plantwatch.plans.profile_queries import rounded
from plantwatch.plans.registry import query
from plantwatch.plans.stream_queries import BOUNDS, READINGS, readings, reasons_sql
from plantwatch.plans.timeline_queries import EVENT_TEXT

MACHINE_WEIGHTS = {"Air temperature": 0.04, "Process temperature": 0.03, "Rotational speed": -0.0011, "Torque": 0.035, "Tool wear": 0.013}
MACHINE_MEANS = {"Air temperature": 296.0, "Process temperature": 315.0, "Rotational speed": 1200.0, "Torque": 52.0, "Tool wear": 140.0}
INTERCEPT = -23.0
FLOW_WEIGHTS, FLOW_INTERCEPT = {"value": 0.02, "root": -0.1}, -0.4


def machine_detector():
    return linear_detector(MACHINE_WEIGHTS, INTERCEPT, MACHINE_MEANS, ["Type"])


def flow_detector():
    return linear_detector(FLOW_WEIGHTS, FLOW_INTERCEPT, {"value": 50.0, "root": 7.0})


def valid_readings(spark, sf):
    """Readings without a violation: what the strict mode accepts."""
    return VA.split_valid(VA.with_reasons(readings(spark, sf), VA.machine_rules("row_id")))[0]


def _odds(weights: dict, intercept: float, names: dict) -> str:
    return f"{intercept}::double" + "".join(f" + ({w})::double * {names[c]}" for c, w in weights.items())


PLAIN = {c: c for c in FLOW_WEIGHTS}
SCORED_READINGS = f"""valid as (select * from readings where {reasons_sql()} = ''),
  pred as (select *, 1 / (1 + exp(-({_odds(MACHINE_WEIGHTS, INTERCEPT, BOUNDS)}))) as prob from valid)"""
FLOW_PRED = f"""fl as (select *, sqrt(value) as root from events),
  fp as (select *, 1 / (1 + exp(-({_odds(FLOW_WEIGHTS, FLOW_INTERCEPT, PLAIN)}))) as prob from fl)"""
STATUS = "case when prob >= 0.77::double then 'HIGH RISK' when prob >= 0.07::double then 'EARLY WARNING' else 'NORMAL' end"


@query("predict_machine_batch", V.with_views(READINGS, SCORED_READINGS) + f"""select row_id, round(prob, 9) as failure_probability,
  prob >= 0.77::double as primary_failure, prob >= 0.07::double as early_warning, {STATUS} as status from pred""")
def predict_machine_batch(spark, sf):
    return rounded(api.predict_ai4i_batch(valid_readings(spark, sf), machine_detector()), ["failure_probability"], 9)


def flow_batch(spark, sf):
    return V.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "value", F.sqrt("value").alias("root"))


@query("predict_flow_batch", V.with_views(FLOW_PRED) + """select event_id as row_id, round(prob, 9) as attack_probability, prob >= 0.5::double as attack,
  case when prob >= 0.5::double then 'ATTACK' else 'NORMAL' end as classification,
  case when prob >= 0.8::double then 'HIGH RISK' when prob >= 0.5::double then 'MEDIUM RISK' else 'LOW RISK' end as risk_level from fp""")
def predict_flow_batch(spark, sf):
    return rounded(api.predict_rt_iot2022_batch(flow_batch(spark, sf), flow_detector()), ["attack_probability"], 9)


def refusal(batch) -> str:
    try:
        api.predict_ai4i_batch(batch, machine_detector())
    except ValueError as e:
        return str(e)
    return "accepted"


@query("refused_batches", V.with_views(READINGS) + """select 'all' as batch, 'AI4I: row ' || min(row_id) || ': ''Type'' must be one of [''L'', ''M'', ''H''], got ''X' || chr(39) as message
    from readings where "Type" = 'X'
  union all select 'typed', 'AI4I: row ' || min(row_id) || ': ''Air temperature'' is NaN or infinite' from readings where "Type" <> 'X' and air is null
  union all select 'empty', 'AI4I: empty batch' union all select 'valid', 'accepted'""")
def refused_batches(spark, sf):
    """What the strict mode says to four batches: one of each kind of refusal, and one that passes."""
    rows = readings(spark, sf)
    batches = {"all": rows, "typed": rows.filter("Type <> 'X'"), "empty": rows.filter("false"), "valid": valid_readings(spark, sf)}
    return spark.createDataFrame([(k, refusal(b)) for k, b in batches.items()], "batch string, message string")


def contributions_sql(source: str, key: str, weights: dict, means: dict, names: dict) -> str:
    return " union all ".join(f"select {key} as row_id, '{c}' as feature, ({w})::double * ({names[c]} - ({means[c]})::double) as shap from {source}"
                              for c, w in weights.items())


RANKED = "ranked as (select *, row_number() over (partition by row_id order by abs(shap) desc, feature) as rn from lin)"
MACHINE_LIN = f"lin as ({contributions_sql('pred', 'row_id', MACHINE_WEIGHTS, MACHINE_MEANS, BOUNDS)}), {RANKED}"
FLOW_LIN = f"lin as ({contributions_sql('fp', 'event_id', FLOW_WEIGHTS, {'value': 50.0, 'root': 7.0}, PLAIN)}), {RANKED}"
TOP_SQL = "select row_id, 'log-odds' as output_space, cast(rn - 1 as int) as rank, feature, round(shap, 8) as shap from ranked where rn <= 3"


def listed(explained):
    return explained.select("row_id", "output_space", F.posexplode("contributions").alias("rank", "c")).select(
        "row_id", "output_space", "rank", "c.feature", F.round("c.shap", 8).alias("shap"))


@query("explain_machine_batch", V.with_views(READINGS, SCORED_READINGS, MACHINE_LIN) + TOP_SQL)
def explain_machine_batch(spark, sf):
    return listed(api.explain_ai4i_batch(valid_readings(spark, sf), machine_detector()))


@query("explain_flow_batch", V.with_views(FLOW_PRED, FLOW_LIN) + TOP_SQL)
def explain_flow_batch(spark, sf):
    return listed(api.explain_rt_iot2022_batch(flow_batch(spark, sf), flow_detector()))


MACHINE_OF = "cast(split_part(row_id, '-', 4) as bigint)"
SCORED_LINE = (V.LINE.replace("from tel t full join flow c using", "from tele t full join flowe c using"))


SCORED_TIMELINE = V.with_views(READINGS, SCORED_READINGS, MACHINE_LIN, FLOW_PRED, f"""tele as (select row_id, {MACHINE_OF} as machine,
    row_number() over (partition by {MACHINE_OF} order by row_id) - 1 as tick, prob as p from pred)""", """flowe as (select user_id as machine,
    row_number() over (partition by user_id order by ts, event_id) - 1 as tick, event_id, event_type as true_class, event_type = 'error' as true_attack,
    prob >= 0.5::double as flagged, prob as attack_p from fp)""", SCORED_LINE)
TOP_DRIVER = """case when level in ('ALARM', 'CRITICAL') then coalesce(' Top driver: ' || feature || '.', '') else '' end"""


@query("scored_events", SCORED_TIMELINE + f"""select tick, machine, level, {EVENT_TEXT} || {TOP_DRIVER} as text from line
  left join tele t using (machine, tick) left join ranked r on r.row_id = t.row_id and r.rn = 1 where level <> prev_level""")
def scored_events(spark, sf):
    """Events of the timeline that scores raw readings and flows itself; alarms name their top driver."""
    rows = valid_readings(spark, sf).withColumn("machine", F.split_part("row_id", F.lit("-"), F.lit(4)).cast("bigint"))
    rows = ordered_index(rows, ["machine"], ["row_id"], "tick", by=F.split_part("row_id", F.lit("-"), F.lit(1)).cast("bigint") * 0)
    flows = V.flows(spark, sf).select(F.col("event_id").alias("row_id"), "machine", "tick", "true_class", "true_attack").join(
        flow_batch(spark, sf), "row_id")
    line = api.scored_timeline(rows, machine_detector(), flows, flow_detector(), primary=V.PRIMARY, early=V.EARLY)
    return tl.level_events(line)
