"""Timeline, incident and site queries over the telemetry and flow views."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions import expressions as X
from plantwatch.operators import incidents as inc, timeline as tl
from plantwatch.plans import views as V
from plantwatch.plans.registry import query


def timeline(spark, sf):
    return tl.build_timeline(V.telemetry(spark, sf), V.flows(spark, sf),
                             primary=V.PRIMARY, early=V.EARLY)


@query("alert_timeline", V.TIMELINE_SQL + """select machine, tick, p, status, attack_p, coalesce(flagged, false) as flagged, true_class,
  coalesce(true_attack, false) as true_attack, n_flagged, n_seen, confirmed, level, severity, reason from line""")
def alert_timeline(spark, sf):
    # A tick without a flow has no class; nothing is flagged and nothing attacks there.
    no = F.lit(False)
    return timeline(spark, sf).select(
        "machine", "tick", "p", "status", "attack_p", F.coalesce("flagged", no).alias("flagged"), "true_class",
        F.coalesce("true_attack", no).alias("true_attack"),
        "n_flagged", "n_seen", "confirmed", "level", "severity", "reason")


EVENT_TEXT = """case when level = 'OK' then 'CNC-' || (machine + 1) || ' returned to OK'
  else 'CNC-' || (machine + 1) || ' ' || level || ': ' || reason end"""


@query("alert_events", V.TIMELINE_SQL + f"""select tick, machine, level, {EVENT_TEXT} as text,
  printf('T+%02d:%02d', (tick*2)//60, (tick*2)%60) as clock from line where level <> prev_level""")
def alert_events(spark, sf):
    return tl.level_events(timeline(spark, sf)).withColumn("clock", X.clock_text("tick"))


@query("incident_log", V.TIMELINE_SQL + f"""select
  printf('T+%02d:%02d', (tick*2)//60, (tick*2)%60) as time, 'CNC-' || (machine + 1) as machine, level, {EVENT_TEXT} as text
  from line where level <> prev_level""")
def incident_log(spark, sf):
    return tl.incident_log(tl.level_events(timeline(spark, sf)))


@query("alert_kpis", V.TIMELINE_SQL + """select max(p) as peak_failure_probability,
  count(distinct case when status = 'HIGH RISK' then machine end) as machines_with_alarm,
  cast(sum(case when true_attack then 1 else 0 end) as bigint) as attack_flows,
  cast(sum(case when true_attack and flagged then 1 else 0 end) as bigint) as attack_flows_flagged,
  cast(sum(case when not true_attack then 1 else 0 end) as bigint) as benign_flows,
  cast(sum(case when not true_attack and flagged then 1 else 0 end) as bigint) as benign_flows_flagged,
  cast(sum(case when level = 'CRITICAL' then 1 else 0 end) as bigint) as critical_ticks from line""")
def alert_kpis(spark, sf):
    return tl.timeline_kpis(timeline(spark, sf))


def incidents(spark, sf):
    """Incident list from the orders table: machine, start tick and duration of each."""
    return V.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("incident"), (F.col("o_custkey") % 100).alias("machine"),
        (F.col("o_orderkey") % 60).alias("start"), (F.col("o_orderkey") % 7).alias("duration"))


INC = """inc as (select o_orderkey as incident, o_custkey % 100 as machine, o_orderkey % 60 as start,
  o_orderkey % 7 as duration from orders where o_orderpriority = '1-URGENT')"""


@query("reaction_times", V.with_views(V.SCORED, V.TEL, V.FLOW, V.CONFIRM, V.LINE, INC) + """
  select cast(i.incident as varchar) as incident, i.machine, i.start,
  min(case when l.status <> 'NORMAL' then l.tick end) as first_reaction_tick,
  min(case when l.status <> 'NORMAL' then l.tick end) - i.start as lead_time_ticks,
  min(case when l.confirmed then l.tick end) as first_confirmed_tick,
  min(case when l.confirmed then l.tick end) - i.start as detection_delay_ticks
  from inc i left join line l on i.machine = l.machine and l.tick >= i.start group by 1, 2, 3""")
def reaction_times(spark, sf):
    return tl.reaction_times(timeline(spark, sf), incidents(spark, sf))


@query("incident_window_join", V.with_views(V.SCORED, V.TEL, INC) + """
  select i.incident, t.machine, t.tick, t.p from tel t join inc i
  on t.machine = i.machine and t.tick >= i.start and t.tick < i.start + i.duration""")
def incident_window_join(spark, sf):
    return inc.readings_in_incidents(V.telemetry(spark, sf), incidents(spark, sf)).select(
        "incident", "machine", "tick", "p")


@query("worst_moment", V.TIMELINE_SQL + """select machine, tick, severity, p from (select *, row_number() over (
  partition by machine order by severity desc, p desc, tick) as rn from line) where rn = 1""")
def worst_moment(spark, sf):
    return tl.worst_moments(timeline(spark, sf))


@query("level_grid", V.TIMELINE_SQL + "select tick, machine // 10 as block, " + ", ".join(
    f"max(case when machine % 10 = {i} then severity end) as m{i}" for i in range(10)) + " from line group by 1, 2")
def level_grid(spark, sf):
    return tl.level_grid(timeline(spark, sf))


@query("asset_peak_risk", V.TIMELINE_SQL + "select machine, round(max(severity*10 + coalesce(p, 0)), 5) as peak from line group by 1")
def asset_peak_risk(spark, sf):
    return tl.asset_peaks(timeline(spark, sf))


@query("log_until_tick", V.TIMELINE_SQL + f"""select tick, machine, level, {EVENT_TEXT} as text from line
  where level <> prev_level and tick <= 40""")
def log_until_tick(spark, sf):
    return tl.log_until(tl.level_events(timeline(spark, sf)), 40)


@query("flags_per_tick", V.with_views(V.FLOW) + """select tick,
  cast(sum(case when flagged then 1 else 0 end) as bigint) as flagged, count(*) as flows from flow group by 1""")
def flags_per_tick(spark, sf):
    return tl.flags_per_tick(V.flows(spark, sf))


@query("site_status", V.TIMELINE_SQL + """select tick, w as severity,
  case w when 0 then 'OK' when 1 then 'WARNING' when 2 then 'NETWORK ALERT' when 3 then 'ALARM' else 'CRITICAL' end as level,
  case when w > 0 then n else 0 end as machines from (select tick, max(severity) as w,
  cast(sum(case when severity = worst then 1 else 0 end) as bigint) as n
  from (select *, max(severity) over (partition by tick) as worst from line) group by tick)""")
def site_status(spark, sf):
    return tl.site_status(timeline(spark, sf))


@query("flow_verdict", V.with_views(V.FLOW) + """select machine, tick, event_id, case when true_attack and flagged then 'correctly flagged'
  when true_attack then 'MISSED' when flagged then 'False alarm' else 'correctly passed' end as verdict from flow""")
def flow_verdict(spark, sf):
    return V.flows(spark, sf).select("machine", "tick", "event_id",
                                     X.flow_verdict("true_attack", "flagged").alias("verdict"))


@query("machine_history", V.TIMELINE_SQL + """select l.machine, l.tick, l.p,
  max(l.p) over (partition by l.machine order by l.tick rows unbounded preceding) as peak_so_far
  from line l join (select machine, tick as cutoff from (select *, row_number() over (
    partition by machine order by severity desc, p desc, tick) as rn from line) where rn = 1) c
  on l.machine = c.machine and l.tick <= c.cutoff""")
def machine_history(spark, sf):
    line = timeline(spark, sf)
    return tl.history_until(line, tl.worst_moments(line))


@query("debounce", V.with_views(V.FLOW, V.CONFIRM) +
       "select machine, tick, event_id, n_flagged, n_seen, confirmed from conf")
def debounce(spark, sf):
    return tl.trailing_flags(V.flows(spark, sf)).select(
        "machine", "tick", "event_id", "n_flagged", "n_seen", "confirmed")


@query("machine_only_timeline", V.with_views(V.SCORED, V.TEL) + """select machine, tick, p, status, level,
  cast(case level when 'ALARM' then 3 when 'WARNING' then 1 else 0 end as int) as severity,
  case level when 'ALARM' then 'Failure probability ' || pct || ' is above the primary threshold.'
  when 'WARNING' then 'Failure probability ' || pct || ' is above the early-warning threshold.'
  else 'No warning from either model.' end as reason from (select *,
  case status when 'HIGH RISK' then 'ALARM' when 'EARLY WARNING' then 'WARNING' else 'OK' end as level from (
  select machine, tick, round(p, 5) as p, (cast(round(p*1000) as bigint) // 10) || '.' || (cast(round(p*1000) as bigint) % 10) || '%' as pct,
  case when p >= cast(0.77 as double) then 'HIGH RISK' when p >= cast(0.5 as double) then 'EARLY WARNING' else 'NORMAL' end as status from tel))""")
def machine_only_timeline(spark, sf):
    return tl.build_timeline(V.telemetry(spark, sf), None, primary=V.PRIMARY, early=V.EARLY).select(
        "machine", "tick", "p", "status", "level", "severity", "reason")


@query("risk_tiers", V.with_views(V.SCORED) + """select row_id, case when score >= cast(0.5 as double) then 'ATTACK' else 'NORMAL' end as classification,
  case when score >= cast(0.8 as double) then 'HIGH RISK' when score >= cast(0.5 as double) then 'MEDIUM RISK' else 'LOW RISK' end as risk_level,
  case when score >= cast(0.77 as double) then 'HIGH RISK' when score >= cast(0.07 as double) then 'EARLY WARNING' else 'NORMAL' end as status,
  case when score >= cast(0.77 as double) then 1 else 0 end as predicted from scored""")
def risk_tiers(spark, sf):
    return V.scored(spark, sf).select(
        "row_id", X.classification("score").alias("classification"), X.risk_level("score").alias("risk_level"),
        X.machine_status("score").alias("status"), X.decision("score", 0.77).alias("predicted"))


HEX = "cast(('0x' || substr(md5({key}), 1, 8)) as bigint)"


@query("labelled_replay", V.with_views(V.SCORED, V.TEL, INC, """
  benign as (select event_id as flow_id, event_type as true_class, row_number() over (order by event_id) - 1 as pos
    from events where event_type in ('click', 'view', 'purchase', 'signup')),
  attack as (select event_id as flow_id, event_type as true_class, row_number() over (order by event_id) - 1 as pos
    from events where event_type = 'error'),
  hit as (select distinct t.machine, t.tick from tel t join inc i on t.machine = i.machine
    and t.tick >= i.start and t.tick < i.start + i.duration),
  draw as (select t.machine, t.tick, h.machine is not null as in_window,
    h.machine is not null and substr(md5(t.machine || '-' || t.tick || ':coin42'), 1, 8) < 'cccccccc' as atk,
    """ + HEX.format(key="t.machine || '-' || t.tick || ':pick42'") + """ as h
    from tel t left join hit h on t.machine = h.machine and t.tick = h.tick)""") + """
  select d.machine, d.tick, d.in_window, d.atk as true_attack, a.flow_id, a.true_class from draw d
    join attack a on d.atk and a.pos = d.h % (select count(*) from attack)
  union all select d.machine, d.tick, d.in_window, d.atk, b.flow_id, b.true_class from draw d
    join benign b on not d.atk and b.pos = d.h % (select count(*) from benign)""")
def labelled_replay(spark, sf):
    pool = V.table(spark, sf, "events").select(F.col("event_id").alias("flow_id"),
                                               F.col("event_type").alias("true_class"))
    return inc.labelled_replay(V.telemetry(spark, sf), incidents(spark, sf), pool,
                               V.NORMAL_EVENTS, ["error"]).select(
        "machine", "tick", "in_window", "true_attack", "flow_id", "true_class")


@query("flagged_subset", V.with_views(V.FLOW) + """select event_id, position from (
  select event_id, row_number() over (order by event_id) - 1 as position, count(*) over () as n from flow where flagged)
  where position in (select (i * (n - 1)) // 23 from range(24) t(i))""")
def flagged_subset(spark, sf):
    return inc.spread_subset(V.flow_rows(spark, sf).filter("flagged").select("event_id"), "event_id")
