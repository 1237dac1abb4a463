"""Evaluation metrics, thresholds, bootstrap intervals and error analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plantwatch.functions.expressions import decision
from plantwatch.functions.keys import content_key, hash_mod
from plantwatch.operators import bootstrap as B, errors as E, metrics as M
from plantwatch.operators.splits import hash_split
from plantwatch.plans import views as V
from plantwatch.plans.audit_queries import SPLIT
from plantwatch.plans.profile_queries import rounded
from plantwatch.plans.registry import query
from plantwatch.session import materialise, spread

RATES = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "negative_recall", "predicted_positive_rate"]
RATES_SQL = """round(cast(tp + tn as double) / (tp + tn + fp + fn), 6) as accuracy,
  round((coalesce(cast(tp as double) / nullif(tp + fn, 0), 0) + coalesce(cast(tn as double) / nullif(tn + fp, 0), 0)) / 2, 6) as balanced_accuracy,
  round(coalesce(cast(tp as double) / nullif(tp + fp, 0), 0), 6) as "precision",
  round(coalesce(cast(tp as double) / nullif(tp + fn, 0), 0), 6) as recall,
  round(coalesce(cast(2 * tp as double) / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
  round(coalesce(cast(tn as double) / nullif(tn + fp, 0), 0), 6) as negative_recall,
  round(cast(tp + fp as double) / (tp + tn + fp + fn), 6) as predicted_positive_rate"""


def counts_sql(pred: str) -> str:
    return f"""cast(sum(case when y = 0 and not ({pred}) then 1 else 0 end) as bigint) as tn,
  cast(sum(case when y = 0 and ({pred}) then 1 else 0 end) as bigint) as fp,
  cast(sum(case when y = 1 and not ({pred}) then 1 else 0 end) as bigint) as fn,
  cast(sum(case when y = 1 and ({pred}) then 1 else 0 end) as bigint) as tp"""


def rank_sql(name: str, source: str, keys: str = "", score: str = "score", y: str = "y") -> str:
    """CTE with roc_auc and average_precision of ``source``, per key column if given."""
    k = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    return f"""{name} as (select {k}sum((n - tp) * (ctp - tp / 2)) / nullif(max(p) * max(m), 0) as roc_auc,
    sum(tp * ctp / cn) / nullif(max(p), 0) as average_precision from (
    select *, sum(tp) over ({part} order by s desc) as ctp, sum(n) over ({part} order by s desc) as cn,
      sum(tp) over ({part}) as p, sum(n - tp) over ({part}) as m from (
      select {k}{score} as s, cast(sum({y}) as double) as tp, cast(count(*) as double) as n from {source} group by {k}{score}))
    {'group by ' + keys if keys else ''})"""


def scored(spark, sf):
    return V.scored(spark, sf).select("row_id", "score", "y", "l_returnflag")


@query("confusion", V.with_views(V.SCORED) + """select y as actual, count(*) filter (score < cast(0.5 as double)) as predicted_0,
  count(*) filter (score >= cast(0.5 as double)) as predicted_1 from scored group by y""")
def confusion(spark, sf):
    return M.confusion_table(scored(spark, sf).withColumn("pred", decision("score", 0.5)), "y", "pred")


@query("metric_row", V.with_views(V.SCORED) + f"select tn, fp, fn, tp, {RATES_SQL} from (select {counts_sql('score >= cast(0.5 as double)')} from scored)")
def metric_row(spark, sf):
    return rounded(M.metric_row(scored(spark, sf), "y", "score"), RATES)


@query("metric_row_by_group", V.with_views(V.SCORED) +
       f"select l_returnflag, tn, fp, fn, tp, {RATES_SQL} from (select l_returnflag, {counts_sql('score >= cast(0.5 as double)')} from scored group by 1)")
def metric_row_by_group(spark, sf):
    return rounded(M.metric_row(scored(spark, sf), "y", "score", keys=["l_returnflag"]), RATES)


@query("roc_auc", V.with_views(V.SCORED, rank_sql("r", "scored", "l_returnflag")) + "select l_returnflag, round(roc_auc, 6) as roc_auc from r")
def roc_auc(spark, sf):
    out = M.ranking(scored(spark, sf), "y", "score", ["l_returnflag"])
    return rounded(out, ["roc_auc"]).drop("average_precision")


@query("average_precision", V.with_views(V.SCORED, rank_sql("r", "scored")) +
       "select round(roc_auc, 6) as roc_auc, round(average_precision, 6) as average_precision from r")
def average_precision(spark, sf):
    return rounded(M.ranking(scored(spark, sf), "y", "score"), ["roc_auc", "average_precision"])


LONG = """long as (select 'blend' as model, y, score from scored
  union all select 'quantity' as model, y, l_quantity / 50 as score from scored)"""


@query("model_comparison", V.with_views(V.SCORED, LONG, rank_sql("r", "long", "model")) +
       f"""select c.model, tn, fp, fn, tp, {RATES_SQL}, round(roc_auc, 6) as roc_auc, round(average_precision, 6) as average_precision
  from (select model, {counts_sql('score >= cast(0.5 as double)')} from long group by 1) c join r on c.model = r.model""")
def model_comparison(spark, sf):
    d = V.scored(spark, sf).withColumn("quantity", F.col("l_quantity") / 50)
    return rounded(M.compare_models(d, "y", {"blend": "score", "quantity": "quantity"}),
                   [*RATES, "roc_auc", "average_precision"])


SWEEP = V.with_views(V.SCORED, "grid as (select cast(i as double) / 100 as threshold from range(5, 96) t(i))",
                     f"""sweep as (select threshold, tn, fp, fn, tp, {RATES_SQL} from (select threshold, {counts_sql('score >= threshold')}
  from grid, (select score, y from scored) group by threshold))""")


@query("threshold_sweep", SWEEP + "select * from sweep")
def threshold_sweep(spark, sf):
    return rounded(M.threshold_sweep(scored(spark, sf), "y", "score"), RATES)


@query("choose_thresholds", SWEEP + """select * from (select 'best_f1' as rule, threshold, "precision", recall, f1 from sweep order by f1 desc, threshold limit 1)
  union all select * from (select 'recall_at_precision' as rule, threshold, "precision", recall, f1 from sweep where "precision" >= 0.30 order by recall desc, f1 desc, threshold limit 1)
  union all select * from (select 'recall_at_f1' as rule, threshold, "precision", recall, f1 from sweep where f1 >= 0.50 order by recall desc, f1 desc, threshold limit 1)""")
def choose_thresholds(spark, sf):
    out = M.choose_thresholds(M.threshold_sweep(scored(spark, sf), "y", "score"))
    return rounded(out, ["precision", "recall", "f1"])


@query("operating_modes", V.with_views(V.SCORED, rank_sql("r", "scored")) + " union all ".join(
    f"""select '{m}' as operating_mode, cast({t} as double) as threshold, tn, fp, fn, tp, {RATES_SQL},
  round(roc_auc, 6) as roc_auc, round(average_precision, 6) as average_precision
  from (select {counts_sql(f'score >= cast({t} as double)')} from scored), r""" for m, t in
    [("balanced_primary", 0.77), ("early_warning_secondary", 0.07)]))
def operating_modes(spark, sf):
    out = M.operating_modes(scored(spark, sf), "y", "score", {"balanced_primary": 0.77, "early_warning_secondary": 0.07})
    return rounded(out, [*RATES, "roc_auc", "average_precision"])


@query("report_reader", V.with_views(V.SCORED) + f"""select 'balanced_primary' as operating_mode, tn + fp + fn + tp as rows, {RATES_SQL}
  from (select {counts_sql('score >= cast(0.77 as double)')} from scored)""")
def report_reader(spark, sf):
    from plantwatch.sources.artifacts import read_operating_mode, write_table
    path = write_table(operating_modes(spark, sf), "operating_modes")
    return read_operating_mode(spark, path, "balanced_primary").select("operating_mode", "rows", *RATES)


@query("score_summary", V.with_views(V.SCORED) + """select round(avg(case when y = 0 then cast(score >= cast(0.5 as double) as int) end), 6) as fpr_normal,
  (select quantile_cont(score, 0.5) from scored where y = 1) as median_attack_score from scored""")
def score_summary(spark, sf):
    return rounded(M.score_summary(scored(spark, sf), "y", "score"), ["fpr_normal"])


MODES = {"primary_0.77": 0.77, "early_warning_0.07": 0.07}


def boot_sql(mode: str, t: float) -> str:
    rates = """coalesce(tp / nullif(tp + fp, 0), 0) as "precision", coalesce(tp / nullif(tp + fn, 0), 0) as recall,
      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1"""
    return f"""select '{mode}' as mode, metric, round(point, 6) as point, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high from (
  with s as (select rep, w, y, score >= cast({t} as double) as p from wt),
  c as (select rep, cast(sum(case when y = 1 and p then w else 0 end) as double) as tp,
    cast(sum(case when y = 0 and p then w else 0 end) as double) as fp, cast(sum(case when y = 1 and not p then w else 0 end) as double) as fn from s group by rep),
  m as (select rep, {rates} from c where tp + fn > 0),
  pt as (select {rates} from (select cast(sum(case when y = 1 and score >= cast({t} as double) then 1 else 0 end) as double) as tp,
    cast(sum(case when y = 0 and score >= cast({t} as double) then 1 else 0 end) as double) as fp,
    cast(sum(case when y = 1 and score < cast({t} as double) then 1 else 0 end) as double) as fn from scored))
  """ + " union all ".join(f"""select '{x}' as metric, (select "{x}" from pt) as point, quantile_cont("{x}", 0.025) as ci_low,
    quantile_cont("{x}", 0.975) as ci_high from m""" for x in ["precision", "recall", "f1"]) + ")"


HEXW = """case when h < '5e2d58d8' then 0 when h < 'bc5ab1b1' then 1 when h < 'eb715e1d' then 2
  when h < 'fb23ed97' then 3 when h < 'ff108d75' then 4 else 5 end"""


@query("bootstrap_hash", V.with_views(V.SCORED, f"""wt as (select rep, y, score, {HEXW} as w from (
  select y, score, r as rep, substr(md5(row_id || ':' || r), 1, 8) as h from scored, range(20) t(r)))""") +
       " union all ".join(boot_sql(m, t) for m, t in MODES.items()))
def bootstrap_hash(spark, sf):
    # Twenty hashes per row: worth sharing out a scan of one split.
    out = B.hash_bootstrap(spread(scored(spark, sf)), "row_id", "y", "score", MODES)
    return rounded(out, ["point", "ci_low", "ci_high"])


@query("bootstrap_counts")
def bootstrap_counts(spark, sf):
    return B.count_bootstrap(scored(spark, sf), "y", "score", MODES)


@query("bootstrap_ranking")
def bootstrap_ranking(spark, sf):
    return B.ranking_bootstrap(scored(spark, sf), "y", "score")


@query("bootstrap_ranking_rows", V.with_views(V.SCORED, rank_sql("r", "scored")) + " union all ".join(
    f"""select '{m}' as metric, round({m}, 6) as point, cast(5000 as bigint) as replicates, (select count(*) from scored) as least_rows,
  (select count(*) from scored) as most_rows, true as centred from r""" for m in ("roc_auc", "average_precision")))
def bootstrap_ranking_rows(spark, sf):
    """Rows of every resample, and whether the resamples scatter around the metric of the table itself."""
    reps = materialise(B.ranking_replicates(scored(spark, sf), "y", "score"), "replicates")
    rows = F.col("positives") + F.col("negatives")
    both = ["roc_auc", "average_precision"]
    of = lambda name: F.array(*[F.struct(F.lit(m).alias("metric"), name(m)) for m in both])
    spread_of = reps.agg(F.count(F.lit(1)).alias("replicates"), F.min(rows).alias("least_rows"), F.max(rows).alias("most_rows"), *[
        f(m).alias(f"{m}_{n}") for m in both for n, f in (("mean", F.avg), ("std", F.stddev))])
    points = M.ranking(scored(spark, sf), "y", "score").select(F.inline(of(lambda m: F.col(m).alias("point"))))
    return points.join(spread_of.select("replicates", "least_rows", "most_rows", F.inline(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std")) for m in both]))), "metric").select(
        "metric", F.round("point", 6).alias("point"), "replicates", "least_rows", "most_rows",
        (F.abs(F.col("mean") - F.col("point")) <= F.col("std")).alias("centred"))


FOLDS = """f as (select cast(l_linenumber as bigint) as candidate, cast(('0x' || substr(md5(row_id || ':42'), 1, 8)) as bigint) % 4 as fold,
  avg(y) as test_score, avg(score) as train_score from scored group by 1, 2)"""


@query("cv_history", V.with_views(V.SCORED, FOLDS) + """select candidate, round(avg(test_score), 6) as mean_test_score, round(stddev_pop(test_score), 6) as std_test_score,
  round(avg(train_score), 6) as mean_train_score, round(stddev_pop(train_score), 6) as std_train_score,
  cast(rank() over (order by avg(test_score) desc) as int) as rank_test_score from f group by 1""")
def cv_history(spark, sf):
    s = V.scored(spark, sf)
    folds = s.groupBy(F.col("l_linenumber").cast("bigint").alias("candidate"), hash_mod("row_id", 42, 4).alias("fold")).agg(
        F.avg("y").alias("test_score"), F.avg("score").alias("train_score"))
    return rounded(E.cv_history(folds, "candidate"), [
        "mean_test_score", "std_test_score", "mean_train_score", "std_train_score"])


@query("class_breakdown", V.with_views(V.FLOW) + """select true_class, kind, samples, round(samples * 100.0::double / sum(samples) over (), 6) as share_pct,
  correct, round(correct::double / samples, 6) as correct_rate, round(1 - correct::double / samples, 6) as miss_rate from (
  select true_class, case when true_class = 'error' then 'Attack (want: Attack)' else 'Normal (want: Normal)' end as kind,
  count(*) as samples, cast(sum(case when flagged = (true_class = 'error') then 1 else 0 end) as bigint) as correct from flow group by 1, 2)""")
def class_breakdown(spark, sf):
    f = V.flow_rows(spark, sf)
    preds = f.select("event_id", F.col("flagged").cast("int").alias("predicted_attack"))
    out = E.class_breakdown(preds, f.select("event_id", "true_class"), "event_id", "predicted_attack", "true_class", V.NORMAL_EVENTS)
    return rounded(out, ["share_pct", "correct_rate", "miss_rate"])


MODE_FLAGS = {"heavy": ("l_quantity >= 45", "large quantity"), "taxed": ("l_tax >= 0.07::double", "high tax"),
              "late": ("l_linenumber = 7", "last line"), "never": ("l_quantity > 100", "no such row")}


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, z2 = f"({k}::double / nullif({n}, 0))", "(1.96::double * 1.96::double)"
    d = f"(1 + {z2} / nullif({n}, 0))"
    c = f"(({p} + {z2} / (2 * nullif({n}, 0))) / {d})"
    h = f"(1.96::double * sqrt({p} * (1 - {p}) / nullif({n}, 0) + {z2} / (4 * nullif({n}, 0)::double * {n})) / {d})"
    return f"{c} - {h}", f"{c} + {h}"


@query("mode_recall", V.with_views(V.SCORED) + "select mode, meaning, operating_mode, failures, detected, "
       "round(detected::double / nullif(failures, 0), 6) as recall, round(" + wilson_sql("detected", "failures")[0] +
       ", 6) as ci_low, round(" + wilson_sql("detected", "failures")[1] + ", 6) as ci_high from (" + " union all ".join(
           f"""select '{m}' as mode, '{text}' as meaning, '{op}' as operating_mode,
  cast(sum(case when {cond} then 1 else 0 end) as bigint) as failures,
  cast(sum(case when {cond} and score >= {t}::double then 1 else 0 end) as bigint) as detected from scored"""
           for m, (cond, text) in MODE_FLAGS.items() for op, t in MODES.items()) + ")")
def mode_recall(spark, sf):
    s = V.scored(spark, sf)
    modes = s.select("row_id", *[F.expr(c.replace("::double", "D")).cast("int").alias(m) for m, (c, _) in MODE_FLAGS.items()])
    preds = s.select("row_id", *[decision("score", t).alias(f"d{i}") for i, t in enumerate(MODES.values())])
    out = E.mode_recall(preds, modes, "row_id", {m: t for m, (_, t) in MODE_FLAGS.items()},
                        {op: f"d{i}" for i, op in enumerate(MODES)})
    return rounded(out, ["recall", "ci_low", "ci_high"])


FAM = """fam as (select 'errors' as family, 'error' as true_class union all select 'conversions', 'purchase' union all select 'conversions', 'signup')"""


def family_sql(seed: int) -> str:
    """CTEs r{seed}: the evaluation record per family for one split seed."""
    split = SPLIT.format(key="event_id").replace(":42", f":{seed}")
    return f"""e{seed} as (select *, {split} as split, md5(concat_ws('|;', machine, true_class)) as gid from flow),
  p{seed} as (select f.family, e.event_id, e.gid, e.attack_p as score from e{seed} e join fam f using (true_class)),
  n{seed} as (select attack_p as score from e{seed} where split = 'test' and true_class in ('click', 'view')),
  b{seed} as (select family, score, 1 as y from p{seed} union all select family, score, 0 as y from n{seed}, (select distinct family from fam)),
  {rank_sql(f'k{seed}', f'b{seed}', 'family')},
  r{seed} as (select b.family, sum(y)::bigint as n_rows, any_value(u.n) as n_unique_patterns,
    sum(case when y = 1 and score >= 0.5::double then 1 else 0 end)::double / sum(y) as recall_rows, any_value(u.r) as recall_patterns,
    any_value(u.med) as median_attack_score, sum(case when y = 0 and score >= 0.5::double then 1 else 0 end)::double / sum(1 - y) as fpr_normal,
    sum(1 - y)::bigint as n_normal_eval, coalesce(sum(case when y = 1 and score >= 0.5::double then 1 else 0 end)::double / nullif(sum(case when score >= 0.5::double then 1 else 0 end), 0), 0) as "precision",
    2 * sum(case when y = 1 and score >= 0.5::double then 1 else 0 end)::double / (sum(y) + sum(case when score >= 0.5::double then 1 else 0 end)) as f1,
    sum(y)::double / count(*) as eval_attack_share, any_value(k.roc_auc) as roc_auc, any_value(k.average_precision) as pr_auc
    from b{seed} b join k{seed} k on k.family = b.family join (
      select p.family, count(*) as n, avg(case when score >= 0.5::double then 1 else 0 end) as r,
        any_value(m.med) as med from (select *, row_number() over (partition by family, gid order by event_id) as rn from p{seed}) p
        join (select family, quantile_cont(score, 0.5) as med from p{seed} group by 1) m on m.family = p.family where rn = 1 group by 1) u on u.family = b.family
    group by b.family)"""


REC = ["recall_rows", "recall_patterns", "median_attack_score", "fpr_normal", "precision", "f1",
       "eval_attack_share", "roc_auc", "pr_auc"]


def family_eval(spark, sf, seed):
    f = hash_split(V.flow_rows(spark, sf), "event_id", seed)
    f = f.withColumn("gid", content_key(f, ["machine", "true_class"]))
    pos = E.family_classes(f, V.EVENT_FAMILIES, "true_class")
    neg = f.filter((F.col("split") == "test") & F.col("true_class").isin("click", "view"))
    return E.unseen_family_eval(pos, neg, "attack_p", "gid", "event_id")


@query("unseen_family_eval", V.with_views(V.FLOW, FAM, family_sql(42)) + "select family, n_rows, n_unique_patterns, n_normal_eval, " +
       ", ".join(f'round("{c}", 6) as "{c}"' for c in REC) + " from r42")
def unseen_family_eval(spark, sf):
    return rounded(family_eval(spark, sf, 42), REC)


SUMMARY = ["ood_recall_rows", "ood_recall_std", "ood_recall_patterns", "ood_median_attack_score", "ood_fpr_normal",
           "ood_roc_auc", "ood_f1", "seen_recall_rows", "seen_f1", "ci_low_first_seed", "ci_high_first_seed", "recall_drop_vs_seen"]


def runs(spark, sf):
    seeds = [42, 43, 44]
    unseen = reduce(lambda a, b: a.unionByName(b), [
        family_eval(spark, sf, s).withColumn("seed", F.lit(s)) for s in seeds])
    seen = unseen.filter("family = 'errors'").select("family", "seed", (F.col("recall_rows") * 0.5).alias("recall_rows"),
                                                     (F.col("f1") * 0.5).alias("f1"))
    return E.merge_runs(unseen, seen, ["family", "seed"])


@query("family_summary", V.with_views(V.FLOW, FAM, *[family_sql(s) for s in (42, 43, 44)], """runs as (
  select *, case when family = 'errors' then recall_rows * 0.5 end as seen_recall, case when family = 'errors' then f1 * 0.5 end as seen_f from (
  select 42 as seed, * from r42 union all select 43, * from r43 union all select 44, * from r44))""") + """
  select family, unseen_rows, unseen_patterns, seeds, """ + ", ".join(f"round({c}, 6) as {c}" for c in SUMMARY) + """ from (
  select *, seen_recall_rows - ood_recall_rows as recall_drop_vs_seen, """ + wilson_sql("round(r0 * unseen_rows)", "unseen_rows")[0] +
       " as ci_low_first_seed, " + wilson_sql("round(r0 * unseen_rows)", "unseen_rows")[1] + """ as ci_high_first_seed from (
  select family, arg_min(n_rows, seed) as unseen_rows, arg_min(n_unique_patterns, seed) as unseen_patterns, avg(recall_rows) as ood_recall_rows,
  stddev_pop(recall_rows) as ood_recall_std, arg_min(recall_rows, seed) as r0, avg(recall_patterns) as ood_recall_patterns,
  avg(median_attack_score) as ood_median_attack_score, avg(fpr_normal) as ood_fpr_normal, avg(roc_auc) as ood_roc_auc, avg(f1) as ood_f1,
  avg(seen_recall) as seen_recall_rows, avg(seen_f) as seen_f1, count(*) as seeds from runs group by family))""")
def family_summary(spark, sf):
    return rounded(E.family_summary(runs(spark, sf)), SUMMARY)


@query("metric_delta_vs_full", V.with_views(V.SCORED, """sets as (select 'FULL' as feature_set, y, score from scored
  union all select 'NO_TAX', y, 0.7::double * l_quantity / 50 from scored union all select 'TAX_ONLY', y, l_tax / 0.08::double from scored)""",
                                            rank_sql("r", "sets", "feature_set")) + """select a.feature_set, round(a.roc_auc - f.roc_auc, 6) as delta_roc_auc_vs_full,
  round(a.average_precision - f.average_precision, 6) as delta_average_precision_vs_full from r a, r f where f.feature_set = 'FULL'""")
def metric_delta_vs_full(spark, sf):
    d = V.scored(spark, sf).select("y", F.col("score").alias("full"), (F.lit(0.7) * F.col("l_quantity") / 50).alias("no_tax"),
                                   (F.col("l_tax") / F.lit(0.08)).alias("tax_only"))
    table = M.compare_models(d, "y", {"FULL": "full", "NO_TAX": "no_tax", "TAX_ONLY": "tax_only"})
    out = E.delta_vs(table, "model", "FULL", ["roc_auc", "average_precision"])
    return rounded(out, ["delta_roc_auc_vs_full", "delta_average_precision_vs_full"]).withColumnRenamed("model", "feature_set")
