"""Training, evaluation, search and explanation of detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.operators import explain as X, metrics as M, training as T
from plantwatch.operators.splits import hash_split
from plantwatch.plans import views as V
from plantwatch.plans.audit_queries import SPLIT
from plantwatch.plans.metric_queries import RATES, RATES_SQL, counts_sql
from plantwatch.plans.profile_queries import NUM, rounded
from plantwatch.plans.registry import query
from plantwatch.session import materialise, spread

CAT = ["l_returnflag"]
MODES = {"primary": 0.77, "early_warning": 0.07}
SPLIT_SCORED = V.SCORED + ", s as (select *, " + SPLIT.format(key="row_id") + " as split from scored)"


def machines(spark, sf):
    return hash_split(V.scored(spark, sf).select("row_id", "score", "y", *NUM, *CAT), "row_id")


def parts(df):
    return df.filter("split = 'train'"), df.filter("split = 'validation'")


def evaluated(det, val):
    """Metrics of one scoring pass."""
    return M.evaluate(materialise(det.score(val).select("y", "probability"), "scored"), "y", "probability")


@query("dummy_classifier", V.with_views(SPLIT_SCORED, "top as (select y as c from s where split = 'train' group by y order by count(*) desc, y limit 1)") +
       f"select tn, fp, fn, tp, {RATES_SQL} from (select {counts_sql('c = 1')} from s, top where split = 'validation')")
def dummy_classifier(spark, sf):
    train, val = parts(machines(spark, sf))
    return rounded(M.metric_row(T.fit_dummy(train, "y", NUM).score(val), "y", "probability"), RATES)


@query("logistic")
def logistic(spark, sf):
    train, val = parts(machines(spark, sf))
    return evaluated(T.fit_logistic(train, "y", NUM, CAT), val)


@query("forest")
def forest(spark, sf):
    train, val = parts(V.vectors(spark, sf))
    return evaluated(T.fit_forest(train, "y", V.FEATURES), val)


def boosted_fit(df):
    return T.fit_boosted(df, "y", NUM, CAT)


@query("boosted")
def boosted(spark, sf):
    train, val = parts(machines(spark, sf))
    return evaluated(boosted_fit(train), val)


MODEL_NAMES = ["boosted", "forest", "logistic"]


@query("model_invariants", V.with_views(SPLIT_SCORED, "v as (select y from s where split = 'validation')") + " union all ".join(
    f"select '{m}' as model, count(*) as n_rows, cast(sum(y) as bigint) as positives, true as in_range, true as beats_dummy, true as differs from v"
    for m in MODEL_NAMES))
def model_invariants(spark, sf):
    """Three fits: every validation row is scored once, inside [0, 1], far better than by chance, and no two models agree in all rows."""
    train, val = parts(machines(spark, sf))
    fits = [boosted_fit(train), T.fit_forest(train, "y", NUM, CAT), T.fit_logistic(train, "y", NUM, CAT)]
    scored = val.select("row_id", "y", *NUM, *CAT)
    for m, d in zip(MODEL_NAMES, fits):
        scored = d.score(scored, m)
    scored = materialise(scored.select("row_id", "y", *MODEL_NAMES), "scored")
    ranked = {m: M.ranking(scored, "y", m).select(F.lit(m).alias("model"), (F.col("roc_auc") > 0.8).alias("beats_dummy")) for m in MODEL_NAMES}
    out = None
    for k, m in enumerate(MODEL_NAMES):
        other = MODEL_NAMES[k - 1]
        row = scored.agg(F.lit(m).alias("model"), F.count_distinct("row_id").alias("n_rows"), F.sum("y").cast("bigint").alias("positives"),
                         F.bool_and(F.col(m).between(0, 1)).alias("in_range"), F.bool_or(F.col(m) != F.col(other)).alias("differs"))
        row = row.join(ranked[m], "model")
        out = row if out is None else out.unionByName(row)
    return out


@query("baseline_models")
def baseline_models(spark, sf):
    train, val = parts(machines(spark, sf))
    return T.baselines(train, val, "y", NUM, CAT)


@query("random_search")
def random_search(spark, sf):
    train, _ = parts(machines(spark, sf))
    return T.random_search(train, "y", "row_id", NUM, CAT)[0]


@query("final_test")
def final_test(spark, sf):
    return T.final_test(machines(spark, sf), "y", "row_id", boosted_fit, MODES)[1]


@query("final_predictions")
def final_predictions(spark, sf):
    return T.final_test(machines(spark, sf), "y", "row_id", boosted_fit, MODES)[2]


@query("ablation")
def ablation(spark, sf):
    train, val = parts(machines(spark, sf))
    sets = {"FULL": [], "NO_CATEGORICAL": CAT, "NO_QUANTITY": ["l_quantity"]}
    return T.ablation(train, val, "y", NUM, CAT, sets)


FAMILIES = {"five": [5], "six": [6], "seven": [7], "eight": [8], "nine": [9]}
STUDY_SEEDS = [42, 43, 44]


def study(spark, sf):
    df = V.vectors(spark, sf).withColumn("gid", F.col("row_id"))
    return T.run_study(df, V.FEATURES, FAMILIES, STUDY_SEEDS, "y", "label", "gid", "row_id")


@query("leave_family_out")
def leave_family_out(spark, sf):
    return study(spark, sf)


@query("leave_family_out_rows", V.with_views(V.FEAT, "s as (select label, y, " + SPLIT.format(key="row_id") + " as split from feat)",
       "fam as (" + " union all ".join(f"select '{f}' as family, {c[0]} as label" for f, c in FAMILIES.items()) + ")",
       "seeds as (" + " union all ".join(f"select cast({x} as int) as seed" for x in STUDY_SEEDS) + ")") + """select family, seed, cast(f.label as varchar) as classes,
  (select count(*) from s where split <> 'test' and label <> f.label) as train_rows,
  (select count(*) from s where label = f.label) as ood_n_rows, (select count(*) from s where label = f.label and split = 'test') as seen_n_rows,
  (select count(*) from s where y = 0 and split = 'test') as ood_n_normal_eval, true as in_range
  from fam f, seeds where exists (select 1 from s where label = f.label)""")
def leave_family_out_rows(spark, sf):
    """The rows that each run of the study trains and is evaluated on, and whether its rates are rates."""
    rates = ["ood_recall_rows", "ood_recall_patterns", "ood_fpr_normal", "ood_roc_auc", "ood_median_attack_score"]
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    ok = F.lit(True)
    for r in rates:
        ok = ok & F.coalesce(F.col(r).between(0, 1), F.lit(True))
    return study(spark, sf).select("family", "seed", "classes", *[whole(c) for c in (
        "train_rows", "ood_n_rows", "seen_n_rows", "ood_n_normal_eval")], ok.alias("in_range"))


WEIGHTS = {"l_quantity": 0.02, "l_extendedprice": 0.00001, "l_discount": -3.0, "l_tax": 1.5}
LIN = "m as (select " + ", ".join(f"round(avg({c}), 9) as m_{c}" for c in WEIGHTS) + """ from scored),
  lin as (""" + " union all ".join(
      f"select row_id, score, '{c}' as feature, {c} as value, cast({w:.8f} as double) * ({c} - m_{c}) as shap from scored, m"
      for c, w in WEIGHTS.items()) + ")"


def linear(spark, sf):
    s = spread(V.scored(spark, sf).select("row_id", "score", *WEIGHTS))
    means = s.agg(*[F.round(F.avg(c), 9).alias(c) for c in WEIGHTS]).first().asDict()
    return s, lambda rows: X.linear_contributions(rows, "row_id", WEIGHTS, means)


@query("linear_contributions", V.with_views(V.SCORED, LIN) + """select row_id, cast(rn - 1 as int) as rank, feature, round(shap, 8) as shap,
  round(shap / coalesce(nullif(most, 0), 1), 6) as share, case when shap > 0 then 'toward' else 'away from' end as direction
  from (select *, max(abs(shap)) over (partition by row_id) as most,
    row_number() over (partition by row_id order by abs(shap) desc, feature) as rn from lin) where rn <= 3""")
def linear_contributions(spark, sf):
    s, explain = linear(spark, sf)
    top = X.top_contributions(explain(s), 3)
    zipped = F.arrays_zip(F.col("contributions").alias("c"), X.scaled().alias("s"))
    return top.select("row_id", F.posexplode(zipped).alias("rank", "z")).select(
        "row_id", "rank", "z.c.feature", F.round("z.c.shap", 8).alias("shap"),
        F.round("z.s.share", 6).alias("share"), X.direction("z.c.shap").alias("direction"))


@query("global_importance", V.with_views(V.SCORED, LIN) + "select feature, round(avg(abs(shap)), 6) as mean_abs_shap from lin group by 1")
def global_importance(spark, sf):
    s, explain = linear(spark, sf)
    return rounded(X.global_importance(explain(s)), ["mean_abs_shap"])


@query("top_risk_explanation", V.with_views(V.SCORED, LIN) + """select row_id, score, cast(row_number() over (order by abs(shap) desc, feature) - 1 as int) as rank,
  feature, value, round(shap, 8) as shap, case when shap > 0 then 'toward' else 'away from' end as direction from lin
  where row_id = (select row_id from scored order by score desc, row_id limit 1)""")
def top_risk_explanation(spark, sf):
    s, explain = linear(spark, sf)
    return rounded(X.top_risk(s, explain, "row_id", "score"), ["shap"], 8)


@query("tree_shap")
def tree_shap(spark, sf):
    df = machines(spark, sf)
    out = X.tree_contributions(boosted_fit(df.filter("split = 'train'")), df.filter("split = 'validation'"), "row_id")
    return X.top_contributions(out, 3).select("row_id", "base_value", F.inline("contributions"))


@query("tree_shap_additivity", V.with_views(SPLIT_SCORED) + "select row_id, true as adds_up from s where split = 'validation'")
def tree_shap_additivity(spark, sf):
    """Whether base value and contributions of each row add up to the log-odds of its score."""
    train, val = parts(machines(spark, sf))
    det = boosted_fit(train)
    total = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["shap"])
    sums = X.tree_contributions(det, val, "row_id").select("row_id", total.alias("total"))
    odds = F.log(F.col("probability") / (1 - F.col("probability")))
    return det.score(val).join(sums, "row_id").select("row_id", (F.abs(odds - F.col("total")) < 1e-6).alias("adds_up"))


@query("forest_shap_additivity", V.with_views(V.FEAT, "s as (select row_id, " + SPLIT.format(key="row_id") + " as split from feat)") +
       "select row_id, true as adds_up from s where split = 'validation'")
def forest_shap_additivity(spark, sf):
    """Whether base value and contributions of each row add up to the probability of a full-depth forest."""
    train, val = parts(V.vectors(spark, sf))
    det = T.fit_forest(train, "y", V.FEATURES)
    total = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["shap"])
    sums = X.tree_contributions(det, val, "row_id").select("row_id", total.alias("total"))
    return det.score(val).join(sums, "row_id").select("row_id", (F.abs(F.col("probability") - F.col("total")) < 1e-9).alias("adds_up"))


@query("tree_shap_forest")
def tree_shap_forest(spark, sf):
    train, val = parts(V.vectors(spark, sf))
    det = T.fit_forest(train, "y", V.FEATURES)
    return X.global_importance(X.tree_contributions(det, val, "row_id"))
