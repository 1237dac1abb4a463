"""Profiles, distributions, correlations and fitted column preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.operators import preparation as prep, profile as P
from plantwatch.operators.splits import hash_split
from plantwatch.plans import views as V
from plantwatch.plans.audit_queries import SPLIT, labelled_documents
from plantwatch.plans.registry import query

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("value_counts", """select quality, count(*) as "count" from documents d left join labels l on d.doc_id = l.doc_id
  group by 1 order by 2 desc limit 20""")
def value_counts(spark, sf):
    return P.value_counts(labelled_documents(spark, sf), "quality")


@query("class_distribution", """select event_type, count(*) as "count",
  cast(count(*) as double) / (select count(*) from events) * 100 as percentage from events group by 1""")
def class_distribution(spark, sf):
    return P.class_distribution(V.table(spark, sf, "events"), "event_type")


@query("top_categories", """select source, count(*) as "count", cast(count(*) as double) / (select count(*) from documents) * 100 as percentage
  from documents group by 1 order by 2 desc, 1 limit 10""")
def top_categories(spark, sf):
    return P.class_distribution(V.table(spark, sf, "documents"), "source", 10)


@query("failure_rate_by_type", V.with_views(V.SCORED) + """select l_returnflag, count(*) as rows, cast(sum(y) as bigint) as failures,
  round(avg(y), 9) as failure_rate, round(avg(y)*100, 6) as failure_rate_pct from scored group by 1""")
def failure_rate_by_type(spark, sf):
    out = P.rate_by_group(V.scored(spark, sf), "l_returnflag", "y")
    return rounded(rounded(out, ["failure_rate"], 9), ["failure_rate_pct"])


@query("stats_by_class", "select l_returnflag, feature, round(avg(v), 4) as mean, round(quantile_cont(v, 0.5), 4) as median, "
       "round(stddev_samp(v), 4) as std from (" + " union all ".join(
           f"select l_returnflag, '{c}' as feature, {c} as v from lineitem" for c in NUM) + ") group by 1, 2")
def stats_by_class(spark, sf):
    return P.stats_by_class(V.table(spark, sf, "lineitem"), "l_returnflag", NUM)


@query("correlation_matrix", V.with_views(V.SCORED) + " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from scored" for a in [*NUM, "y"] for b in [*NUM, "y"]))
def correlation_matrix(spark, sf):
    return rounded(P.correlation_matrix(V.scored(spark, sf), [*NUM, "y"]), ["r"])


@query("target_correlations", V.with_views(V.SCORED) + " union all ".join(
    f"select '{a}' as feature, round(corr({a}, y), 6) as r from scored" for a in NUM))
def target_correlations(spark, sf):
    return rounded(P.target_correlations(V.scored(spark, sf), NUM, "y"), ["r"])


@query("feature_target_corr", V.with_views(V.FEAT) + "select feature, round(r, 6) as r from (" + " union all ".join(
    f"select '{f}' as feature, corr({f}, y) as r from feat" for f in V.FEATURES) + ") order by abs(r) desc, feature limit 20")
def feature_target_corr(spark, sf):
    return rounded(P.target_correlations(V.vectors(spark, sf), V.FEATURES, "y", 20), ["r"])


def describe_sql(columns, source):
    return "select * from (" + " union all ".join(
        f"""select '{c}' as feature, count({c}) as "count", round(avg({c}), 7) as mean, round(stddev_samp({c}), 6) as std,
  cast(min({c}) as double) as "min", round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50,
  round(quantile_cont({c}, 0.75), 6) as p75, cast(max({c}) as double) as "max" from {source}""" for c in columns) + ")"


@query("describe_features", describe_sql([*NUM, "l_linenumber"], "lineitem"))
def describe_features(spark, sf):
    out = P.describe_features(V.table(spark, sf, "lineitem"), [*NUM, "l_linenumber"])
    return rounded(rounded(out, ["std", "p25", "p50", "p75"]), ["mean"], 7)


@query("describe_vectors", V.with_views(V.FEAT) + describe_sql(V.FEATURES, "feat"))
def describe_vectors(spark, sf):
    out = P.describe_features(V.vectors(spark, sf), V.FEATURES)
    return rounded(rounded(out, ["std", "p25", "p50", "p75"]), ["mean"], 7)


PROF = {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double"}


@query("numeric_profile", "select *, n_unique <= 1 as is_constant, dominant_pct >= 99.5 as is_near_constant from (" + " union all ".join(
    f"""select '{c}' as feature, '{t}' as dtype, (select count(*) from (select distinct {c} from lineitem)) as n_unique,
  count(*) - count({c}) as missing_count, cast(count(*) - count({c}) as double) / count(*) * 100 as missing_pct,
  round(avg({c}), 7) as mean, round(stddev_samp({c}), 6) as std, cast(min({c}) as double) as "min", cast(max({c}) as double) as "max",
  cast((select max(n) from (select count(*) as n from lineitem group by {c})) as double) / count(*) * 100 as dominant_pct,
  cast((select count(*) from (select distinct {c} from lineitem)) as double) / count(*) >= 0.9 as is_id_like
  from lineitem""" for c, t in PROF.items()) + ")")
def numeric_profile(spark, sf):
    return rounded(rounded(P.numeric_profile(V.table(spark, sf, "lineitem"), list(PROF)), ["std"]), ["mean"], 7)


def text_sql(c, t, source):
    return f"""select '{c}' as feature, '{t}' as dtype, count(*) as n_unique, cast(sum(n) as bigint) as total,
  cast(coalesce(sum(case when v is null then n end), 0) as bigint) as missing_count,
  (arg_min(v, (-n, v is null, v))) as most_common_value, max(n) as most_common_count
  from (select cast({c} as varchar) as v, count(*) as n from {source} group by {c})"""


@query("categorical_profile", "select feature, dtype, n_unique, cast(n_unique as double) / total as unique_ratio, missing_count, "
       "cast(missing_count as double) / total * 100 as missing_pct, most_common_value, most_common_count, "
       "cast(most_common_count as double) / total * 100 as dominant_pct, "
       "cast(n_unique as double) / total >= 0.05 or n_unique >= 100 as is_high_cardinality from (" + " union all ".join(
           text_sql(c, "string", "documents") for c in ["lang", "source", "text"]) + ")")
def categorical_profile(spark, sf):
    return P.categorical_profile(V.table(spark, sf, "documents"), ["lang", "source", "text"])


MIXED = {"l_returnflag": "string", "l_quantity": "double", "l_linenumber": "int", "l_discount": "double"}


@query("mixed_profile", "select feature, dtype, n_unique, missing_count, cast(missing_count as double) / total * 100 as missing_pct, "
       "most_common_value, most_common_count, cast(most_common_count as double) / total * 100 as dominant_pct, "
       "n_unique <= 1 as is_constant, cast(most_common_count as double) / total * 100 >= 99.5 as is_near_constant from (" +
       " union all ".join(text_sql(c, t, "lineitem") for c, t in MIXED.items()) + ")")
def mixed_profile(spark, sf):
    return P.mixed_profile(V.table(spark, sf, "lineitem"), list(MIXED))


@query("class_histograms", """with r as (select l_returnflag, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem group by 1),
  c as (select l_returnflag, cast(least(floor((l_extendedprice - lo) * 30 / (hi - lo)), 29) as int) as bin, count(*) as n
    from lineitem join r using (l_returnflag) group by 1, 2)
  select r.l_returnflag, cast(b.bin as int) as bin, round(lo + b.bin * ((hi - lo) / 30), 6) as bin_lo,
  round(lo + (b.bin + 1) * ((hi - lo) / 30), 6) as bin_hi, coalesce(n, 0) as "count"
  from r cross join range(30) b(bin) left join c on c.l_returnflag = r.l_returnflag and c.bin = b.bin""")
def class_histograms(spark, sf):
    return rounded(P.class_histograms(V.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"),
                   ["bin_lo", "bin_hi"])


@query("imbalance", V.with_views(V.SCORED) + """select cast(sum(1 - y) as bigint) as negatives, cast(sum(y) as bigint) as positives,
  cast(sum(1 - y) as double) / sum(y) as scale_pos_weight, round(avg(y) * 100, 9) as positive_pct from scored""")
def imbalance(spark, sf):
    return rounded(P.imbalance(V.scored(spark, sf), "y"), ["positive_pct"], 9)


J = """j as (select d.doc_id, n_chars, quality, toxic, case when quality is not null then lang end as lang
  from documents d left join labels l on d.doc_id = l.doc_id)"""


def gaps(spark, sf):
    d = labelled_documents(spark, sf)
    return d.select("doc_id", "n_chars", "quality", "toxic",
                    F.when(F.col("quality").isNotNull(), F.col("lang")).alias("lang"))


@query("median_impute", V.with_views(J) + """select doc_id, coalesce(cast(quality as double), (select quantile_cont(quality, 0.5) from j)) as quality,
  coalesce(cast(toxic as double), (select quantile_cont(toxic, 0.5) from j)) as toxic,
  coalesce(cast(n_chars as double), (select quantile_cont(n_chars, 0.5) from j)) as n_chars from j""")
def median_impute(spark, sf):
    d = gaps(spark, sf)
    return prep.fill_medians(d, prep.medians(d, ["quality", "toxic", "n_chars"])).drop("lang")


@query("mode_impute", V.with_views(J) + """select doc_id, coalesce(lang, (select lang from j where lang is not null
  group by lang order by count(*) desc, lang limit 1)) as lang from j""")
def mode_impute(spark, sf):
    d = gaps(spark, sf).select("doc_id", "lang")
    return prep.fill_modes(d, prep.modes(d, ["lang"]))


@query("standard_scale", V.with_views(V.SCORED, "s as (select *, " + SPLIT.format(key="row_id") + " as split from scored)",
       "m as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in NUM) + " from s where split = 'train')") +
       "select row_id, split, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) as {c}" for c in NUM) + " from s, m")
def standard_scale(spark, sf):
    d = hash_split(V.scored(spark, sf).select("row_id", *NUM), "row_id")
    return rounded(prep.standardise(d, prep.scales(d.filter("split = 'train'"), NUM)), NUM)


@query("one_hot", "select doc_id, " + ", ".join(
    f"case when lang = '{v}' then 1 else 0 end as lang_{v}" for v in ["de", "en", "es", "fr"]) + " from documents")
def one_hot(spark, sf):
    d = hash_split(V.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return prep.one_hot(d, "lang", prep.categories(d.filter("split = 'train'"), "lang")).drop("lang", "split")


@query("class_weights", """select event_type, count(*) as n, cast((select count(*) from events) as double) /
  ((select count(distinct event_type) from events) * count(*)) as weight from events group by 1""")
def class_weights(spark, sf):
    return prep.class_weights(V.table(spark, sf, "events"), "event_type")
