"""Queries behind the reports: filters, joins, breakdowns, set operations, scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.functions import scalars as sc
from cpgloom.operators import metrics as m
from cpgloom.operators import ordering as o
from cpgloom.operators import relational as rel
from cpgloom.operators import selection as sel
from cpgloom.operators import strata as st
from cpgloom.plans import views as v
from cpgloom.plans.matrix_queries import R_SQL, TRAIN_SQL, train_cells
from cpgloom.plans.registry import query, r, rd, rounded
from cpgloom.session import scratch_path
from cpgloom.sources.tables import write_table

E, AE = "(y_pred - y_true)", "abs(y_pred - y_true)"
MODELS = ["AltumAge", "ElasticNet", "Ridge"]


# --- filters and projections ------------------------------------------------------------------


@query("b01_drop_null_ages", f"SELECT sample_id, {r('age')} AS age FROM annot WHERE age IS NOT NULL AND sample_id IS NOT NULL", "annot")
def _(spark, d):
    return rounded(v.annot(spark, d).dropna(subset=["age", "sample_id"]).select("sample_id", "age"))


@query("b02_select_renamed", "SELECT sample_id AS id, age AS chronological_age, ethnicity AS group_name FROM annot", "annot")
def _(spark, d):
    names = {"sample_id": "id", "sample_name": "name", "age": "chronological_age", "ethnicity": "group_name"}
    return rel.select_renamed(v.annot(spark, d), names)


@query("b03_alias_fallback", f"SELECT sample_id, {r('y_pred')} AS predicted_age FROM pred_long WHERE model = 'Ridge'", "pred_long")
def _(spark, d):
    up = v.preds(spark, d).where("model = 'Ridge'").select(F.col("sample_id").alias("Sample_Name"), F.col("y_pred").alias("age_pred"))
    return rounded(rel.alias_fallback(up, {"Sample_Name": "sample_id", "age_pred": "predicted_age", "prediction": "predicted_age"}))


@query("b04_model_filter", f"SELECT sample_id, {r('y_pred')} AS y_pred FROM pred_long WHERE model = 'ElasticNet'", "pred_long")
def _(spark, d):
    return rounded(v.preds(spark, d).where(F.col("model") == "ElasticNet").select("sample_id", "y_pred"))


BROWSE = f"""SELECT sample_description AS sample, sample_id,
 CASE WHEN lower(female) = 'true' THEN 'Femme' WHEN lower(female) = 'false' THEN 'Homme' ELSE '?' END AS sex,
 round(y_true, 6) AS age, round(y_pred, 6) AS predicted_age, round({E}, 6) + 0.0 AS delta_age, ethnicity, split AS "set" FROM pred_long"""


@query("b05_split_filter", f"SELECT split, count(*) AS n FROM pred_long WHERE model = 'Ridge' AND split = 'test' GROUP BY split", "pred_long")
def _(spark, d):
    return rel.browse_samples(v.preds(spark, d), "Ridge", split="test").groupBy(F.col("set").alias("split")).agg(F.count("*").alias("n"))


@query(
    "b06_text_search",
    "SELECT sample_id, sample_description FROM pred_long WHERE model = 'Ridge' AND contains(lower(sample_description), '7_r3')",
    "pred_long",
)
def _(spark, d):
    p = v.preds(spark, d).where("model = 'Ridge'")
    return p.where(rel.contains_text("sample_description", "7_R3")).select("sample_id", "sample_description")


@query(
    "b07_named_age_ranges",
    """SELECT 'young' AS age_range, count(*) FILTER (y_true < 30) AS n FROM pred_long UNION ALL
SELECT 'middle', count(*) FILTER (y_true BETWEEN 30 AND 60) FROM pred_long UNION ALL
SELECT 'old', count(*) FILTER (y_true > 60) FROM pred_long""",
    "pred_long",
)
def _(spark, d):
    names = ["young", "middle", "old"]
    counts = v.preds(spark, d).agg(*[F.count_if(rel.age_range("y_true", n)).alias(n) for n in names])
    return counts.unpivot([], names, "age_range", "n")


@query("b08_exclude_model", "SELECT model, count(*) AS n FROM pred_long WHERE model <> 'AltumAge' GROUP BY model", "pred_long")
def _(spark, d):
    return v.preds(spark, d).where(~F.col("model").eqNullSafe("AltumAge")).groupBy("model").agg(F.count("*").alias("n"))


@query(
    "b09_in_list",
    f"SELECT model_name, count(*) AS n, {r('min(mae_test)')} AS best FROM trials WHERE model_name IN ('Ridge', 'Lasso') GROUP BY model_name",
    "trials",
)
def _(spark, d):
    t = v.trials(spark, d).where(F.col("model_name").isin("Ridge", "Lasso"))
    return rounded(t.groupBy("model_name").agg(F.count("*").alias("n"), F.min("mae_test").alias("best")))


@query(
    "b10_half_open_range",
    f"SELECT model, count(*) AS n, {r(f'avg({AE})')} AS mae FROM pred_long WHERE y_true >= 40 AND y_true < 65 GROUP BY model",
    "pred_long",
)
def _(spark, d):
    p = v.preds(spark, d).where((F.col("y_true") >= 40) & (F.col("y_true") < 65))
    return rounded(p.groupBy("model").agg(F.count("*").alias("n"), F.avg(m.abs_err()).alias("mae")))


@query(
    "b11_pairwise_valid",
    f"SELECT probe_ord, count(*) AS n, {r('avg(beta)')} AS mean FROM aged WHERE beta IS NOT NULL AND age IS NOT NULL GROUP BY probe_ord HAVING count(*) >= 10",
    "aged",
)
def _(spark, d):
    ok = v.aged(spark, d).where("beta is not null and age is not null")
    return rounded(ok.groupBy("probe_ord").agg(F.count("*").alias("n"), F.avg("beta").alias("mean")).where("n >= 10"))


@query(
    "b12_threshold_tallies",
    f"""WITH s AS (SELECT probe_ord, {R_SQL} AS r FROM aged GROUP BY probe_ord)
SELECT count(*) AS n, count(*) FILTER (abs(r) > 0.1) AS above_01, count(*) FILTER (abs(r) > 0.3) AS above_03,
 count(*) FILTER (abs(r) > 0.5) AS above_05 FROM s""",
    "aged",
)
def _(spark, d):
    from cpgloom.operators.probe_stats import probe_correlation

    a = F.abs("r")
    return probe_correlation(v.aged(spark, d)).agg(
        F.count("*").alias("n"),
        F.count_if(a > 0.1).alias("above_01"),
        F.count_if(a > 0.3).alias("above_03"),
        F.count_if(a > 0.5).alias("above_05"),
    )


@query("b14_prefix_filter", "SELECT clock, count(*) AS n FROM clock_coef WHERE starts_with(probe_id, 'cg') GROUP BY clock", "clock_coef")
def _(spark, d):
    return v.clock_coef(spark, d).where(F.col("probe_id").startswith("cg")).groupBy("clock").agg(F.count("*").alias("n"))


@query(
    "b16_minimum_group_size",
    """WITH g AS (SELECT ethnicity FROM annot WHERE ethnicity IS NOT NULL GROUP BY ethnicity HAVING count(*) >= 3)
SELECT sample_id, ethnicity FROM annot WHERE ethnicity IN (SELECT ethnicity FROM g) AND (SELECT count(*) FROM g) >= 2""",
    "annot",
)
def _(spark, d):
    return st.large_groups(v.annot(spark, d), F.col("ethnicity"), 3, 2).select("sample_id", "ethnicity")


@query(
    "b17_percentile_cut",
    f"""WITH {TRAIN_SQL}, s AS (SELECT probe_ord, {R_SQL} AS r FROM train GROUP BY probe_ord)
SELECT probe_ord, {r('s.r')} AS r FROM s WHERE abs(s.r) > (SELECT quantile_cont(abs(r), 0.8) FROM s)""",
    "annot beta_long",
)
def _(spark, d):
    from cpgloom.operators.probe_stats import probe_correlation

    return rounded(st.percentile_cut(probe_correlation(train_cells(spark, d)), "r", 0.8))


@query("b18_known_category", "SELECT sample_id, female FROM annot WHERE female IS NOT NULL", "annot")
def _(spark, d):
    return v.annot(spark, d).where(F.col("female").isNotNull()).select("sample_id", "female")


@query(
    "b19_signed_outliers",
    f"""SELECT model, count(*) FILTER ({E} > 0) AS n_over, count(*) FILTER ({E} < 0) AS n_under,
 {r(f'avg({E}) FILTER ({E} > 0)')} AS mean_over, {r(f'avg({E}) FILTER ({E} < 0)')} AS mean_under FROM pred_long GROUP BY model""",
    "pred_long",
)
def _(spark, d):
    return rounded(st.signed_outliers(v.preds(spark, d)))


@query("a14_filtered_export", f"{BROWSE} WHERE model = 'ElasticNet' AND split = 'test' AND y_true BETWEEN 30 AND 60", "pred_long")
def _(spark, d):
    found = rel.browse_samples(v.preds(spark, d), "ElasticNet", "test", "", "middle", digits=6)
    path = scratch_path(spark, "export")
    write_table(found, path, "csv")
    return spark.read.option("header", True).schema(found.schema).csv(path)


# --- joins ------------------------------------------------------------------------------------


@query(
    "c01_sample_intersection",
    "SELECT vec_id AS header_ord, sample_id FROM annot WHERE age IS NOT NULL AND sample_id IN (SELECT sample_id FROM beta_long)",
    "annot beta_long",
)
def _(spark, d):
    header = v.annot(spark, d).select(F.col("vec_id").alias("header_ord"), "sample_id")
    known = v.annot(spark, d).where("age is not null")
    return rel.matched_ids(rel.matched_ids(header, known), v.beta(spark, d)).orderBy("header_ord")


@query("c02_label_lookup", f"SELECT sample_id, probe_ord, {r('age')} AS age FROM aged WHERE beta IS NOT NULL", "aged")
def _(spark, d):
    return rounded(v.aged(spark, d).where("beta is not null").select("sample_id", "probe_ord", "age"))


@query(
    "c05_name_to_ordinal",
    """SELECT c.clock, c.probe_id, p.probe_ord FROM clock_coef c JOIN probes p ON c.probe_id = p.probe_id""",
    "clock_coef probes",
)
def _(spark, d):
    return v.clock_coef(spark, d).join(v.probes(spark, d), "probe_id").select("clock", "probe_id", "probe_ord")


@query(
    "c06_ordinal_semi_join",
    f"SELECT sample_id, probe_ord, {r('beta', 9)} AS beta FROM beta_long WHERE probe_ord IN (SELECT probe_ord FROM probes WHERE probe_ord % 10 = 0)",
    "beta_long probes",
)
def _(spark, d):
    chosen = v.probes(spark, d).where("probe_ord % 10 = 0")
    return rounded(sel.keep_probes(v.beta(spark, d), chosen).select("sample_id", "probe_ord", "beta"), digits=9)


@query(
    "a08_rows_in_rank_order",
    f"""WITH {TRAIN_SQL}, s AS (SELECT probe_ord, {R_SQL} AS r FROM train GROUP BY probe_ord),
k AS (SELECT probe_ord, row_number() OVER (ORDER BY abs(r) DESC, probe_ord) AS rank FROM s)
SELECT b.sample_id, k.rank, b.probe_ord, {r('beta', 9)} AS beta FROM beta_long b JOIN k ON b.probe_ord = k.probe_ord WHERE rank <= 5""",
    "annot beta_long",
)
def _(spark, d):
    best = sel.top_correlated(train_cells(spark, d), 5)
    return rounded(sel.keep_probes(v.beta(spark, d), best, ("rank",)).select("sample_id", "rank", "probe_ord", "beta"), digits=9)


@query(
    "c07_positional_names",
    "SELECT b.probe_ord, p.probe_id, count(*) AS n FROM beta_long b JOIN probes p ON b.probe_ord = p.probe_ord GROUP BY ALL",
    "beta_long probes",
)
def _(spark, d):
    return v.beta(spark, d).groupBy("probe_ord").agg(F.count("*").alias("n")).join(v.probes(spark, d), "probe_ord")


@query(
    "c08_annotated_predictions",
    f"""SELECT p.model, p.sample_id, a.sample_id AS annot_id, a.female AS annot_female, {r('p.y_pred')} AS y_pred
FROM pred_long p LEFT JOIN annot a ON p.sample_id = a.vec_id""",
    "pred_long annot",
)
def _(spark, d):
    a = v.annot(spark, d).select(F.col("sample_id").alias("annot_id"), "vec_id", F.col("female").alias("annot_female"))
    a = st.first_per_key(a, ["vec_id"], ["annot_id"])
    p = v.preds(spark, d).select("model", "sample_id", "y_pred")
    return rounded(p.join(a, p.sample_id == a.vec_id, "left").drop("vec_id"))


@query(
    "c09_first_value_map",
    f"""WITH f AS (SELECT sample_description, min(sample_id) AS first_id FROM pred_long GROUP BY sample_description)
SELECT DISTINCT p.sample_description, f.first_id, {r('q.y_true')} AS first_age FROM pred_long p
JOIN f ON p.sample_description = f.sample_description JOIN pred_long q ON q.sample_id = f.first_id""",
    "pred_long",
)
def _(spark, d):
    p = v.preds(spark, d)
    firsts = p.groupBy("sample_description").agg(F.min("sample_id").alias("first_id"), F.min_by("y_true", "sample_id").alias("first_age"))
    return rounded(firsts)


@query(
    "c11_feature_concat",
    f"""WITH b AS (SELECT sample_id, avg(beta) AS mean, var_pop(beta) AS var FROM beta_long GROUP BY sample_id),
x AS (SELECT sample_id, CASE lower(female) WHEN 'true' THEN 1.0::DOUBLE WHEN 'false' THEN 0.0 END AS s FROM annot),
f AS (SELECT sample_id, coalesce(s, (SELECT avg(s) FROM x)) AS s FROM x)
SELECT b.sample_id, {r('mean')} AS f1, {r('var')} AS f2, {r('s')} AS f3 FROM b JOIN f ON b.sample_id = f.sample_id""",
    "beta_long annot",
)
def _(spark, d):
    from cpgloom.operators.probe_stats import sample_moments

    one = sample_moments(v.beta(spark, d)).select("sample_id", F.array("mean", "variance").alias("features"))
    sex = v.annot(spark, d).select("sample_id", sc.parse_bool("female").cast("double").alias("s"))
    mean = sex.agg(F.avg("s").alias("m")).select("m").scalar()
    two = sex.select("sample_id", F.array(F.coalesce("s", mean)).alias("features"))
    out = rel.feature_blocks([one, two])
    return rounded(out.select("sample_id", *[F.col("features")[i].alias(f"f{i + 1}") for i in range(3)]))


@query(
    "c12_clock_coverage",
    f"""SELECT c.clock, count(p.probe_id) AS found, count(*) AS total, {r('100.0::DOUBLE * count(p.probe_id) / count(*)')} AS pct
FROM clock_coef c LEFT JOIN probes p ON c.probe_id = p.probe_id GROUP BY c.clock""",
    "clock_coef probes",
)
def _(spark, d):
    return rounded(rel.coverage(v.clock_coef(spark, d), v.probes(spark, d)))


@query(
    "c13_densified_age_bins",
    f"""WITH grid AS (SELECT model, CAST(lo AS DOUBLE) AS age_bin FROM (SELECT unnest(['Ridge', 'ElasticNet', 'Lasso']) AS model),
  range(20, 90, 5) t(lo)),
s AS (SELECT model, floor((y_true - 20 - 1e-9) / 5) * 5 + 20 AS age_bin, {E} AS e FROM pred_long WHERE y_true > 20 AND y_true <= 90)
SELECT g.model, g.age_bin, count(e) FILTER (e > 0) AS pos_count, count(e) FILTER (e < 0) AS neg_count,
 {r('coalesce(avg(e) FILTER (e > 0), 0)')} AS pos_mean, {r('coalesce(avg(e) FILTER (e < 0), 0)')} AS neg_mean,
 count(e) AS total, {r('coalesce(avg(abs(e)), 0)')} AS mae
FROM grid g LEFT JOIN s ON g.model = s.model AND g.age_bin = s.age_bin GROUP BY g.model, g.age_bin""",
    "pred_long",
)
def _(spark, d):
    return rounded(st.stream_cells(v.preds(spark, d), ["Ridge", "ElasticNet", "Lasso"], list(range(20, 95, 5))))


@query(
    "d38_signed_error_stream",
    f"""SELECT model, bin AS age_bin, count(*) FILTER (e > 0) AS pos_count, count(*) FILTER (e < 0) AS neg_count, count(*) AS total,
 {r('avg(abs(e))')} AS mae FROM (SELECT model, ceil((y_true - 20) / 5) * 5 + 15 AS bin, {E} AS e FROM pred_long
 WHERE model <> 'AltumAge' AND y_true > 20 AND y_true <= 90) GROUP BY model, bin""",
    "pred_long",
)
def _(spark, d):
    cells = st.stream_cells(v.preds(spark, d), ["Ridge", "ElasticNet"], list(range(20, 95, 5)))
    return rounded(cells.where("total > 0").select("model", "age_bin", "pos_count", "neg_count", "total", "mae"))


@query(
    "c14_interval_join",
    f"""WITH b AS (SELECT * FROM (VALUES (0.0::DOUBLE, 30.0::DOUBLE, '<30'), (30, 50, '30-50'), (50, 70, '50-70'), (70, 100, '>70')) t(lo, hi, label))
SELECT model, label, count(*) AS n, {r(f'avg({AE})')} AS mae FROM pred_long p JOIN b ON p.y_true > b.lo AND p.y_true <= b.hi GROUP BY model, label""",
    "pred_long",
)
def _(spark, d):
    label = sc.bin_by("y_true", [0, 30, 50, 70, 100], ["<30", "30-50", "50-70", ">70"])
    p = v.preds(spark, d).withColumn("label", label).where("label is not null")
    return rounded(p.groupBy("model", "label").agg(F.count("*").alias("n"), F.avg(m.abs_err()).alias("mae")))


@query(
    "c16_union_of_new_names",
    f"""WITH a AS (SELECT model, avg({AE}) AS mae FROM pred_long WHERE model <> 'Ridge' GROUP BY model),
b AS (SELECT model_name AS model, avg(mae_test) AS mae FROM trials GROUP BY model_name)
SELECT model, {r('mae')} AS mae FROM a UNION ALL SELECT model, {r('mae')} FROM b WHERE model NOT IN (SELECT model FROM a)""",
    "pred_long trials",
)
def _(spark, d):
    a = v.preds(spark, d).where("model <> 'Ridge'").groupBy(F.concat(F.lit("1. "), "model").alias("model")).agg(F.avg(m.abs_err()).alias("mae"))
    b = v.trials(spark, d).groupBy(F.col("model_name").alias("model")).agg(F.avg("mae_test").alias("mae"))
    return rounded(rel.union_new_names(a, b))


# --- aggregates -------------------------------------------------------------------------------


@query(
    "d06_group_mean_sd",
    f"""WITH s AS (SELECT sample_id, avg(beta) AS m, var_pop(beta) AS q FROM beta_long GROUP BY sample_id)
SELECT coalesce(female, 'none') AS female, {r('avg(m)')} AS mean_of_means, {r('stddev_samp(m)')} AS sd_of_means,
 {r('avg(q)')} AS mean_of_variances, {r('stddev_samp(q)')} AS sd_of_variances
FROM s JOIN annot a ON s.sample_id = a.sample_id GROUP BY female""",
    "beta_long annot",
)
def _(spark, d):
    from cpgloom.operators.probe_stats import sample_moments

    s = sample_moments(v.beta(spark, d)).join(v.annot(spark, d).select("sample_id", "female"), "sample_id")
    return rounded(
        s.groupBy(F.coalesce("female", F.lit("none")).alias("female")).agg(
            F.avg("mean").alias("mean_of_means"),
            F.stddev_samp("mean").alias("sd_of_means"),
            F.avg("variance").alias("mean_of_variances"),
            F.stddev_samp("variance").alias("sd_of_variances"),
        )
    )


@query(
    "d07_frequency_table",
    f"""SELECT coalesce(ethnicity, 'none') AS ethnicity, count(*) AS n, {r('100.0::DOUBLE * count(*) / (SELECT count(*) FROM annot)')} AS pct
FROM annot GROUP BY ethnicity""",
    "annot",
)
def _(spark, d):
    a = v.annot(spark, d).select(F.coalesce("ethnicity", F.lit("none")).alias("ethnicity"))
    return rounded(st.frequency(a, "ethnicity").orderBy(F.desc("n"), "ethnicity"))


@query(
    "d08_describe_ages",
    f"""SELECT count(age) AS count, {r('avg(age)')} AS mean, {r('stddev_samp(age)')} AS std, {r('min(age)')} AS min, {r('max(age)')} AS max,
 {r('quantile_cont(age, 0.25)')} AS q25, {r('quantile_cont(age, 0.5)')} AS q50, {r('quantile_cont(age, 0.75)')} AS q75 FROM annot""",
    "annot",
)
def _(spark, d):
    return rounded(st.describe(v.annot(spark, d), "age"))


@query(
    "d13_mae_by_category",
    f"""SELECT 'gender' AS kind, model, CASE female WHEN 'True' THEN 'F' ELSE 'M' END AS category, {r(f'avg({AE})')} AS mae, count(*) AS n
FROM pred_long GROUP BY model, female UNION ALL
SELECT 'ethnicity', model, ethnicity, {r(f'avg({AE})')}, count(*) FROM pred_long GROUP BY model, ethnicity""",
    "pred_long",
)
def _(spark, d):
    p = v.preds(spark, d).withColumn("sex", sc.sex_label("female"))
    a = st.mae_by(p, "model", "sex").withColumnRenamed("sex", "category").withColumn("kind", F.lit("gender"))
    b = st.mae_by(p, "model", "ethnicity").withColumnRenamed("ethnicity", "category").withColumn("kind", F.lit("ethnicity"))
    return rounded(a.unionByName(b))


@query(
    "d14_error_by_age_group",
    f"""WITH b AS (SELECT model, {AE} AS ae, CASE WHEN y_true <= 30 THEN '0-30' WHEN y_true <= 45 THEN '30-45' WHEN y_true <= 60 THEN '45-60'
 WHEN y_true <= 75 THEN '60-75' ELSE '75-100' END AS age_group FROM pred_long)
SELECT model, age_group, {r('avg(ae)')} AS mae, {r('stddev_samp(ae)')} AS sd, count(*) AS n FROM b GROUP BY model, age_group""",
    "pred_long",
)
def _(spark, d):
    labels = ["0-30", "30-45", "45-60", "60-75", "75-100"]
    return rounded(st.mae_spread_by_band(v.preds(spark, d), [0, 30, 45, 60, 75, 100], labels))


@query(
    "d15_demographic_hierarchy",
    f"""WITH b AS (SELECT CASE female WHEN 'True' THEN 'F' ELSE 'M' END AS gender, ethnicity, {AE} AS ae,
 CASE WHEN y_true <= 35 THEN 'Young' WHEN y_true <= 55 THEN 'Middle' WHEN y_true <= 75 THEN 'Senior' ELSE 'Elderly' END AS age_group
 FROM pred_long WHERE model = 'ElasticNet')
SELECT gender, ethnicity, age_group, {r('avg(ae)')} AS mae, count(*) AS n,
 CAST(grouping_id(gender, ethnicity, age_group) AS BIGINT) AS level_id FROM b GROUP BY ROLLUP (gender, ethnicity, age_group)""",
    "pred_long",
)
def _(spark, d):
    p = v.preds(spark, d).where("model = 'ElasticNet'").withColumns(
        {
            "gender": sc.sex_label("female"),
            "age_group": sc.bin_by("y_true", [0, 35, 55, 75, 100], ["Young", "Middle", "Senior", "Elderly"]),
        }
    )
    return rounded(st.sunburst(p, ["gender", "ethnicity", "age_group"]))


@query(
    "d16_config_model_pivot",
    f"""WITH g AS (SELECT strategy || '_' || CAST(n_features AS VARCHAR) AS config, model_name, avg(mae_test) AS mae FROM trials GROUP BY ALL)
SELECT config, {r("max(mae) FILTER (model_name = 'ElasticNet')")} AS "ElasticNet", {r("max(mae) FILTER (model_name = 'Lasso')")} AS "Lasso",
 {r("max(mae) FILTER (model_name = 'Ridge')")} AS "Ridge", {r('avg(mae)')} AS row_mean FROM g GROUP BY config""",
    "trials",
)
def _(spark, d):
    return rounded(st.config_pivot(v.trials(spark, d), ["ElasticNet", "Lasso", "Ridge"]))


@query(
    "d17_model_agreement",
    f"""SELECT sample_id, {", ".join(r(f"max(y_pred) FILTER (model = '{x}')", 6) + f' AS "{x}"' for x in MODELS)},
 {r('avg(y_pred)', 6)} AS mean, {r('stddev_samp(y_pred)', 6)} AS sd, {r('min(y_true)', 6)} AS y_true FROM pred_long GROUP BY sample_id""",
    "pred_long",
)
def _(spark, d):
    return rounded(st.model_agreement(v.preds(spark, d), MODELS), digits=6)


@query(
    "d18_best_trial_per_group",
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY strategy, model_name ORDER BY mae_test, trial_id) AS rn FROM trials)
SELECT strategy, model_name, trial_id, {r('mae_test')} AS mae_test, n_features, n_trials FROM k WHERE rn = 1""",
    "trials",
)
def _(spark, d):
    best = st.best_trial(v.trials(spark, d), ["strategy", "model_name"])
    return rounded(best.select("strategy", "model_name", "trial_id", "mae_test", "n_features", "n_trials"))


@query(
    "d19_best_and_worst_model",
    f"""WITH x AS (SELECT model, avg({AE}) AS mae FROM pred_long GROUP BY model)
SELECT min_by(model, mae) AS best, max_by(model, mae) AS worst, {r('min(mae)')} AS best_mae, {r('max(mae)')} AS worst_mae FROM x""",
    "pred_long",
)
def _(spark, d):
    x = v.preds(spark, d).groupBy("model").agg(F.avg(m.abs_err()).alias("mae"))
    return rounded(
        x.agg(
            F.min_by("model", F.struct("mae", "model")).alias("best"),
            F.max_by("model", F.struct("mae", "model")).alias("worst"),
            F.min("mae").alias("best_mae"),
            F.max("mae").alias("worst_mae"),
        )
    )


CHIPS = f"""chips AS (SELECT model, split_part(sample_description, '_R', 1) AS chip, avg({E}) AS mean, stddev_samp({E}) AS sd, count(*) AS n
 FROM pred_long GROUP BY ALL HAVING count(*) >= 3)"""


@query("d20_batch_effect", f"WITH {CHIPS} SELECT model, chip, {r('mean')} AS mean, {r('sd')} AS sd, n FROM chips", "pred_long")
def _(spark, d):
    return rounded(st.batch_effect(v.preds(spark, d)))


@query(
    "d20_inter_batch_spread",
    f"WITH {CHIPS} SELECT model, count(*) AS n_chips, {r('stddev_samp(mean)')} AS inter_batch_sd FROM chips GROUP BY model HAVING count(*) >= 2",
    "pred_long",
)
def _(spark, d):
    return rounded(st.batch_spread(v.preds(spark, d)))


@query(
    "d27_error_histogram",
    f"""WITH s AS (SELECT model, {E} AS e FROM pred_long), b AS (SELECT model, min(e) AS lo, max(e) AS hi, count(*) AS c FROM s GROUP BY model),
k AS (SELECT s.model, lo, hi, c, least(CAST(floor((e - lo) / ((hi - lo) / 30)) AS BIGINT), 29) AS bin FROM s JOIN b ON s.model = b.model)
SELECT model, bin, {r('lo + bin * ((hi - lo) / 30)')} AS left_edge, count(*) AS n, {r('count(*) / c / ((hi - lo) / 30)')} AS density
FROM k GROUP BY model, bin, lo, hi, c""",
    "pred_long",
)
def _(spark, d):
    return rounded(st.histogram(v.preds(spark, d).withColumn("e", m.err()), "e", 30, ["model"]))


@query(
    "d28_density_grid",
    """WITH b AS (SELECT model, min(y_true) AS lx, max(y_true) AS hx, min(y_pred) AS ly, max(y_pred) AS hy FROM pred_long GROUP BY model)
SELECT p.model, least(CAST(floor((y_true - lx) / ((hx - lx) / 20)) AS BIGINT), 19) AS x_bin,
 least(CAST(floor((y_pred - ly) / ((hy - ly) / 20)) AS BIGINT), 19) AS y_bin, count(*) AS n
FROM pred_long p JOIN b ON p.model = b.model GROUP BY ALL""",
    "pred_long",
)
def _(spark, d):
    return st.density_grid(v.preds(spark, d), "y_true", "y_pred", 20)


@query(
    "d29_box_statistics",
    f"""WITH s AS (SELECT model, female, {E} AS e FROM pred_long),
q AS (SELECT model, female, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS median, quantile_cont(e, 0.75) AS q3 FROM s GROUP BY ALL)
SELECT s.model, s.female, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
 {r('min(e) FILTER (e BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_low,
 {r('max(e) FILTER (e BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_high,
 count(*) FILTER (NOT (e BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM s JOIN q ON s.model = q.model AND s.female = q.female GROUP BY s.model, s.female, q1, median, q3""",
    "pred_long",
)
def _(spark, d):
    return rounded(st.box_stats(v.preds(spark, d).withColumn("e", m.err()), "e", ["model", "female"]))


@query(
    "d30_models_by_median_error",
    f"SELECT model, {r(f'quantile_cont({AE}, 0.5)')} AS median_abs_error FROM pred_long GROUP BY model",
    "pred_long",
)
def _(spark, d):
    return rounded(st.models_by_median_error(v.preds(spark, d)))


@query(
    "d31_error_density",
    f"""WITH s AS (SELECT model, {E} AS e FROM pred_long), b AS (SELECT model, min(e) AS lo, max(e) AS hi, count(*) AS n,
  stddev_samp(e) * count(*) ** (-0.2::DOUBLE) AS h FROM s GROUP BY model),
g AS (SELECT b.*, CAST(i AS BIGINT) AS point, lo + i * (hi - lo) / 199 AS x FROM b, range(200) t(i))
SELECT g.model, point, {r('x')} AS x, {r('sum(exp((x - e) * (e - x) / (h * h) / 2)) / (n * h * sqrt(2 * pi()))', 8)} AS density
FROM g JOIN s ON s.model = g.model GROUP BY g.model, point, x, n, h""",
    "pred_long",
)
def _(spark, d):
    k = st.kde(v.preds(spark, d).withColumn("e", m.err()), "e", "model")
    return rounded(rounded(k, "x"), "density", digits=8)


@query(
    "d39_affinity_weights",
    f"SELECT ethnicity, model, {r(f'greatest(0, 10 - avg({AE})) * count(*) / 50')} AS weight FROM pred_long GROUP BY ethnicity, model",
    "pred_long",
)
def _(spark, d):
    return rounded(st.affinity(v.preds(spark, d), MODELS))


@query(
    "d40_normalised_metrics",
    f"""WITH x AS (SELECT model, avg({AE}) AS mae, sqrt(avg({E} * {E})) AS rmse,
 1 - sum({E} * {E}) / (var_pop(y_true) * count(*)) AS r2 FROM pred_long GROUP BY model)
SELECT model, {r('1 - (mae - min(mae) OVER ()) / (max(mae) OVER () - min(mae) OVER () + 0.001)')} AS mae,
 {r('1 - (rmse - min(rmse) OVER ()) / (max(rmse) OVER () - min(rmse) OVER () + 0.001)')} AS rmse,
 {r('(x.r2 - min(x.r2) OVER ()) / (max(x.r2) OVER () - min(x.r2) OVER () + 0.001)')} AS r2 FROM x""",
    "pred_long",
)
def _(spark, d):
    e = m.err()
    x = v.preds(spark, d).groupBy("model").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), m.r_squared().alias("r2")
    )
    return rounded(st.normalise_metrics(x, ["mae", "rmse"], ["r2"]))


@query(
    "d42_inverse_error_ensemble",
    f"""WITH w AS (SELECT model, avg({AE}) AS mae FROM pred_long GROUP BY model)
SELECT sample_id, {r('min(y_true)', 6)} AS y_true, {r('avg(y_pred)', 6)} AS simple, {r('sum(y_pred / mae) / sum(1 / mae)', 6)} AS weighted,
 {r('avg(y_pred) FILTER (mae < 5)', 6)} AS selected FROM pred_long p JOIN w ON p.model = w.model GROUP BY sample_id""",
    "pred_long",
)
def _(spark, d):
    return rounded(st.inverse_error_ensemble(v.preds(spark, d), max_mae=5.0), digits=6)


@query(
    "d43_prediction_correlations",
    f"""WITH l AS (SELECT model AS name, sample_id, y_pred AS x FROM pred_long UNION ALL
 SELECT 'y_true', sample_id, min(y_true) FROM pred_long GROUP BY sample_id)
SELECT a.name AS a, b.name AS b, {r('covar_pop(a.x, b.x) / (sqrt(var_pop(a.x)) * sqrt(var_pop(b.x)))')} AS r
FROM l a JOIN l b ON a.sample_id = b.sample_id GROUP BY a.name, b.name""",
    "pred_long",
)
def _(spark, d):
    return rounded(st.error_correlations(v.preds(spark, d), MODELS))


@query(
    "d45_tuning_summary",
    f"""SELECT count(*) AS n, {r('min(mae_test)')} AS best_mae, {r('max(mae_test)')} AS worst_mae, {r('avg(mae_test)')} AS mean_mae,
 {r('sum(time_min)', 4)} AS total_min, {r('sum(time_min) / 60', 4)} AS total_h, count(*) FILTER (overfitting_ratio < 2) AS n_ratio_below_2,
 count(*) FILTER (overfitting_ratio < 3) AS n_ratio_below_3, count(*) FILTER (overfitting_ratio > 5) AS n_ratio_above_5,
 (SELECT model_name FROM trials ORDER BY mae_test, trial_id LIMIT 1) AS best_model,
 {r("min(mae_test) FILTER (model_name IN ('Ridge', 'Lasso', 'ElasticNet'))")} AS best_linear,
 {r("min(mae_test) FILTER (model_name = 'Lasso')")} AS best_sparse FROM trials""",
    "trials",
)
def _(spark, d):
    s = st.trial_summary(v.trials(spark, d), {"linear": ["Ridge", "Lasso", "ElasticNet"], "sparse": ["Lasso"]})
    return rounded(rounded(s, "total_min", "total_h", digits=4), "best_mae", "worst_mae", "mean_mae", "best_linear", "best_sparse")


@query(
    "d46_best_config",
    f"""WITH g AS (SELECT strategy || '_' || CAST(n_features AS VARCHAR) AS config, avg(mae_test) AS mae FROM trials GROUP BY ALL)
SELECT config, {r('mae')} AS mae FROM g ORDER BY g.mae, config LIMIT 1""",
    "trials",
)
def _(spark, d):
    g = v.trials(spark, d).groupBy(sc.config_key("strategy", "n_features").alias("config")).agg(F.avg("mae_test").alias("mae"))
    return rounded(g.agg(F.min(F.struct("mae", "config")).alias("b")).select("b.config", "b.mae"))


@query("d47_nonzero_coefficients", "SELECT clock, count(*) FILTER (coef <> 0) AS nonzero, count(*) AS n FROM clock_coef GROUP BY clock", "clock_coef")
def _(spark, d):
    return v.clock_coef(spark, d).groupBy("clock").agg(F.count_if(F.col("coef") != 0).alias("nonzero"), F.count("*").alias("n"))


@query(
    "d48_improvement_by_fold",
    f"""WITH w AS (SELECT fold, max(mae) FILTER (model = 'Ridge') AS a, max(mae) FILTER (model = 'ElasticNet') AS b FROM fold_scores GROUP BY fold)
SELECT fold, {r('a')} AS base_mae, {r('b')} AS other_mae, {r('a - b')} AS delta, {r('(a - b) * 100 / a')} AS pct FROM w""",
    "fold_scores",
)
def _(spark, d):
    return rounded(st.improvement_by_fold(v.fold_scores(spark, d), "Ridge", "ElasticNet"))


@query(
    "d49_bias_by_band",
    f"""WITH b AS (SELECT *, CASE WHEN y_true > 30 AND y_true <= 40 THEN '30-40' WHEN y_true > 40 AND y_true <= 50 THEN '40-50'
 WHEN y_true > 50 AND y_true <= 60 THEN '50-60' WHEN y_true > 60 AND y_true <= 70 THEN '60-70' WHEN y_true > 70 AND y_true <= 85 THEN '70-85' END AS band
 FROM pred_long WHERE model IN ('Ridge', 'ElasticNet'))
SELECT band, count(*) AS n, {r(f"avg({E}) FILTER (model = 'Ridge')")} AS "bias_Ridge", {r(f"avg({AE}) FILTER (model = 'Ridge')")} AS "mae_Ridge",
 {r(f"avg({E}) FILTER (model = 'ElasticNet')")} AS "bias_ElasticNet", {r(f"avg({AE}) FILTER (model = 'ElasticNet')")} AS "mae_ElasticNet"
FROM b WHERE band IS NOT NULL GROUP BY band""",
    "pred_long",
)
def _(spark, d):
    return rounded(st.bias_by_band(v.preds(spark, d), ["Ridge", "ElasticNet"], [30, 40, 50, 60, 70, 85]))


@query("d50_distinct_in_order", "SELECT ethnicity, min(sample_id) AS first_at FROM pred_long GROUP BY ethnicity", "pred_long")
def _(spark, d):
    return st.distinct_in_order(v.preds(spark, d), "ethnicity", "sample_id")


# --- ordered operators ------------------------------------------------------------------------


@query(
    "w06_best_so_far",
    f"""SELECT trial_id, model_name, row_number() OVER w AS rn, {r('min(mae_test) OVER w')} AS best_so_far FROM trials
WINDOW w AS (PARTITION BY model_name ORDER BY trial_id ROWS UNBOUNDED PRECEDING)""",
    "trials",
)
def _(spark, d):
    rows = o.numbered(v.trials(spark, d).select("trial_id", "model_name", "mae_test"), ["model_name"], ["trial_id"])
    best = o.running(rows, ["model_name"], "rn", "mae_test", "best_so_far", "min")
    return rounded(best.select("trial_id", "model_name", "rn", "best_so_far"))


@query(
    "w10_waterfall",
    f"""WITH x AS (SELECT model, avg({AE}) AS mae FROM pred_long WHERE model <> 'AltumAge' GROUP BY model)
SELECT row_number() OVER w AS position, model, {r('mae')} AS mae, {r('mae - coalesce(lag(mae) OVER w, 0)')} AS step
FROM x WINDOW w AS (ORDER BY x.mae, model)""",
    "pred_long",
)
def _(spark, d):
    x = v.preds(spark, d).groupBy("model").agg(F.avg(m.abs_err()).alias("mae"))
    return rounded(st.waterfall(x))


@query(
    "w11_first_row_per_key",
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY sample_description ORDER BY sample_id, model) AS rn FROM pred_long)
SELECT sample_description, sample_id, model, {r('y_pred')} AS y_pred FROM k WHERE rn = 1""",
    "pred_long",
)
def _(spark, d):
    p = v.preds(spark, d).select("sample_description", "sample_id", "model", "y_pred")
    return rounded(st.first_per_key(p, ["sample_description"], ["sample_id", "model"]))


@query(
    "s01_sorted_models",
    f"SELECT model, {r(f'avg({AE})')} AS mae, count(*) AS n FROM pred_long GROUP BY model ORDER BY 2 DESC",
    "pred_long",
)
def _(spark, d):
    return rounded(st.mae_by(v.preds(spark, d), "model").orderBy(F.desc("mae")))


COEF_TOP = "SELECT clock, probe_id, coef, abs(coef) AS abs_coef FROM clock_coef ORDER BY abs(coef) DESC, probe_id, clock LIMIT {n}"


@query("s02_head_of_coefficients", COEF_TOP.format(n=40), "clock_coef")
def _(spark, d):
    c = v.clock_coef(spark, d).select("clock", "probe_id", "coef", F.abs("coef").alias("abs_coef"))
    return sel.top_rows(c, F.desc("abs_coef"), 40, "probe_id", "clock")


@query(
    "s05_largest_errors",
    f"SELECT model, sample_id, {r(AE)} AS abs_error FROM pred_long ORDER BY {AE} DESC, sample_id, model LIMIT 10",
    "pred_long",
)
def _(spark, d):
    p = v.preds(spark, d).select("model", "sample_id", m.abs_err().alias("abs_error"))
    return rounded(sel.top_rows(p, F.desc("abs_error"), 10, "sample_id", "model"))


@query(
    "s06_frequent_categories",
    """WITH t AS (SELECT ethnicity FROM pred_long GROUP BY ethnicity ORDER BY count(*) DESC, ethnicity LIMIT 3)
SELECT model, sample_id, ethnicity FROM pred_long WHERE ethnicity IN (SELECT ethnicity FROM t)""",
    "pred_long",
)
def _(spark, d):
    return sel.frequent_categories(v.preds(spark, d), "ethnicity", 3).select("model", "sample_id", "ethnicity")


# --- set operations ---------------------------------------------------------------------------


@query(
    "t01_union_of_results",
    f"""SELECT model, {r(f'avg({AE})')} AS mae, 'predictions' AS source FROM pred_long GROUP BY model UNION ALL
SELECT model_name, {r('min(mae_test)')}, 'trials' FROM trials GROUP BY model_name""",
    "pred_long trials",
)
def _(spark, d):
    a = v.preds(spark, d).groupBy("model").agg(F.avg(m.abs_err()).alias("mae")).withColumn("source", F.lit("predictions"))
    b = v.trials(spark, d).groupBy(F.col("model_name").alias("model")).agg(F.min("mae_test").alias("mae"))
    return rounded(a.unionByName(b.withColumn("source", F.lit("trials"))))


@query(
    "t02_required_probes",
    " UNION ".join(f"SELECT probe_id FROM clock_coef WHERE clock = 'clock{i}'" for i in range(1, 6)),
    "clock_coef",
)
def _(spark, d):
    c = v.clock_coef(spark, d)
    lists = [c.where(F.col("clock") == f"clock{i}").select("probe_id") for i in range(1, 6)]
    return reduce(DataFrame.union, lists).distinct()


@query(
    "t03_id_sets",
    """WITH a AS (SELECT sample_id FROM annot WHERE age IS NOT NULL), b AS (SELECT sample_id FROM annot WHERE female IS NOT NULL)
SELECT 'both' AS kind, sample_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
SELECT 'only_age', sample_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "annot",
)
def _(spark, d):
    a = v.annot(spark, d).where("age is not null").select("sample_id")
    b = v.annot(spark, d).where("female is not null").select("sample_id")
    both = a.intersect(b).select(F.lit("both").alias("kind"), "sample_id")
    return both.union(a.subtract(b).select(F.lit("only_age").alias("kind"), "sample_id"))


@query(
    "t04_train_without_validation",
    """WITH k AS (SELECT sample_id, row_number() OVER (ORDER BY md5(sample_id || '|7'), sample_id) AS rn, count(*) OVER () AS n
 FROM annot WHERE age IS NOT NULL)
SELECT sample_id FROM k WHERE rn > greatest(20, n // 5)""",
    "annot",
)
def _(spark, d):
    from cpgloom.operators.splits import validation_split

    ids = v.annot(spark, d).where("age is not null").select("sample_id")
    held = validation_split(ids).where("is_validation").select("sample_id")
    return ids.join(held, "sample_id", "left_anti")


@query(
    "t05_union_without_duplicates",
    f"""WITH u AS (SELECT model, avg({AE}) AS mae, 1 AS p FROM pred_long GROUP BY model UNION ALL
 SELECT model_name, avg(mae_test), 2 FROM trials GROUP BY model_name),
k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p) AS rn FROM u)
SELECT model, {r('mae')} AS mae, CAST(p AS BIGINT) AS priority FROM k WHERE rn = 1""",
    "pred_long trials",
)
def _(spark, d):
    a = v.preds(spark, d).groupBy(F.concat(F.lit("2. "), "model").alias("model")).agg(F.avg(m.abs_err()).alias("mae"))
    b = v.trials(spark, d).groupBy(F.col("model_name").alias("model")).agg(F.avg("mae_test").alias("mae"))
    u = a.withColumn("priority", F.lit(1).cast("long")).unionByName(b.withColumn("priority", F.lit(2).cast("long")))
    u = u.withColumn("model", sc.strip_number_prefix("model"))
    return rounded(st.first_per_key(u, ["model"], ["priority"]).orderBy("mae"))


# --- scalar functions -------------------------------------------------------------------------


@query(
    "x01_m_values",
    f"""SELECT sample_id, probe_ord, {r('CASE WHEN beta IS NOT NULL THEN log2(least(greatest(beta, 1e-6), 1 - 1e-6) / (1 - least(greatest(beta, 1e-6), 1 - 1e-6))) END')} AS m
FROM beta_long""",
    "beta_long",
)
def _(spark, d):
    return rounded(v.beta(spark, d).select("sample_id", "probe_ord", sc.m_value("beta").alias("m")))


T_SQL = "CASE WHEN age <= 20 THEN ln(age + 1) - ln(21) ELSE (age - 20) / 21 END"


@query("x02_age_to_clock_scale", f"SELECT sample_id, {r(T_SQL)} AS t FROM annot", "annot")
def _(spark, d):
    return rounded(v.annot(spark, d).select("sample_id", sc.age_to_clock("age").alias("t")))


@query(
    "x03_clock_scale_to_age",
    f"SELECT sample_id, {r('CASE WHEN t <= 0 THEN exp(t + ln(21)) - 1 ELSE 21 * t + 20 END')} AS age FROM (SELECT sample_id, {T_SQL} AS t FROM annot)",
    "annot",
)
def _(spark, d):
    a = v.annot(spark, d).select("sample_id", sc.age_to_clock("age").alias("t"))
    return rounded(a.select("sample_id", sc.clock_to_age("t").alias("age")))


@query(
    "x04_sex_parsing",
    f"""WITH x AS (SELECT sample_id, CASE lower(female) WHEN 'true' THEN 1.0::DOUBLE WHEN 'false' THEN 0.0 END AS s FROM annot)
SELECT sample_id, CASE WHEN s = 1 THEN 'F' WHEN s = 0 THEN 'M' ELSE 'unknown' END AS sex, {r('coalesce(s, (SELECT avg(s) FROM x))')} AS filled FROM x""",
    "annot",
)
def _(spark, d):
    x = v.annot(spark, d).withColumn("s", sc.parse_bool("female").cast("double"))
    mean = x.agg(F.avg("s").alias("m")).select("m").scalar()
    return rounded(x.select("sample_id", sc.sex_label("female").alias("sex"), F.coalesce("s", mean).alias("filled")))


@query(
    "x05_binning",
    """SELECT sample_id, CASE WHEN age > 0 AND age <= 30 THEN 'a' WHEN age > 30 AND age <= 50 THEN 'b' WHEN age > 50 AND age <= 70 THEN 'c' END AS right_closed,
 CASE WHEN age >= 18 AND age < 40 THEN 'x' WHEN age >= 40 AND age < 65 THEN 'y' END AS left_closed,
 CASE WHEN age >= 18.1 AND age <= 40 THEN 'p' WHEN age > 40 AND age <= 90 THEN 'q' END AS with_lowest FROM annot""",
    "annot",
)
def _(spark, d):
    return v.annot(spark, d).select(
        "sample_id",
        sc.bin_by("age", [0, 30, 50, 70], ["a", "b", "c"]).alias("right_closed"),
        sc.bin_by("age", [18, 40, 65], ["x", "y"], closed="left").alias("left_closed"),
        sc.bin_by("age", [18.1, 40, 90], ["p", "q"], include_lowest=True).alias("with_lowest"),
    )


@query("x06_digitize", "SELECT sample_id, CASE WHEN age < 40 THEN 0::BIGINT WHEN age < 65 THEN 1 WHEN age >= 65 THEN 2 END AS band FROM annot", "annot")
def _(spark, d):
    return v.annot(spark, d).select("sample_id", sc.digitize("age", [40, 65]).alias("band"))


ETH_SQL = "CASE WHEN ethnicity IS NULL OR lower(trim(ethnicity)) IN ('', 'unavailable', 'declined', 'other') THEN 'Inconnu' ELSE trim(ethnicity) END"


@query("x07_clean_ethnicity", f"SELECT sample_id, {ETH_SQL} AS ethnicity FROM annot", "annot")
def _(spark, d):
    return v.annot(spark, d).select("sample_id", sc.clean_ethnicity("ethnicity").alias("ethnicity"))


@query("x08_strip_number_prefix", "SELECT p_partkey, p_name AS by_pattern, p_name AS by_dot FROM part")
def _(spark, d):
    p = v.table(spark, d, "part")
    named = p.select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(". "), "p_name").alias("label"))
    return named.select("p_partkey", sc.strip_number_prefix("label").alias("by_pattern"), sc.after_first_dot("label").alias("by_dot"))


@query("x09_chip_id", "SELECT DISTINCT sample_description, split_part(sample_description, '_R', 1) AS chip FROM pred_long", "pred_long")
def _(spark, d):
    return v.preds(spark, d).select("sample_description").distinct().withColumn("chip", sc.chip_id("sample_description"))


@query(
    "x10_errors",
    f"SELECT model, sample_id, {r(E)} AS error, {r(AE)} AS abs_error FROM pred_long",
    "pred_long",
)
def _(spark, d):
    return rounded(v.preds(spark, d).select("model", "sample_id", sc.error().alias("error"), m.abs_err().alias("abs_error")))


@query("x11_short_hash", "SELECT seq, substr(md5(username || date), 1, 8) AS id FROM submissions", "submissions")
def _(spark, d):
    return v.submissions(spark, d).select("seq", sc.short_hash("username", "date").alias("id"))


@query("x12_iso_date", "SELECT substr(date, 1, 10) AS day, count(*) AS n FROM submissions GROUP BY 1", "submissions")
def _(spark, d):
    return v.submissions(spark, d).groupBy(sc.iso_date("date").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("x13_default_text", "SELECT seq, coalesce(nullif(description, ''), 'Non fournie') AS description FROM submissions", "submissions")
def _(spark, d):
    return v.submissions(spark, d).select("seq", sc.text_or("description", "Non fournie").alias("description"))


ONE_HOT = ["Asian", "Black", "Hispanic", "White"]


@query(
    "x14_one_hot",
    f"SELECT sample_id, {', '.join(f'CAST(coalesce(ethnicity, ' + repr('') + f') = ' + repr(c) + f' AS DOUBLE) AS eth_{c}' for c in ONE_HOT[1:])} FROM annot",
    "annot",
)
def _(spark, d):
    return sc.one_hot(v.annot(spark, d).select("sample_id", "ethnicity"), "ethnicity", ONE_HOT, "eth", drop_first=True).drop("ethnicity")


@query(
    "x15_ordinal_codes",
    """WITH f AS (SELECT model_name, row_number() OVER (ORDER BY min(trial_id)) - 1 AS model_code FROM trials GROUP BY model_name)
SELECT trial_id, CASE strategy WHEN 'PCA' THEN 0::BIGINT WHEN 'TopN' THEN 1 END AS strategy_code, model_code
FROM trials t JOIN f ON t.model_name = f.model_name""",
    "trials",
)
def _(spark, d):
    coded = st.factorize(v.trials(spark, d), "model_name", "trial_id", "model_code")
    return coded.select("trial_id", sc.ordinal_code("strategy", {"PCA": 0, "TopN": 1}).alias("strategy_code"), "model_code")


@query(
    "x16_range_normalise",
    f"""SELECT trial_id, {r('(n_features - (SELECT min(n_features) FROM trials)) / CAST((SELECT max(n_features) - min(n_features) FROM trials) AS DOUBLE)')} AS share,
 {r('least(mae_test, 20)')} AS clipped FROM trials""",
    "trials",
)
def _(spark, d):
    t = st.range_normalise(v.trials(spark, d), "n_features", "share")
    return rounded(t.select("trial_id", "share", F.least("mae_test", F.lit(20.0)).alias("clipped")))


@query(
    "x17_standard_scaler",
    f"""WITH {TRAIN_SQL}, s AS (SELECT probe_ord, avg(beta) AS mu, stddev_pop(beta) AS sd FROM train GROUP BY probe_ord)
SELECT b.sample_id, b.probe_ord, {r('(beta - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END', 6)} AS z FROM beta_long b JOIN s ON b.probe_ord = s.probe_ord""",
    "annot beta_long",
)
def _(spark, d):
    from cpgloom.operators.scaling import standard_apply, standard_fit

    return rounded(standard_apply(v.beta(spark, d), standard_fit(train_cells(spark, d))).select("sample_id", "probe_ord", "z"), digits=6)


@query(
    "x18_global_min_max",
    f"""WITH {TRAIN_SQL}, s AS (SELECT min(beta) AS lo, max(beta) AS hi FROM train)
SELECT sample_id, probe_ord, {r('(beta - lo) / (hi - lo + 1e-8)', 6)} AS scaled FROM beta_long, s""",
    "annot beta_long",
)
def _(spark, d):
    from cpgloom.operators.scaling import global_min_max

    return rounded(global_min_max(v.beta(spark, d), train_cells(spark, d)).select("sample_id", "probe_ord", "scaled"), digits=6)


@query(
    "x19_polynomial_features",
    f"""WITH s AS (SELECT sample_id, avg(beta) AS a, var_pop(beta) AS b FROM beta_long GROUP BY sample_id)
SELECT sample_id, {r('a', 9)} AS f1, {r('b', 9)} AS f2, {r('a * a', 9)} AS f3, {r('a * b', 9)} AS f4, {r('b * b', 9)} AS f5 FROM s""",
    "beta_long",
)
def _(spark, d):
    from cpgloom.operators.probe_stats import sample_moments

    s = sample_moments(v.beta(spark, d)).withColumn("p", sc.polynomial2(F.array("mean", "variance")))
    return rounded(s.select("sample_id", *[F.col("p")[i].alias(f"f{i + 1}") for i in range(5)]), digits=9)


@query(
    "x20_vector_grid",
    """WITH c AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, i // 10 AS grid_row, """
    + r("sum(v)")
    + """ AS row_sum FROM c GROUP BY ALL UNION ALL SELECT vec_id, CAST(g AS BIGINT), 0.0 FROM embeddings, range(7, 9) t(g)""",
)
def _(spark, d):
    e = v.table(spark, d, "embeddings").select("vec_id", sc.pad_to_grid(F.col("embedding").cast("array<double>"), 9, 10).alias("g"))
    rows = e.select("vec_id", F.posexplode("g").alias("grid_row", "cells"))
    return rounded(rows.select("vec_id", F.col("grid_row").cast("long").alias("grid_row"), F.aggregate("cells", F.lit(0.0), lambda a, x: a + x).alias("row_sum")))


@query("x21_config_key", "SELECT DISTINCT strategy || '_' || CAST(n_features AS VARCHAR) AS config FROM trials", "trials")
def _(spark, d):
    return v.trials(spark, d).select(sc.config_key("strategy", "n_features").alias("config")).distinct()


@query("x22_coefficient_direction", "SELECT clock, probe_id, CASE WHEN coef > 0 THEN 'older' ELSE 'younger' END AS direction FROM clock_coef", "clock_coef")
def _(spark, d):
    return v.clock_coef(spark, d).select("clock", "probe_id", sc.direction("coef").alias("direction"))


@query(
    "x25_parameter_maps",
    """SELECT model_name AS model, 'best_mae' AS parameter, CAST(CAST(round(min(mae_test) * 10000) AS BIGINT) AS VARCHAR) AS value FROM trials GROUP BY model_name
UNION ALL SELECT model_name, 'n_trials', CAST(max(n_trials) AS VARCHAR) FROM trials GROUP BY model_name""",
    "trials",
)
def _(spark, d):
    return rel.map_to_params(rel.params_to_map(_eav(spark, d)))


def _eav(spark, d):
    g = v.trials(spark, d).groupBy(F.col("model_name").alias("model")).agg(
        F.round(F.min("mae_test") * 10000).cast("long").cast("string").alias("best_mae"), F.max("n_trials").cast("string").alias("n_trials")
    )
    return g.unpivot("model", ["best_mae", "n_trials"], "parameter", "value")


@query(
    "x25_parameter_table",
    """SELECT model_name AS model, CAST(CAST(round(min(mae_test) * 10000) AS BIGINT) AS VARCHAR) AS best_mae, CAST(max(n_trials) AS VARCHAR) AS n_trials,
 '-' AS depth FROM trials GROUP BY model_name""",
    "trials",
)
def _(spark, d):
    return rel.params_wide(_eav(spark, d), ["best_mae", "n_trials", "depth"])
