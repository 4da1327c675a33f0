"""Queries over the long matrix: statistics, selection, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cpgloom.functions.scalars import bin_by, m_value, sex_label
from cpgloom.operators import probe_stats as ps
from cpgloom.operators import selection as sel
from cpgloom.operators import splits
from cpgloom.operators.design import with_samples
from cpgloom.plans import views as v
from cpgloom.plans.registry import query, r, rd, rounded

# Correlation of beta with age where missing cells sit at the probe mean.
R_SQL = (
    "coalesce(count(beta) * covar_pop(beta, age) / nullif(sqrt(count(beta) * var_pop(beta))"
    " * sqrt(count(age) * var_pop(age)), 0), 0)"
)
SPLIT_SQL = """ids AS (SELECT sample_id, age, row_number() OVER (ORDER BY md5(sample_id || '|42'), sample_id) AS rn,
            count(*) OVER () AS n FROM annot WHERE age IS NOT NULL),
parts AS (SELECT sample_id, age, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM ids)"""
TRAIN_SQL = SPLIT_SQL + """,
train AS (SELECT b.probe_ord, b.sample_id, b.beta, p.age FROM beta_long b JOIN parts p ON b.sample_id = p.sample_id
          WHERE p.split = 'train')"""


def split_samples(spark, d):
    ids = v.annot(spark, d).where("age is not null").select("sample_id", "age")
    return splits.train_test_split(ids)


def train_cells(spark, d):
    train = split_samples(spark, d).where("split = 'train'").select("sample_id", "age")
    return with_samples(v.beta(spark, d).select("sample_id", "probe_ord", "beta"), train)


@query(
    "d01_sample_moments",
    f"SELECT sample_id, {r('avg(beta)', 9)} AS mean, {r('var_pop(beta)', 9)} AS variance FROM beta_long GROUP BY sample_id",
    "beta_long",
)
def _(spark, d):
    return rounded(ps.sample_moments(v.beta(spark, d)), digits=9)


@query(
    "d01_sample_moments_nan_as_zero",
    f"""SELECT sample_id, {r('avg(coalesce(beta, 0))', 9)} AS mean, {r('var_pop(coalesce(beta, 0))', 9)} AS variance
FROM beta_long GROUP BY sample_id""",
    "beta_long",
)
def _(spark, d):
    return rounded(ps.sample_moments(v.beta(spark, d), nan_as_zero=True), digits=9)


M_SQL = (
    "CASE WHEN beta IS NOT NULL THEN log2(least(greatest(beta, 1e-6), 1 - 1e-6)"
    " / (1 - least(greatest(beta, 1e-6), 1 - 1e-6))) END"
)


@query(
    "d01_sample_moments_m_values",
    f"""SELECT sample_id, {r('avg(m)', 9)} AS mean, {r('var_pop(m)', 9)} AS variance
FROM (SELECT sample_id, {M_SQL} AS m FROM beta_long) GROUP BY sample_id""",
    "beta_long",
)
def _(spark, d):
    return rounded(ps.sample_moments(v.beta(spark, d).withColumn("m", m_value("beta")), "m"), digits=9)


@query(
    "d02_probe_variance",
    f"""SELECT probe_ord, count(beta) AS n_present, {r('avg(beta)', 9)} AS mean, {r('var_pop(beta)', 9)} AS variance,
{r('1.0::DOUBLE - count(beta) / count(*)', 9)} AS missing_rate FROM beta_long GROUP BY probe_ord""",
    "beta_long",
)
def _(spark, d):
    return rounded(ps.probe_moments(v.beta(spark, d)), digits=9)


@query("d03_probe_correlation", f"SELECT probe_ord, {r(R_SQL, 9)} AS r FROM aged GROUP BY probe_ord", "aged")
def _(spark, d):
    return rounded(ps.probe_correlation(v.aged(spark, d)), digits=9)


CORR_X = "coalesce(covar_pop(x, age) / nullif(sqrt(var_pop(x)) * sqrt(var_pop(age)), 0), 0)"
SEX_SQL = (
    "CASE WHEN lower(female) = 'true' THEN 'F' WHEN lower(female) = 'false' THEN 'M' ELSE 'unknown' END AS sex"
)


@query(
    "d04_probe_correlation_by_sex",
    f"""WITH src AS (SELECT probe_ord, beta, age, {SEX_SQL} FROM aged),
cells AS (SELECT *, avg(beta) OVER (PARTITION BY probe_ord) AS pm FROM src),
filled AS (SELECT *, coalesce(beta, pm, 0) AS x FROM cells)
SELECT probe_ord, sex, {r(CORR_X)} AS r FROM filled GROUP BY probe_ord, sex""",
    "aged",
)
def _(spark, d):
    cells = v.aged(spark, d).withColumn("sex", sex_label("female"))
    return rounded(ps.probe_correlation(cells, ["sex"]))


@query(
    "d04_probe_correlation_by_sex_m_values",
    f"""WITH src AS (SELECT probe_ord, {M_SQL} AS m, age, {SEX_SQL} FROM aged),
cells AS (SELECT *, avg(m) OVER (PARTITION BY probe_ord) AS pm FROM src),
filled AS (SELECT *, coalesce(m, pm, 0) AS x FROM cells)
SELECT probe_ord, sex, {r(CORR_X)} AS r FROM filled GROUP BY probe_ord, sex""",
    "aged",
)
def _(spark, d):
    cells = v.aged(spark, d).withColumns({"sex": sex_label("female"), "m": m_value("beta")})
    return rounded(ps.probe_correlation(cells, ["sex"], value="m"))


@query(
    "d05_correlation_agreement",
    f"""WITH by_sex AS (SELECT probe_ord, lower(female) AS f, {R_SQL} AS r FROM aged
                 WHERE female IS NOT NULL GROUP BY probe_ord, lower(female)),
pair AS (SELECT a.r AS a, b.r AS b FROM by_sex a JOIN by_sex b ON a.probe_ord = b.probe_ord
         WHERE a.f = 'true' AND b.f = 'false')
SELECT count(*) AS n, {r('coalesce(covar_pop(a, b) / nullif(sqrt(var_pop(a)) * sqrt(var_pop(b)), 0), 0)')} AS r FROM pair""",
    "aged",
)
def _(spark, d):
    cells = v.aged(spark, d).withColumn("sex", sex_label("female"))
    women, men = (ps.probe_correlation(cells.where(F.col("sex") == s)) for s in ("F", "M"))
    return rounded(ps.vector_correlation(women, men))


@query(
    "d41_missingness",
    f"""WITH s AS (SELECT avg(CASE WHEN beta IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS m FROM beta_long GROUP BY sample_id),
p AS (SELECT avg(CASE WHEN beta IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS m FROM beta_long GROUP BY probe_ord)
SELECT count(*) AS n_cells, count(*) - count(beta) AS n_missing,
 {r('100.0::DOUBLE * (count(*) - count(beta)) / count(*)', 9)} AS pct_missing,
 {r('(SELECT max(m) FROM s)', 9)} AS max_per_sample, {r('(SELECT avg(m) FROM s)', 9)} AS mean_per_sample,
 {r('(SELECT max(m) FROM p)', 9)} AS max_per_probe, {r('(SELECT avg(m) FROM p)', 9)} AS mean_per_probe FROM beta_long""",
    "beta_long",
)
def _(spark, d):
    return rounded(ps.missingness(v.beta(spark, d)), digits=9)


@query(
    "b15_missing_rate_filter",
    f"""SELECT sample_id, probe_ord, {r('beta', 9)} AS beta FROM beta_long WHERE probe_ord IN
(SELECT probe_ord FROM beta_long GROUP BY probe_ord HAVING 1.0::DOUBLE - count(beta) / count(*) <= 0.05::DOUBLE)""",
    "beta_long",
)
def _(spark, d):
    kept = ps.missing_rate_filter(v.beta(spark, d), 0.05)
    return rounded(kept.select("sample_id", "probe_ord", "beta"), digits=9)


# --- splits ---------------------------------------------------------------------------------


@query("v01_train_test_split", f"WITH {SPLIT_SQL} SELECT sample_id, split FROM parts", "annot")
def _(spark, d):
    return split_samples(spark, d).select("sample_id", "split")


@query(
    "v02_stratified_split",
    """WITH b AS (SELECT sample_id, CASE WHEN age > 0 AND age <= 30 THEN '<30' WHEN age <= 45 THEN '30-45'
   WHEN age <= 60 THEN '45-60' WHEN age <= 75 THEN '60-75' WHEN age <= 100 THEN '>75' END AS age_bin
   FROM annot WHERE age IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY age_bin ORDER BY md5(sample_id || '|42'), sample_id) AS rn,
      count(*) OVER (PARTITION BY age_bin) AS n FROM b)
SELECT sample_id, age_bin, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM k""",
    "annot",
)
def _(spark, d):
    ids = v.annot(spark, d).where("age is not null")
    age_bin = bin_by("age", [0, 30, 45, 60, 75, 100], ["<30", "30-45", "45-60", "60-75", ">75"])
    return splits.train_test_split(ids.select("sample_id", age_bin.alias("age_bin")), strata=["age_bin"])


@query(
    "v03_kfold",
    """SELECT sample_id, (row_number() OVER (ORDER BY md5(sample_id || '|42'), sample_id) - 1) % 5 AS fold
FROM annot WHERE age IS NOT NULL""",
    "annot",
)
def _(spark, d):
    return splits.kfold(v.annot(spark, d).where("age is not null").select("sample_id"))


@query(
    "v04_repeated_kfold",
    """WITH k AS (SELECT sample_id, CAST(rep AS BIGINT) AS repeat FROM annot, range(3) t(rep) WHERE age IS NOT NULL)
SELECT sample_id, repeat, (row_number() OVER (PARTITION BY repeat
  ORDER BY md5(sample_id || '|' || CAST(repeat + 42 AS VARCHAR)), sample_id) - 1) % 5 AS fold FROM k""",
    "annot",
)
def _(spark, d):
    return splits.repeated_kfold(v.annot(spark, d).where("age is not null").select("sample_id"))


@query(
    "v07_validation_split",
    f"""WITH {SPLIT_SQL}, t AS (SELECT sample_id, row_number() OVER (ORDER BY md5(sample_id || '|7'), sample_id) AS rn,
 count(*) OVER () AS n FROM parts WHERE split = 'train')
SELECT sample_id, rn <= greatest(20, n // 5) AS is_validation FROM t""",
    "annot",
)
def _(spark, d):
    train = split_samples(spark, d).where("split = 'train'").select("sample_id")
    return splits.validation_split(train)


# --- selection ------------------------------------------------------------------------------


@query(
    "s03_top_correlated_probes",
    f"""WITH {TRAIN_SQL}, s AS (SELECT probe_ord, {R_SQL} AS r FROM train GROUP BY probe_ord)
SELECT probe_ord, {r('r', 9)} AS r, row_number() OVER (ORDER BY abs(r) DESC, probe_ord) AS rank
FROM s ORDER BY abs(s.r) DESC, probe_ord LIMIT 12""",
    "annot beta_long",
)
def _(spark, d):
    return rounded(sel.top_correlated(train_cells(spark, d), 12), digits=9)


@query(
    "s04_two_stage_selection",
    f"""WITH {TRAIN_SQL}, s AS (SELECT probe_ord, var_pop(beta) AS variance, {R_SQL} AS r FROM train GROUP BY probe_ord),
w AS (SELECT * FROM s ORDER BY variance DESC NULLS LAST, probe_ord LIMIT 40)
SELECT probe_ord, {r('variance', 9)} AS variance, {r('w.r', 9)} AS r FROM w ORDER BY abs(w.r) DESC, probe_ord LIMIT 16""",
    "annot beta_long",
)
def _(spark, d):
    return rounded(sel.two_stage(train_cells(spark, d), 40, 16), digits=9)


@query(
    "s07_nested_prefixes",
    f"""WITH {TRAIN_SQL}, s AS (SELECT probe_ord, {R_SQL} AS r FROM train GROUP BY probe_ord),
k AS (SELECT probe_ord, r, row_number() OVER (ORDER BY abs(r) DESC, probe_ord) AS rank FROM s)
SELECT CAST(g AS BIGINT) AS k, count(*) AS n, {r('min(abs(r))')} AS weakest, {r('avg(abs(r))')} AS mean_abs_r
FROM k, (SELECT unnest([8, 16, 32, 64]) AS g) WHERE rank <= g GROUP BY g""",
    "annot beta_long",
)
def _(spark, d):
    ranked = sel.ranked_probes(train_cells(spark, d))
    sizes = F.array(*[F.lit(k).cast("long") for k in (8, 16, 32, 64)])
    a = F.abs("r")
    return (
        ranked.withColumn("k", F.explode(F.filter(sizes, lambda k: F.col("rank") <= k)))
        .groupBy("k")
        .agg(F.count("*").alias("n"), rd(F.min(a)).alias("weakest"), rd(F.avg(a)).alias("mean_abs_r"))
    )


@query(
    "s08_random_sample_probes",
    "SELECT probe_ord, probe_id FROM probes ORDER BY md5(CAST(probe_ord AS VARCHAR) || '|42'), probe_ord LIMIT 10",
    "probes",
)
def _(spark, d):
    return sel.hashed_sample(v.probes(spark, d), "probe_ord", 10)
