"""Queries over files and streams: ingest, stores, leaderboard, incremental jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cpgloom.operators import metrics as m
from cpgloom.operators import relational as rel
from cpgloom.operators import selection as sel
from cpgloom.plans import views as v
from cpgloom.plans.registry import query, r, rounded
from cpgloom.session import materialize, scratch_path
from cpgloom.sources import matrix_files as mf
from cpgloom.sources import submissions as sub
from cpgloom.sources import tables as tb
from cpgloom.streaming import jobs

E, AE = "(y_pred - y_true)", "abs(y_pred - y_true)"


@query("a01_annotation_scan", f"SELECT sample_id, {r('age')} AS age, female FROM annot WHERE age IS NOT NULL", "annot")
def _(spark, d):
    path = scratch_path(spark, "annotations")
    tb.write_table(v.annot(spark, d).select(F.col("sample_id").alias("Sample_description"), "age", "female"), path, "csv")
    return rounded(tb.load_annotations(spark, path).select("sample_id", "age", "female"))


@query("a02_probe_names", "SELECT probe_ord, probe_id FROM probes", "probes")
def _(spark, d):
    path = scratch_path(spark, "probe-names")
    named = v.probes(spark, d).select("probe_ord", F.col("probe_id").alias("value"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("probe_ord"), F.lit("cpg_names").alias("value"))
    head.unionByName(named).repartitionByRange("probe_ord").sortWithinPartitions("probe_ord").select("value").write.text(path)
    return mf.read_probe_names(spark, path)


@query("a03_wide_matrix_ingest", f"SELECT probe_ord, sample_id, {r('beta', 9)} AS beta FROM beta_long", "beta_long")
def _(spark, d):
    wide, out = scratch_path(spark, "wide"), scratch_path(spark, "long")
    mf.export_wide(v.beta(spark, d), wide)
    return rounded(mf.ingest(spark, wide, out), digits=9)


@query(
    "a03_wide_matrix_pruned",
    f"SELECT b.probe_ord, b.sample_id, {r('beta', 9)} AS beta FROM beta_long b JOIN annot a ON a.sample_id = b.sample_id WHERE age IS NOT NULL",
    "beta_long annot",
)
def _(spark, d):
    wide = scratch_path(spark, "wide")
    mf.export_wide(v.beta(spark, d), wide)
    known = v.annot(spark, d).where("age is not null")
    return rounded(mf.read_wide(spark, wide, known), digits=9)


@query("a04_header_samples", "SELECT vec_id AS header_ord, sample_id FROM annot", "annot")
def _(spark, d):
    wide = scratch_path(spark, "wide")
    mf.export_wide(v.beta(spark, d), wide)
    names = mf.header_columns(spark, wide)
    return names.select(F.col("col").cast("long").alias("header_ord"), "sample_id")


@query("a05_file_discovery", f"SELECT sample_id, probe_ord, {r('beta')} AS beta FROM beta_long", "beta_long")
def _(spark, d):
    folder = scratch_path(spark, "data")
    cells = v.beta(spark, d).select("sample_id", "probe_ord", "beta")
    tb.write_table(cells, f"{folder}/raw_impute", "csv")
    tb.write_table(cells, f"{folder}/other", "parquet")
    found = tb.find_files(spark, folder, "*.csv")
    paths = [row["path"] for row in found.select("path").collect()]  # names of the part files
    back = spark.read.schema("sample_id STRING, probe_ord BIGINT, beta DOUBLE").option("header", True).csv(paths)
    return rounded(back)


@query("a06_latest_result_file", f"SELECT model, {r(f'avg({E} * {E})')} AS score FROM pred_long GROUP BY model", "pred_long")
def _(spark, d):
    folder = scratch_path(spark, "results")
    p = v.preds(spark, d)
    for name, score in (("first", F.avg(m.abs_err())), ("second", F.avg(m.err() * m.err()))):
        tb.write_table(p.groupBy("model").agg(score.alias("score")).coalesce(1), f"{folder}/{name}", "csv")
    latest = tb.latest_file(spark, folder, "*.csv")
    return rounded(spark.read.schema("model STRING, score DOUBLE").option("header", True).csv(latest))


@query("a07_clock_probe_list", "SELECT DISTINCT probe_id FROM clock_coef", "clock_coef")
def _(spark, d):
    path = scratch_path(spark, "clock-list")
    v.clock_coef(spark, d).select("probe_id").write.text(path)
    return tb.load_clock_probes(spark, path).unionByName(tb.load_clock_probes(spark, path + "-missing"))


@query("a09_optional_file", f"SELECT model, count(*) AS n, {r('avg(y_true)')} AS mean_age FROM pred_long GROUP BY model", "pred_long")
def _(spark, d):
    path = scratch_path(spark, "optional")
    tb.write_table(v.preds(spark, d).select("model", "y_true"), path, "csv")
    parts = [tb.read_optional(spark, p, "csv", "model STRING, y_true DOUBLE") for p in (path, path + "-missing")]
    (present,) = [p for p in parts if p is not None]
    return rounded(present.groupBy("model").agg(F.count("*").alias("n"), F.avg("y_true").alias("mean_age")))


@query(
    "a12_csv_sink",
    f"SELECT model, count(*) AS n, {r('avg(y_pred)')} AS mean_pred FROM pred_long GROUP BY model",
    "pred_long",
)
def _(spark, d):
    path = scratch_path(spark, "predictions")
    tb.write_table(v.preds(spark, d).select("model", "sample_id", "y_true", "y_pred"), path, "csv", ["model"])
    back = spark.read.schema("sample_id BIGINT, y_true DOUBLE, y_pred DOUBLE, model STRING").option("header", True).csv(path)
    return rounded(back.groupBy("model").agg(F.count("*").alias("n"), F.avg("y_pred").alias("mean_pred")))


@query(
    "a15_ground_truth",
    f"SELECT CAST(sample_id AS VARCHAR) AS sample_id, {r('min(y_true)')} AS true_age FROM pred_long WHERE split = 'test' GROUP BY sample_id",
    "pred_long",
)
def _(spark, d):
    return rounded(tb.ground_truth(spark, v.preds(spark, d)))


@query(
    "a17_coefficient_table",
    "SELECT clock, probe_id AS feature, coef, abs(coef) AS abs_coef FROM clock_coef ORDER BY abs(coef) DESC, probe_id, clock LIMIT 100",
    "clock_coef",
)
def _(spark, d):
    c = v.clock_coef(spark, d).select("clock", F.col("probe_id").alias("feature"), "coef", F.abs("coef").alias("abs_coef"))
    return sel.top_rows(c, F.desc("abs_coef"), 100, "feature", "clock")


def records(spark, d):
    """Submission records with nested metrics, as kept in the store."""
    s = v.submissions(spark, d)
    zero = F.lit(None).cast("double")
    return s.select(
        F.col("seq").cast("string").alias("id"),
        "username",
        "model_category",
        "description",
        F.struct("mae", "rmse", zero.alias("r2"), zero.alias("correlation"), zero.alias("mad")).alias("metrics"),
        "n_samples",
        "date",
    )


@query(
    "a10_submission_store",
    f"SELECT CAST(seq AS VARCHAR) AS id, username, {r('mae')} AS mae, {r('rmse')} AS rmse, n_samples FROM submissions",
    "submissions",
)
def _(spark, d):
    path = scratch_path(spark, "submissions")
    rec = records(spark, d)
    sub.append_submissions(rec.where("n_samples % 2 = 0"), path)
    sub.append_submissions(rec.where("n_samples % 2 = 1"), path)
    back = sub.read_submissions(spark, path)
    return rounded(back.select("id", "username", F.col("metrics.mae").alias("mae"), F.col("metrics.rmse").alias("rmse"), "n_samples"))


@query(
    "x24_json_round_trip",
    f"SELECT CAST(seq AS VARCHAR) AS id, {r('mae')} AS mae, {r('rmse')} AS rmse, username FROM submissions",
    "submissions",
)
def _(spark, d):
    text = records(spark, d).select("id", F.to_json(F.struct("username", "metrics")).alias("doc"))
    parsed = F.from_json("doc", "username STRING, metrics STRUCT<mae: DOUBLE, rmse: DOUBLE>")
    out = text.select("id", parsed.alias("p"), F.get_json_object("doc", "$.metrics.mae").cast("double").alias("mae"))
    return rounded(out.select("id", "mae", F.col("p.metrics.rmse").alias("rmse"), F.col("p.username").alias("username")))


def uploads(spark, d):
    """CSV uploads of up to ten predictions with four header styles, one of them incomplete."""
    p = v.preds(spark, d).withColumn("block", F.floor(F.col("sample_id") / 10).cast("long"))
    line = F.concat_ws(",", F.col("sample_id").cast("string"), F.col("y_pred").cast("string"))
    per = p.groupBy("model", "block").agg(F.sort_array(F.collect_list(F.struct("sample_id", line.alias("line")))).alias("e"))
    style = F.col("block") % 4
    header = (
        F.when(style == 0, "sample_id,predicted_age").when(style == 1, "Sample_Name,age_pred").when(style == 2, "sample_id,prediction")
    ).otherwise("sample_id,height")
    text = F.concat(header, F.lit("\n"), F.concat_ws("\n", F.transform("e", lambda x: x["line"])))
    return per.select(
        F.concat_ws("-", "model", "block").alias("upload_id"),
        F.concat(F.lit("u"), (F.col("block") % 50).cast("string")).alias("username"),
        F.col("model").alias("model_category"),
        F.lit("").alias("description"),
        F.concat(F.lit("2024-01-01T00:00:00."), F.col("model"), F.col("block").cast("string")).alias("date"),
        F.concat(F.lit("data:text/csv;base64,"), F.base64(F.encode(text, "UTF-8"))).alias("contents"),
    )


UPLOADED = f"""up AS (SELECT model || '-' || CAST(sample_id // 10 AS VARCHAR) AS upload_id, model, sample_id // 10 AS block, CAST(sample_id AS VARCHAR) AS sample_id,
 y_true, y_pred, split FROM pred_long),
ok AS (SELECT * FROM up WHERE block % 4 <> 3)"""


@query("a11_upload_parse", f"WITH {UPLOADED} SELECT upload_id, sample_id, {r('y_pred')} AS predicted_age FROM ok", "pred_long")
def _(spark, d):
    return rounded(sub.parse_uploads(uploads(spark, d)))


@query("a11_upload_rejects", f"WITH {UPLOADED} SELECT DISTINCT upload_id, 'no age column' AS reason FROM up WHERE block % 4 = 3", "pred_long")
def _(spark, d):
    return sub.rejected_uploads(uploads(spark, d))


def _truth(spark, d):
    return tb.ground_truth(spark, v.preds(spark, d))


@query(
    "c03_submission_scores",
    f"""WITH {UPLOADED} SELECT upload_id, count(*) AS n, {r(f'avg({AE})')} AS mae, {r(f'sqrt(avg({E} * {E}))')} AS rmse,
 {r(f'quantile_cont({AE}, 0.5)')} AS mad FROM ok WHERE split = 'test' GROUP BY upload_id""",
    "pred_long",
)
def _(spark, d):
    matched = materialize(sub.match_to_truth(sub.parse_uploads(uploads(spark, d)), _truth(spark, d)), "matched")
    return rounded(m.error_metrics(matched, ["upload_id"]).select("upload_id", "n", "mae", "rmse", "mad"))


@query(
    "c04_id_reconciliation",
    f"""WITH {UPLOADED} SELECT upload_id, count(*) FILTER (split = 'test') AS matched,
 (SELECT count(DISTINCT sample_id) FROM up WHERE split = 'test') - count(*) FILTER (split = 'test') AS missing,
 count(*) FILTER (split <> 'test') AS extra FROM ok GROUP BY upload_id""",
    "pred_long",
)
def _(spark, d):
    return sub.reconcile_uploads(sub.parse_uploads(uploads(spark, d)), _truth(spark, d))


@query(
    "c04_id_status",
    f"""WITH u AS (SELECT sample_id FROM annot WHERE age IS NOT NULL), e AS (SELECT sample_id FROM annot WHERE female IS NOT NULL)
SELECT coalesce(u.sample_id, e.sample_id) AS sample_id, CASE WHEN u.sample_id IS NULL THEN 'missing' WHEN e.sample_id IS NULL THEN 'extra'
 ELSE 'matched' END AS status FROM u FULL JOIN e ON u.sample_id = e.sample_id""",
    "annot",
)
def _(spark, d):
    a = v.annot(spark, d)
    return rel.reconcile(a.where("age is not null"), a.where("female is not null"))


@query(
    "d44_leaderboard_kpis",
    f"SELECT {r('min(mae)')} AS best_mae, count(*) AS total, count(DISTINCT username) AS participants FROM submissions",
    "submissions",
)
def _(spark, d):
    return rounded(sub.leaderboard_kpis(v.submissions(spark, d)))


@query(
    "w03_leaderboard",
    f"""WITH k AS (SELECT seq, username, mae, row_number() OVER (ORDER BY mae, seq) AS rank FROM submissions)
SELECT seq, username, {r('mae')} AS mae, rank, CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze'
 ELSE '#' || CAST(rank AS VARCHAR) END AS medal FROM k""",
    "submissions",
)
def _(spark, d):
    return rounded(sub.leaderboard(v.submissions(spark, d).select("seq", "username", "mae"), tie="seq"))


BEST_SQL = f"""WITH b AS (SELECT username, min(mae) AS best_mae, count(*) AS n FROM submissions GROUP BY username)
SELECT username, {r('b.best_mae')} AS best_mae, n, row_number() OVER (ORDER BY b.best_mae, username) AS rank FROM b"""


@query("r01_stream_leaderboard", BEST_SQL, "submissions")
def _(spark, d):
    src, out, ck = (scratch_path(spark, n) for n in ("arriving", "best", "stream"))
    rec = records(spark, d)
    rec.unionByName(rec.where("n_samples < 10")).write.json(src)  # some submissions arrive twice
    return rounded(jobs.run_best_per_user(spark, src, out, ck))


@query("r01_stream_late_submissions", BEST_SQL, "submissions")
def _(spark, d):
    """Arrival in parts, the latest dates first, one file an epoch, and a second run after a third of them; some arrive in two epochs."""
    src, out, ck = (scratch_path(spark, n) for n in ("arriving", "best", "stream"))
    rec = materialize(records(spark, d).withColumn("_part", F.pmod(F.xxhash64("date"), F.lit(3))), "records")
    for part in (2, 1, 0):
        mine = rec.where((F.col("_part") == part) | ((F.col("_part") == part + 1) & (F.col("n_samples") < 20)))
        mine.drop("_part").coalesce(1).write.mode("append").json(src)
        if part == 2:
            jobs.run_best_per_user(spark, src, out, ck, files_per_trigger=1)
    return rounded(jobs.run_best_per_user(spark, src, out, ck, files_per_trigger=1))


@query(
    "r01_stream_scoring",
    f"""WITH {UPLOADED} SELECT model AS model_category, count(DISTINCT upload_id) AS n_submissions, count(*) AS n_samples
FROM ok WHERE split = 'test' GROUP BY model""",
    "pred_long",
)
def _(spark, d):
    src, store, ck = (scratch_path(spark, n) for n in ("uploads", "store", "stream"))
    uploads(spark, d).write.json(src)
    scored = jobs.run_scoring(spark, src, _truth(spark, d), store, ck)
    return scored.groupBy("model_category").agg(F.count("*").alias("n_submissions"), F.sum("n_samples").alias("n_samples"))


@query(
    "r02_stream_sample_moments",
    f"SELECT sample_id, count(beta) AS n, {r('avg(beta)', 9)} AS mean, {r('var_pop(beta)', 9)} AS variance FROM beta_long GROUP BY sample_id",
    "beta_long",
)
def _(spark, d):
    src, out, ck = (scratch_path(spark, n) for n in ("chunks", "moments", "stream"))
    v.beta(spark, d).select("probe_ord", "sample_id", "beta").repartitionByRange(4, "probe_ord").write.parquet(src)
    return rounded(jobs.run_sample_moments(spark, src, out, ck, files_per_trigger=2), digits=9)
