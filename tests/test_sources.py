import base64
import os
import time

import pytest
from pyspark.sql import functions as F

from cpgloom.operators import relational as rel
from cpgloom.operators.selection import keep_probes
from cpgloom.sources import matrix_files as mf
from cpgloom.sources import submissions as sub
from cpgloom.sources import tables as tb
from cpgloom.streaming import jobs


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_annotations_drop_rows_without_age(spark, tmp_path):
    path = put(tmp_path, "a.csv", "Sample_name,female,ethnicity,age,Sample_description\nA,True,White,25,s1\nB,False,,,s2\nC,,Black,60.5,s3\n")
    got = tb.load_annotations(spark, path).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["age"]) for r in got] == [("s1", 25.0), ("s3", 60.5)]


def test_annotations_need_their_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        tb.load_annotations(spark, put(tmp_path, "a.csv", "x,y\n1,2\n"))


def test_wide_matrix_keeps_order_and_gaps(spark, tmp_path):
    path = put(tmp_path, "m.csv", '"s1","s2",s3\n0.1,,0.3\nNA,0.5,NaN\n0.7,0.8,\n')
    got = {(r["probe_ord"], r["sample_id"]): r["beta"] for r in mf.read_wide(spark, path).collect()}
    assert got == {
        (0, "s1"): 0.1, (0, "s2"): None, (0, "s3"): 0.3,
        (1, "s1"): None, (1, "s2"): 0.5, (1, "s3"): None,
        (2, "s1"): 0.7, (2, "s2"): 0.8, (2, "s3"): None,
    }
    assert [r["sample_id"] for r in mf.header_columns(spark, path).orderBy("col").collect()] == ["s1", "s2", "s3"]


def test_ordinals_hold_across_input_splits(spark, tmp_path):
    n = 5000
    path = put(tmp_path, "m.csv", "a,b\n" + "".join(f"{i},{i * 2}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        cells = mf.read_wide(spark, path)
        assert mf.numbered_lines(spark, path).rdd.getNumPartitions() > 5
        assert cells.where("sample_id = 'a' and beta <> probe_ord").count() == 0
        assert cells.where("sample_id = 'b' and beta <> 2 * probe_ord").count() == 0
        assert cells.count() == 2 * n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sample_pruning_and_index_column(spark, tmp_path):
    path = put(tmp_path, "m.csv", ",s1,s2\ncg1,0.1,0.2\ncg2,0.3,0.4\n")
    keep = spark.createDataFrame([("s2",)], "sample_id STRING")
    got = mf.read_wide(spark, path, keep, has_index=True).orderBy("probe_ord").collect()
    assert [(r["probe_ord"], r["sample_id"], r["beta"]) for r in got] == [(0, "s2", 0.2), (1, "s2", 0.4)]


def test_wide_export_round_trip(spark, tmp_path, cells):
    out = str(tmp_path / "wide")
    mf.export_wide(cells, out)
    back = mf.ingest(spark, out, str(tmp_path / "long"))
    key = ["probe_ord", "sample_id", "beta"]
    assert sorted(map(str, back.select(key).collect())) == sorted(map(str, cells.select(key).collect()))


def test_probe_names_and_positional_rows(spark, tmp_path, cells):
    path = put(tmp_path, "n.csv", 'cpg_names\n"cg9"\ncg1\ncg5\n')
    names = mf.read_probe_names(spark, path)
    assert [tuple(r) for r in names.orderBy("probe_ord").collect()] == [(0, "cg9"), (1, "cg1"), (2, "cg5")]
    picked = keep_probes(cells, names.where("probe_id in ('cg5', 'cg9')"))
    assert {r["probe_ord"] for r in picked.select("probe_ord").distinct().collect()} == {0, 2}
    assert picked.count() == 8


def test_clock_lists_may_be_absent(spark, tmp_path):
    assert tb.load_clock_probes(spark, None).count() == 0
    assert tb.load_clock_probes(spark, str(tmp_path / "none.txt")).count() == 0
    path = put(tmp_path, "c.txt", "cg1\ncg2\ncg1\n\n")
    assert {r["probe_id"] for r in tb.load_clock_probes(spark, path).collect()} == {"cg1", "cg2"}


def test_file_discovery(spark, tmp_path):
    a = put(tmp_path, "x_impute_1.csv", "a\n1\n")
    time.sleep(0.01)
    b = put(tmp_path, "x_impute_2.csv", "a\n1\n")
    os.utime(a, (1, 1))
    assert tb.find_files(spark, str(tmp_path), "*impute*.csv").count() == 2
    assert tb.latest_file(spark, str(tmp_path), "*impute*.csv").endswith(os.path.basename(b))
    with pytest.raises(FileNotFoundError):
        tb.find_files(spark, str(tmp_path), "*.nothing")
    assert tb.read_optional(spark, str(tmp_path / "missing.csv")) is None


def upload(uid, text):
    return (uid, "ann", "linear", "", f"2024-01-0{uid[-1]}T00:00:00", "data:text/csv;base64," + base64.b64encode(text.encode()).decode())


@pytest.fixture
def uploads(spark):
    rows = [
        upload("u1", "sample_id,predicted_age\n1,30\n2,41.5\n9,50\n"),
        upload("u2", 'note,Sample_Name,prediction\n"a, b",1,33\n"c",2,44\r\n'),
        upload("u3", "sample_id,height\n1,2\n"),
        ("u4", "ann", "linear", "", "2024-01-04T00:00:00", "data:text/csv;base64,###"),
        upload("u5", "sample_id,predicted_age\n77,30\n"),
    ]
    return spark.createDataFrame(rows, jobs.UPLOAD_SCHEMA.replace("date STRING, contents", "date STRING, contents"))


@pytest.fixture
def truth(spark):
    return spark.createDataFrame([(1, 31.0), (2, 40.0)], "sample_id BIGINT, true_age DOUBLE")


def test_uploads_parse_and_reject(uploads, truth):
    parsed = sub.parse_uploads(uploads)
    got = {(r["upload_id"], r["sample_id"]): r["predicted_age"] for r in parsed.collect()}
    assert got == {("u1", "1"): 30.0, ("u1", "2"): 41.5, ("u1", "9"): 50.0, ("u2", "1"): 33.0, ("u2", "2"): 44.0, ("u5", "77"): 30.0}
    bad = {r["upload_id"]: r["reason"] for r in sub.rejected_uploads(uploads).collect()}
    assert bad == {"u3": "no age column", "u4": "unreadable"}
    status = {r["upload_id"]: (r["matched"], r["missing"], r["extra"]) for r in sub.reconcile_uploads(parsed, truth).collect()}
    assert status == {"u1": (2, 0, 1), "u2": (2, 0, 0), "u5": (0, 2, 1)}


def test_scores_skip_uploads_without_known_samples(uploads, truth):
    got = sub.score_uploads(uploads, truth).orderBy("date").collect()
    assert [(r["metrics"]["mae"], r["n_samples"], r["description"]) for r in got] == [(1.25, 2, "Non fournie"), (3.0, 2, "Non fournie")]
    assert all(len(r["id"]) == 8 for r in got)


def test_leaderboard_ranks_and_medals(spark):
    rec = spark.createDataFrame([("a", "u", 3.0), ("b", "u", 1.0), ("c", "v", 2.0), ("d", "w", 4.0)], "id STRING, username STRING, mae DOUBLE")
    got = [(r["id"], r["rank"], r["medal"]) for r in sub.leaderboard(rec).orderBy("rank").collect()]
    assert got == [("b", 1, "gold"), ("c", 2, "silver"), ("a", 3, "bronze"), ("d", 4, "#4")]
    k = sub.leaderboard_kpis(rec).first()
    assert (k["best_mae"], k["total"], k["participants"]) == (1.0, 4, 3)


def test_ground_truth_is_written_once(spark, tmp_path):
    p = spark.createDataFrame([("m", 1, 30.0, 1.0, "test"), ("n", 1, 30.0, 2.0, "test"), ("m", 2, 40.0, 1.0, "train")], "model STRING, sample_id BIGINT, y_true DOUBLE, y_pred DOUBLE, split STRING")
    path = str(tmp_path / "truth")
    assert [tuple(r) for r in tb.ground_truth(spark, p, path).collect()] == [("1", 30.0)]
    again = tb.ground_truth(spark, p.withColumn("y_true", F.lit(99.0)), path)
    assert [tuple(r) for r in again.collect()] == [("1", 30.0)]


def test_reconcile_statuses(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "sample_id INT")
    b = spark.createDataFrame([("2",), ("3",)], "sample_id STRING")
    assert {r["sample_id"]: r["status"] for r in rel.reconcile(a, b).collect()} == {"1": "extra", "2": "matched", "3": "missing"}


def test_stream_equals_batch_over_several_triggers(spark, tmp_path, cells):
    src = str(tmp_path / "chunks")
    for p in range(3):
        cells.where(F.col("probe_ord") == p).write.mode("append").parquet(src)
    got = jobs.run_sample_moments(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), 1).orderBy("sample_id").collect()
    want = cells.groupBy("sample_id").agg(F.count("beta").alias("n"), F.avg("beta").alias("mean"), F.var_pop("beta").alias("variance")).orderBy("sample_id").collect()
    for a, b in zip(got, want):
        assert a["n"] == b["n"] and a["mean"] == pytest.approx(b["mean"]) and a["variance"] == pytest.approx(b["variance"], abs=1e-12)


def test_scoring_stream_restarts_without_double_counts(spark, tmp_path, uploads, truth):
    src, store, ck = (str(tmp_path / n) for n in ("in", "store", "ck"))
    uploads.where("upload_id = 'u1'").write.mode("append").json(src)
    assert jobs.run_scoring(spark, src, truth, store, ck).count() == 1
    uploads.where("upload_id = 'u2'").write.mode("append").json(src)
    assert jobs.run_scoring(spark, src, truth, store, ck).count() == 2
    assert jobs.run_scoring(spark, src, truth, store, ck).count() == 2


def test_best_per_user_ignores_repeats(spark, tmp_path):
    src = str(tmp_path / "subs")
    rows = [("a", "u", 3.0), ("a", "u", 3.0), ("b", "u", 1.0), ("c", "v", 2.0)]
    rec = spark.createDataFrame(rows, "id STRING, username STRING, mae DOUBLE").select("id", "username", F.struct("mae").alias("metrics"), F.lit("2024-01-01T00:00:00").alias("date"))
    rec.write.json(src)
    best = jobs.run_best_per_user(spark, src, str(tmp_path / "o"), str(tmp_path / "ck"))
    got = {r["username"]: (r["best_mae"], r["n"], r["rank"]) for r in best.collect()}
    assert got == {"u": (1.0, 2, 1), "v": (2.0, 1, 2)}
    assert tuple(spark.read.parquet(str(tmp_path / "o-kpis")).select("best_mae", "total", "participants").first()) == (1.0, 3, 2)


def test_late_submissions_count(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("subs", "o", "ck"))
    for i, (row, day) in enumerate([(("a", "u", 3.0), "06-01"), (("b", "v", 2.0), "06-02"), (("c", "w", 1.0), "01-01"), (("a", "u", 3.0), "06-03")]):
        rec = spark.createDataFrame([row], "id STRING, username STRING, mae DOUBLE")
        rec = rec.select("id", "username", F.struct("mae").alias("metrics"), F.lit(f"2024-{day}T00:00:00").alias("date"))
        rec.coalesce(1).write.mode("append").json(src)
        if i == 1:
            jobs.run_best_per_user(spark, src, out, ck, files_per_trigger=1)
    best = jobs.run_best_per_user(spark, src, out, ck, files_per_trigger=1)
    got = {r["username"]: (r["best_mae"], r["n"], r["rank"]) for r in best.collect()}
    assert got == {"w": (1.0, 1, 1), "v": (2.0, 1, 2), "u": (3.0, 1, 3)}


def test_sparse_export_keeps_columns(spark, tmp_path):
    rows = [(0, "S1", 0.1), (0, "S2", 0.2), (0, "S3", 0.3), (0, "S4", None), (1, "S1", 0.4), (1, "S3", 0.5), (2, "S4", 0.6)]
    cells = spark.createDataFrame(rows, "probe_ord BIGINT, sample_id STRING, beta DOUBLE")
    out = str(tmp_path / "sparse")
    mf.export_wide(cells, out)
    back = {(r["probe_ord"], r["sample_id"]): r["beta"] for r in mf.read_wide(spark, out).collect()}
    assert back == {(p, s): next((b for q, t, b in rows if (q, t) == (p, s)), None) for p in range(3) for s in ("S1", "S2", "S3", "S4")}
    with pytest.raises(Exception, match="two values of one sample"):
        mf.export_wide(cells.unionByName(cells.where("probe_ord = 1")), str(tmp_path / "twice"))
