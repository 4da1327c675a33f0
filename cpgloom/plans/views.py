"""Domain views over the given tables, once as DataFrames and once as SQL text.

The tables carry neither missing values nor an age signal; each view adds both with integer
arithmetic that every engine evaluates alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sid(col: str = "vec_id"):
    return F.concat(F.lit("S"), F.lpad(F.col(col).cast("string"), 6, "0"))


def _age(col: str):
    return F.lit(18.0) + ((F.col(col) * 37) % 720).cast("double") / 10.0


def annot(spark, d):
    """Raw annotations: null ages, boolean-ish strings, untidy ethnicity."""
    v = F.col("vec_id")
    female = F.when(v % 5 == 0, "True").when(v % 5 == 1, "FALSE").when(v % 5 == 2, "TRUE").when(v % 5 == 3, "false")
    eth = F.when(v % 7 == 0, "White")
    for i, name in enumerate(["Black", "Hispanic", "Asian", " Unavailable", "Declined"], start=1):
        eth = eth.when(v % 7 == i, name)
    return table(spark, d, "embeddings").select(
        _sid().alias("sample_id"),
        "vec_id",
        F.when(v % 97 != 0, _age("vec_id")).alias("age"),
        female.alias("female"),
        eth.alias("ethnicity"),
    )


def beta(spark, d):
    """Long matrix: one row per (sample, probe), missing cells kept as null."""
    p, v = F.col("probe_ord"), F.col("vec_id")
    signal = 0.25 * (F.col("v") + 1.0) + _age("vec_id") / 250.0 * (p % 8).cast("double") / 8.0
    return (
        table(spark, d, "embeddings")
        .select(_sid().alias("sample_id"), "vec_id", F.posexplode("embedding").alias("probe_ord", "v"))
        .select("sample_id", "vec_id", p.cast("long").alias("probe_ord"), F.col("v").cast("double").alias("v"))
        .select(
            "sample_id",
            "vec_id",
            "probe_ord",
            F.when(p == 63, F.lit(None))
            .when(p == 62, F.lit(0.5))
            .when((v * 7 + p * 13) % 20 == 0, F.lit(None))
            .otherwise(signal)
            .cast("double")
            .alias("beta"),
        )
    )


def probes(spark, d):
    return (
        table(spark, d, "embeddings")
        .select(F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("p"))
        .distinct()
        .select(F.col("p").cast("long").alias("probe_ord"))
        .withColumn("probe_id", probe_id("probe_ord"))
    )


def probe_id(col: str):
    return F.concat(F.lit("cg"), F.lpad(F.col(col).cast("string"), 8, "0"))


def aged(spark, d):
    """Matrix cells of samples with a known age, with that age attached."""
    a = annot(spark, d).where("age is not null").select("sample_id", "age", "female")
    return beta(spark, d).join(a, "sample_id")


def preds(spark, d):
    models = [("ElasticNet", 0.3, 1.0, 0.05), ("Ridge", -0.2, 1.3, 0.02), ("AltumAge", 2.0, 2.5, 0.30)]
    each = F.array(
        *[
            F.struct(F.lit(n).alias("model"), F.lit(b).alias("bias"), F.lit(s).alias("scale"), F.lit(k).alias("shrink"))
            for n, b, s, k in models
        ]
    )
    raw = ((F.col("o_orderkey") * 37) % 720).cast("double") / 10.0
    y_true = F.lit(18.0) + raw
    y_pred = (
        y_true
        + F.col("m.bias")
        + F.col("m.scale") * ((F.col("o_totalprice") % 1000.0) / 100.0 - 5.0)
        - F.col("m.shrink") * (raw - 36.0)
    )
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (
        table(spark, d, "orders")
        .select("o_orderkey", "o_custkey", "o_totalprice")
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("m", F.explode(each))
        .select(
            F.col("m.model").alias("model"),
            F.col("o_orderkey").alias("sample_id"),
            y_true.alias("y_true"),
            y_pred.alias("y_pred"),
            F.when(F.col("o_custkey") % 2 == 0, "True").otherwise("False").alias("female"),
            F.col("c_mktsegment").alias("ethnicity"),
            F.concat(F.col("c_nationkey").cast("string"), F.lit("_R"), (F.col("o_orderkey") % 8).cast("string")).alias(
                "sample_description"
            ),
            F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias("split"),
        )
    )


def trials(spark, d):
    """Tuning trials: a strategy and model per row with test error, ratio and time."""
    key = F.concat_ws(
        "-",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.date_format("l_shipdate", "yyyyMMdd"),
        F.col("l_quantity").cast("long").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
    )
    model = F.when(F.col("l_returnflag") == "A", "Ridge").when(F.col("l_returnflag") == "N", "Lasso")
    return table(spark, d, "lineitem").select(
        key.alias("trial_id"),
        F.when(F.col("l_linestatus") == "O", "PCA").otherwise("TopN").alias("strategy"),
        (F.col("l_linenumber") * 100).cast("long").alias("n_features"),
        model.otherwise("ElasticNet").alias("model_name"),
        (F.col("l_extendedprice") / 1e4).alias("mae_test"),
        F.col("l_quantity").cast("long").alias("n_trials"),
        (F.lit(1.0) + F.col("l_discount") * 60.0).alias("overfitting_ratio"),
        (F.col("l_tax") * 10.0).alias("time_min"),
    )


def fold_scores(spark, d):
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    return (
        preds(spark, d)
        .groupBy("model", (F.col("sample_id") % 5).alias("fold"))
        .agg(
            F.avg(e).alias("mae"),
            (1 - F.sum(e * e) / (F.var_pop("y_true") * F.count("*"))).alias("r2"),
        )
    )


def submissions(spark, d):
    """Flat submission records; a third of the descriptions is empty."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        F.col("event_type").alias("model_category"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("run "), k.cast("string"))).alias("description"),
        F.col("value").alias("mae"),
        (F.col("value") * 1.25).alias("rmse"),
        k.alias("n_samples"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
    )


def clock_coef(spark, d):
    """Five linear clocks over the probe list; every fourth weight names an unknown probe."""
    c = F.col("clock_no")
    p = F.col("probe_ord")
    return (
        probes(spark, d)
        .withColumn("clock_no", F.explode(F.array(*[F.lit(i).cast("long") for i in range(1, 6)])))
        .where((p + c) % 3 != 0)
        .select(
            F.concat(F.lit("clock"), c.cast("string")).alias("clock"),
            F.when((p + c) % 4 == 0, F.concat(F.lit("xx"), F.col("probe_id"))).otherwise(F.col("probe_id")).alias("probe_id"),
            (((p * (c + 2)) % 11 - 5).cast("double") / 20.0).alias("coef"),
            (c.cast("double") / 10.0).alias("intercept"),
        )
    )


VIEW_SQL: dict[str, tuple[str, str]] = {
    # name: (views it needs, SELECT text)
    "annot": (
        "",
        """SELECT 'S' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS sample_id, vec_id,
       CASE WHEN vec_id % 97 = 0 THEN NULL
            ELSE 18.0::DOUBLE + CAST((vec_id * 37) % 720 AS DOUBLE) / 10.0::DOUBLE END AS age,
       CASE vec_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'TRUE'
                       WHEN 3 THEN 'false' ELSE NULL END AS female,
       CASE vec_id % 7 WHEN 0 THEN 'White' WHEN 1 THEN 'Black' WHEN 2 THEN 'Hispanic'
                       WHEN 3 THEN 'Asian' WHEN 4 THEN ' Unavailable' WHEN 5 THEN 'Declined'
                       ELSE NULL END AS ethnicity
FROM embeddings""",
    ),
    "exploded": (
        "",
        """SELECT 'S' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS sample_id, vec_id,
       CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS probe_ord,
       CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings""",
    ),
    "beta_long": (
        "exploded",
        """SELECT sample_id, vec_id, probe_ord,
       CASE WHEN probe_ord = 63 THEN NULL
            WHEN probe_ord = 62 THEN 0.5::DOUBLE
            WHEN (vec_id * 7 + probe_ord * 13) % 20 = 0 THEN NULL
            ELSE 0.25::DOUBLE * (v + 1.0::DOUBLE)
               + (18.0::DOUBLE + CAST((vec_id * 37) % 720 AS DOUBLE) / 10.0::DOUBLE) / 250.0::DOUBLE
                 * CAST(probe_ord % 8 AS DOUBLE) / 8.0::DOUBLE
       END AS beta FROM exploded""",
    ),
    "probes": (
        "exploded",
        "SELECT DISTINCT probe_ord, 'cg' || lpad(CAST(probe_ord AS VARCHAR), 8, '0') AS probe_id FROM exploded",
    ),
    "aged": (
        "beta_long annot",
        "SELECT b.*, a.age, a.female FROM beta_long b JOIN annot a USING (sample_id) WHERE a.age IS NOT NULL".replace(
            "USING (sample_id)", "ON a.sample_id = b.sample_id"
        ),
    ),
    "pred_long": (
        "",
        """SELECT m.model, o.o_orderkey AS sample_id,
       18.0::DOUBLE + CAST((o.o_orderkey * 37) % 720 AS DOUBLE) / 10.0::DOUBLE AS y_true,
       18.0::DOUBLE + CAST((o.o_orderkey * 37) % 720 AS DOUBLE) / 10.0::DOUBLE + m.bias
         + m.scale * ((o.o_totalprice % 1000.0::DOUBLE) / 100.0::DOUBLE - 5.0::DOUBLE)
         - m.shrink * (CAST((o.o_orderkey * 37) % 720 AS DOUBLE) / 10.0::DOUBLE - 36.0::DOUBLE) AS y_pred,
       CASE WHEN o.o_custkey % 2 = 0 THEN 'True' ELSE 'False' END AS female,
       c.c_mktsegment AS ethnicity,
       CAST(c.c_nationkey AS VARCHAR) || '_R' || CAST(o.o_orderkey % 8 AS VARCHAR) AS sample_description,
       CASE WHEN o.o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
CROSS JOIN (
  SELECT 'ElasticNet' AS model, 0.3::DOUBLE AS bias, 1.0::DOUBLE AS scale, 0.05::DOUBLE AS shrink
  UNION ALL SELECT 'Ridge', -0.2::DOUBLE, 1.3::DOUBLE, 0.02::DOUBLE
  UNION ALL SELECT 'AltumAge', 2.0::DOUBLE, 2.5::DOUBLE, 0.30::DOUBLE) m""",
    ),
    "trials": (
        "",
        """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'),
                 CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS trial_id,
       CASE WHEN l_linestatus = 'O' THEN 'PCA' ELSE 'TopN' END AS strategy,
       CAST(l_linenumber * 100 AS BIGINT) AS n_features,
       CASE l_returnflag WHEN 'A' THEN 'Ridge' WHEN 'N' THEN 'Lasso' ELSE 'ElasticNet' END AS model_name,
       l_extendedprice / 1e4 AS mae_test, CAST(l_quantity AS BIGINT) AS n_trials,
       1.0::DOUBLE + l_discount * 60.0::DOUBLE AS overfitting_ratio, l_tax * 10.0::DOUBLE AS time_min
FROM lineitem""",
    ),
    "fold_scores": (
        "pred_long",
        """SELECT model, sample_id % 5 AS fold, avg(abs(y_true - y_pred)) AS mae,
       1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) AS r2
FROM pred_long GROUP BY ALL""",
    ),
    "submissions": (
        "",
        """SELECT event_id AS seq, 'u' || CAST(user_id AS VARCHAR) AS username, event_type AS model_category,
       CASE WHEN event_id % 3 = 0 THEN '' ELSE 'run ' || CAST(k AS VARCHAR) END AS description,
       value AS mae, value * 1.25::DOUBLE AS rmse, k AS n_samples, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    ),
    "clock_coef": (
        "probes",
        """SELECT 'clock' || CAST(c AS VARCHAR) AS clock,
       CASE WHEN (probe_ord + c) % 4 = 0 THEN 'xx' || probe_id ELSE probe_id END AS probe_id,
       CAST((probe_ord * (c + 2)) % 11 - 5 AS DOUBLE) / 20.0::DOUBLE AS coef, CAST(c AS DOUBLE) / 10.0::DOUBLE AS intercept
FROM probes, generate_series(1, 5) g(c) WHERE (probe_ord + c) % 3 <> 0""",
    ),
}


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the CTEs it uses, dependencies first."""
    seen: list[str] = []

    def need(name: str) -> None:
        if name in seen:
            return
        for dep in VIEW_SQL[name][0].split():
            need(dep)
        seen.append(name)

    for n in names.split():
        need(n)
    body = body.strip()
    if not seen:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n][1]})" for n in seen)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
