"""Queries on designs with more features than samples: all probes and all their products, in sample space."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.functions.scalars import polynomial2
from cpgloom.operators import components as pc
from cpgloom.operators import linear as ln
from cpgloom.operators import sample_space as ss
from cpgloom.operators.ensembles import RATIOS
from cpgloom.operators.ordering import running
from cpgloom.operators.splits import kfold
from cpgloom.plans.matrix_queries import SPLIT_SQL, TRAIN_SQL
from cpgloom.plans.model_queries import split_design
from cpgloom.plans.registry import query
from cpgloom.session import materialize

# Every probe with values; the others of the 64 have none.
PROBES = 63
# What the training rows hold: samples, probes with values, and these with their squares and products.
SIZE_SQL = f"""{TRAIN_SQL}, u AS (SELECT count(DISTINCT probe_ord) AS p FROM train WHERE beta IS NOT NULL),
size AS (SELECT (SELECT count(*) FROM parts WHERE split = 'train') AS n, p + p * (p + 1) // 2 AS width FROM u)"""


def wide_rows(spark, d) -> DataFrame:
    """Training rows with fold: (sample_id, label, fold, features ARRAY), standardised probes and their products."""
    rows = split_design(spark, d, PROBES).where("split = 'train'")
    wide = rows.select("sample_id", "label", polynomial2(vector_to_array("features")).alias("features"))
    return materialize(kfold(wide, 3), "wide")


def wide_cells(rows: DataFrame) -> DataFrame:
    return rows.select("sample_id", F.posexplode("features").alias("feature", "z"))


def checked(rows: DataFrame, cells: DataFrame, fit: ln.LinearFit, **tags) -> DataFrame:
    """One row: how many features the fit has, and how many miss its optimality condition."""
    gaps = ss.optimality(cells, rows, fit)
    return gaps.agg(
        *[F.lit(x).alias(c) for c, x in tags.items()],
        F.count("*").alias("n_features"),
        F.count_if(F.col("gap") > 1e-6).alias("n_broken"),
        (F.count_if(F.col("coef") != 0) > 0).alias("has_weights"),
    )


@query(
    "m02_wide_elastic_net",
    f"WITH {SIZE_SQL} SELECT n AS n_samples, width AS n_features, 0::BIGINT AS n_broken, true AS has_weights FROM size",
    "annot beta_long",
)
def _(spark, d):
    """Tuned over 5 ratios x 50 strengths x 3 folds, then held against the optimality condition of every feature."""
    rows = wide_rows(spark, d)
    cells = materialize(wide_cells(rows), "wide-cells")
    fit = ln.design_sums(rows).tune(RATIOS, 50)
    n = rows.count()
    return checked(rows, cells, fit, n_samples=n).withColumn("n_samples", F.col("n_samples").cast("long"))


@query("m02_wide_predictions")
def _(spark, d):
    rows = split_design(spark, d, PROBES)
    wide = materialize(rows.withColumn("features", polynomial2(vector_to_array("features"))), "wide-all")
    train = kfold(wide.where("split = 'train'").select("sample_id", "label", "features"), 3)
    fit = ln.tuned_elastic_net(materialize(train, "wide"), RATIOS, 50)
    pred = ss.predict_cells(wide_cells(wide), fit)
    return wide.select("sample_id", "split", F.col("label").alias("y_true")).join(pred.withColumnRenamed("prediction", "y_pred"), "sample_id")


@query(
    "m01_wide_ridge",
    f"""WITH {SIZE_SQL} SELECT a AS alpha, n AS n_samples, width AS n_features, 0::BIGINT AS n_broken
FROM size, (SELECT unnest([1.0, 100.0]::DOUBLE[]) AS a)""",
    "annot beta_long",
)
def _(spark, d):
    """Ridge by the dual system, or by cross products where samples are many; its gradient ``X'r - alpha w`` is then summed per feature from the cells."""
    rows = wide_rows(spark, d)
    cells = materialize(wide_cells(rows), "wide-cells")
    space = ln.design_sums(rows)
    n, out = rows.count(), []
    for alpha in (1.0, 100.0):
        fit = space.fit(alpha, None)
        # The elastic net of strength alpha / n without its absolute term.
        gaps = ss.optimality(cells, rows, ln.LinearFit(fit.coef, fit.intercept, alpha / n, 0.0))
        size = [F.lit(alpha).alias("alpha"), F.lit(n).cast("long").alias("n_samples"), F.count("*").alias("n_features")]
        out.append(gaps.agg(*size, F.count_if(F.col("gap") > 1e-6).alias("n_broken")))
    return reduce(DataFrame.unionByName, out)


@query(
    "m12_wide_feature_sweep",
    f"""WITH {SIZE_SQL} SELECT k::BIGINT AS k, n, k::BIGINT AS n_features, 0::BIGINT AS n_broken, true AS has_weights
FROM size, (SELECT unnest([100, 500, 1000, 2000]) AS k)""",
    "annot beta_long",
)
def _(spark, d):
    """Prefixes of the feature list: scored out of fold, and the fit of each size held against its optimality."""
    rows = wide_rows(spark, d)
    cells = materialize(wide_cells(rows), "wide-cells")
    space = ln.design_sums(rows)
    sizes = [100, 500, 1000, 2000]
    scores = materialize(ln.k_sweep(space, sizes).where("mae is not null").select("k", "n"), "sweep")
    fits = [checked(rows, cells.where(F.col("feature") < k), space.fit(0.1, 0.5, range(min(k, space.width))), k=k) for k in sizes]
    return scores.join(reduce(DataFrame.unionByName, fits).withColumn("k", F.col("k").cast("long")), "k")


@query("m11_wide_elimination")
def _(spark, d):
    """From all products down to 50, 50 weakest a step, scored by three folds."""
    scores, _sizes = ln.eliminate(ln.design_sums(wide_rows(spark, d)), step=50, smallest=50)
    return scores.select("n_features", "n", "mae", "r2").orderBy("mae", "n_features")


@query("m21_wide_random_search")
def _(spark, d):
    """75 drawn (strength, ratio) pairs over all products."""
    return ln.random_search(ln.design_sums(wide_rows(spark, d)), 75)


# --- components -------------------------------------------------------------------------------

# The published setting, for models on components.
COMPONENTS = 400


@query(
    "m20_wide_components",
    f"""WITH {SIZE_SQL} SELECT n AS n_samples, width AS n_features, 50::BIGINT AS n_components, 0::BIGINT AS n_not_orthonormal,
0::BIGINT AS n_wrong_variance, 0::BIGINT AS n_correlated, 0::BIGINT AS n_rising FROM size""",
    "annot beta_long",
)
def _(spark, d):
    """50 components of all products, held against what defines them, from cells and axes: axes unit and orthogonal,
    scores without correlation, their variances the eigenvalues and falling."""
    rows = wide_rows(spark, d)
    found, made, scores = pc.of_design(rows, 50)
    n = rows.count()
    eigen = spark.createDataFrame([(i, float(s) ** 2 / (n - 1)) for i, s in enumerate(found.values)], "i INT, eigen DOUBLE")

    def products(table: DataFrame, column: str) -> DataFrame:
        """Sums of products of all pairs of entries i <= j, over the rows."""
        one = table.select(F.monotonically_increasing_id().alias("r"), F.posexplode(column).alias("i", "x"))
        one = materialize(one, "entries")
        other = one.withColumnsRenamed({"i": "j", "x": "y"})
        return one.join(other, "r").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))

    same = (F.col("i") == F.col("j")).cast("double")
    axes = products(made, "axis").agg(F.count_if(F.abs(F.col("dot") - same) > 1e-8).alias("n_not_orthonormal"))
    moments = products(scores(rows), "pc").withColumn("dot", F.col("dot") / (n - 1))
    moments = materialize(moments.join(F.broadcast(eigen), "i"), "moments")  # k rows
    close = F.abs(F.col("dot") - F.col("eigen")) <= 1e-8 * F.col("eigen")
    scale = float(found.values[0]) ** 2 / (n - 1)
    wrong = moments.agg(
        F.count_if(F.col("i") == F.col("j")).alias("n_components"),
        F.count_if((F.col("i") == F.col("j")) & ~close).alias("n_wrong_variance"),
        F.count_if((F.col("i") < F.col("j")) & (F.abs(F.col("dot")) > 1e-8 * scale)).alias("n_correlated"),
    )
    after = eigen.select((F.col("i") - 1).alias("i"), F.col("eigen").alias("later"))
    rising = eigen.join(after, "i").agg(F.count_if(F.col("later") > F.col("eigen")).alias("n_rising"))
    width = rows.agg(F.max(F.size("features")).cast("long").alias("n_features"))
    sizes = spark.createDataFrame([(n,)], "n_samples BIGINT")
    # One row each.
    return reduce(DataFrame.crossJoin, [sizes, width, axes, wrong, rising])


@query("w07_wide_cumulative_variance")
def _(spark, d):
    """Shares of the variance of all products, and their running sum, for as many components as there are."""
    rows = wide_rows(spark, d)
    found, *_ = pc.of_design(rows, COMPONENTS)
    shares = spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(found.share)], "component BIGINT, share DOUBLE")
    return running(shares, [], "component", "share", "cumulative")


def component_rows(spark, d, k: int | None):
    """Rows of all products, their training rows, and rows of scores on the training rows' components (None: all) with label and split."""
    rows = split_design(spark, d, PROBES)
    wide = materialize(rows.withColumn("features", polynomial2(vector_to_array("features"))), "wide-all")
    train = wide.where("split = 'train'").select("sample_id", "label", "features")
    *_, scores = pc.of_design(train, k)
    scored = scores(wide).select("sample_id", array_to_vector("pc").alias("features"))
    return wide, train, materialize(wide.select("sample_id", "split", "label").join(scored, "sample_id"), "component-rows")


@query("m20_component_predictions")
def _(spark, d):
    """Components in front of a model: elastic net on up to 400 components of the training rows."""
    *_, design = component_rows(spark, d, COMPONENTS)
    model = ln.elastic_net(0.1, 0.5).fit(design.where("split = 'train'"))
    return model.transform(design).select("sample_id", "split", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


@query(
    "m20_component_ridge",
    f"""WITH {SPLIT_SQL} SELECT split, count(*) AS n, 0::BIGINT AS n_off FROM parts GROUP BY split""",
    "annot beta_long",
)
def _(spark, d):
    """Ridge on all components of the training rows predicts what ridge on all products predicts."""
    wide, train, design = component_rows(spark, d, None)
    short = ln.ridge(100.0).fit(design.where("split = 'train'")).transform(design)
    fit = ln.design_sums(train.withColumn("fold", F.lit(0))).fit(100.0, None)
    full = ss.predict_cells(wide_cells(wide), fit).withColumnRenamed("prediction", "all_features")
    both = short.select("sample_id", "split", "prediction").join(full, "sample_id")
    return both.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("prediction") - F.col("all_features")) > 1e-5).alias("n_off"))
