"""Filters, projections, key matching and set operations used by the reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cpgloom.functions import scalars as sc
from cpgloom.operators.sizing import sized

# Named age ranges of the sample browser.
YOUNG_BELOW = 30
OLD_ABOVE = 60


def select_renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Existing columns in mapping order under their new names."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items() if old in df.columns])


def alias_fallback(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Rename alternative headers to the expected ones unless those exist already."""
    for old, new in aliases.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def contains_text(col: str, needle: str) -> Column:
    """Literal, case-insensitive substring match; null never matches."""
    return F.coalesce(F.lower(F.col(col)).contains(needle.lower()), F.lit(False))


def age_range(col: str, name: str) -> Column:
    a = F.col(col)
    ranges = {
        "all": F.lit(True),
        "young": a < YOUNG_BELOW,
        "middle": a.between(YOUNG_BELOW, OLD_ABOVE),
        "old": a > OLD_ABOVE,
    }
    return ranges[name]


def browse_samples(
    preds: DataFrame, model: str, split: str = "all", search: str = "", ages: str = "all", digits: int = 2
) -> DataFrame:
    """The sample browser: filter chain, derived columns, cleaned categories, sorted by age."""
    df = preds.where(F.col("model") == model)
    if split and split != "all":
        df = df.where(F.col("split") == split)
    if search:
        df = df.where(contains_text("sample_description", search))
    # The labels "Femme", "Homme" and "?" are shown as they are.
    df = df.where(age_range("y_true", ages or "all")).withColumns(
        {
            "delta_age": F.round(sc.error(), digits) + F.lit(0.0),
            "sex": sc.sex_label("female", "Femme", "Homme", "?"),
            "ethnicity": sc.clean_ethnicity("ethnicity"),
        }
    )
    shown = {
        "sample_description": "sample",
        "sample_id": "sample_id",
        "sample_name": "name",
        "sex": "sex",
        "y_true": "age",
        "y_pred": "predicted_age",
        "delta_age": "delta_age",
        "ethnicity": "ethnicity",
        "split": "set",
    }
    out = select_renamed(df, shown)
    return out.withColumns({c: F.round(c, digits) for c in ("age", "predicted_age")}).orderBy("age", "sample_id")


def matched_ids(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows of ``left`` whose key exists on the right."""
    return left.join(right.select(key).distinct(), key, "left_semi")


def reconcile(uploaded: DataFrame, expected: DataFrame, key: str = "sample_id") -> DataFrame:
    """Every id with its status: matched, missing (only expected) or extra (only uploaded)."""
    u = uploaded.select(F.col(key).cast("string").alias(key)).distinct().withColumn("_u", F.lit(True))
    e = expected.select(F.col(key).cast("string").alias(key)).distinct().withColumn("_e", F.lit(True))
    both = F.col("_u").isNotNull() & F.col("_e").isNotNull()
    status = F.when(both, "matched").when(F.col("_e").isNotNull(), "missing").otherwise("extra")
    return u.join(e, key, "full").select(key, status.alias("status"))


def coverage(required: DataFrame, available: DataFrame, owner: str = "clock", key: str = "probe_id") -> DataFrame:
    """Found, total and percent of required keys per owner."""
    have = available.select(key).distinct().withColumn("_hit", F.lit(1))
    return (
        required.select(owner, key)
        .join(sized(have), key, "left")
        .groupBy(owner)
        .agg(F.count("_hit").alias("found"), F.count("*").alias("total"))
        .withColumn("pct", F.col("found") * 100.0 / F.col("total"))
    )


def union_new_names(first: DataFrame, second: DataFrame, key: str = "model") -> DataFrame:
    """First source, then rows of the second whose cleaned name is new."""
    a = first.withColumn(key, sc.after_first_dot(key))
    b = second.withColumn(key, sc.after_first_dot(key))
    return a.unionByName(b.join(sized(a.select(key).distinct()), key, "left_anti"))


def feature_blocks(blocks: Sequence[DataFrame], key: str = "sample_id") -> DataFrame:
    """Concatenate per-sample feature arrays (each block: key, features) left to right."""
    out = blocks[0].withColumnRenamed("features", "_f0")
    for i, b in enumerate(blocks[1:], start=1):
        out = out.join(b.select(key, F.col("features").alias(f"_f{i}")), key)
    names = [f"_f{i}" for i in range(len(blocks))]
    return out.withColumn("features", F.concat(*names)).drop(*names)


def params_to_map(eav: DataFrame) -> DataFrame:
    """(model, parameter, value) rows to one map per model; a model has few parameters."""
    pairs = F.sort_array(F.collect_set(F.struct("parameter", "value")))
    return eav.groupBy("model").agg(F.map_from_entries(pairs).alias("params"))


def map_to_params(maps: DataFrame) -> DataFrame:
    return maps.select("model", F.explode("params").alias("parameter", "value"))


def params_wide(eav: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """One column per parameter, ``-`` where a model lacks it."""
    wide = eav.groupBy("model").pivot("parameter", list(parameters)).agg(F.min("value"))
    return wide.select("model", *[F.coalesce(F.col(p), F.lit("-")).alias(p) for p in parameters])
