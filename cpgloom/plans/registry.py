"""Query registry: one name, one Spark callable and, where SQL can say it, one oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cpgloom.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the views named in ``views``."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return keep


def r(expr: str, digits: int = 8) -> str:
    """Rounded SQL expression; adding zero turns -0.0 into 0.0.

    Eight digits keep averages of the five-decimal inputs off the rounding midpoints.
    """
    return f"round({expr}, {digits}) + 0.0"


def rounded(df: DataFrame, *cols: str, digits: int = 8) -> DataFrame:
    """Same rounding on the Spark side for the named (default: all double) columns."""
    names = cols or tuple(f.name for f in df.schema.fields if f.dataType.typeName() == "double")
    return df.withColumns({c: rd(F.col(c), digits) for c in names})


def rd(col: Column, digits: int = 8) -> Column:
    return F.round(col, digits) + F.lit(0.0)


def long(*names: str):
    """Casts for counters, which the oracle reports as BIGINT."""
    return {n: F.col(n).cast("long") for n in names}
