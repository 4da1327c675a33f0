"""Scalar column functions; all stay inside Spark expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that the results depend on.
M_VALUE_EPSILON = 1e-6
ADULT_AGE = 20.0
UNKNOWN_ETHNICITY = "Inconnu"
UNKNOWN_ETHNICITY_SPELLINGS = ["", "unavailable", "declined", "other"]


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def m_value(beta: str | Column, eps: float = M_VALUE_EPSILON) -> Column:
    """log2(b / (1 - b)) with b clipped to [eps, 1 - eps]; null stays null."""
    b = _c(beta)
    clipped = F.least(F.greatest(b, F.lit(eps)), F.lit(1.0 - eps))
    return F.when(b.isNotNull(), F.log2(clipped / (1.0 - clipped)))


def age_to_clock(age: str | Column) -> Column:
    """Log-linear age scale: logarithmic up to adult age, linear above."""
    a = _c(age)
    return F.when(a <= ADULT_AGE, F.log(a + 1.0) - F.log(F.lit(ADULT_AGE + 1.0))).otherwise(
        (a - ADULT_AGE) / (ADULT_AGE + 1.0)
    )


def clock_to_age(t: str | Column) -> Column:
    """Inverse of :func:`age_to_clock`."""
    t = _c(t)
    return F.when(t <= 0, F.exp(t + F.log(F.lit(ADULT_AGE + 1.0))) - 1.0).otherwise((ADULT_AGE + 1.0) * t + ADULT_AGE)


def parse_bool(col: str | Column) -> Column:
    """Boolean from booleans, 0/1 and any-case true/false strings; anything else is null."""
    s = F.lower(F.trim(_c(col).cast("string")))
    return F.when(s.isin("true", "1", "1.0"), F.lit(True)).when(s.isin("false", "0", "0.0"), F.lit(False))


def sex_label(col: str | Column, female: str = "F", male: str = "M", unknown: str = "unknown") -> Column:
    b = parse_bool(col)
    return F.when(b, female).when(~b, male).otherwise(unknown)


def bin_by(
    col: str | Column,
    edges: Sequence[float],
    labels: Sequence | None = None,
    closed: str = "right",
    include_lowest: bool = False,
) -> Column:
    """Label of the interval holding the value; outside all intervals gives null.

    ``closed='right'`` means (lo, hi], ``closed='left'`` means [lo, hi).
    """
    x = _c(col)
    labels = list(labels) if labels is not None else list(range(len(edges) - 1))
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    if closed not in ("left", "right"):
        raise ValueError("closed must be 'left' or 'right'")
    out = None
    for i, label in enumerate(labels):
        lo, hi = float(edges[i]), float(edges[i + 1])
        if closed == "right":
            low = (x >= lo) if include_lowest and i == 0 else (x > lo)
            hit = low & (x <= hi)
        else:
            hit = (x >= lo) & (x < hi)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def digitize(col: str | Column, edges: Sequence[float]) -> Column:
    """Number of ascending edges at or below the value (0 .. len(edges))."""
    x = _c(col)
    out = F.when(x.isNull(), F.lit(None))
    for i, e in enumerate(edges):
        out = out.when(x < float(e), F.lit(i))
    return out.otherwise(F.lit(len(edges))).cast("long")


def digitize_array(col: str | Column, edges: str | Column) -> Column:
    """As :func:`digitize` with the edges in an array column."""
    x = _c(col)
    return F.size(F.filter(_c(edges), lambda e: e <= x)).cast("long")


def clean_ethnicity(col: str | Column) -> Column:
    t = F.trim(_c(col))
    unknown = t.isNull() | F.lower(t).isin(*UNKNOWN_ETHNICITY_SPELLINGS)
    return F.when(unknown, UNKNOWN_ETHNICITY).otherwise(t)


def strip_number_prefix(col: str | Column) -> Column:
    """``'3. Ridge'`` becomes ``'Ridge'``."""
    return F.regexp_replace(F.trim(_c(col)), r"^\d+\.\s*", "")


def after_first_dot(col: str | Column) -> Column:
    """Text after the first ``'. '``; unchanged when there is none."""
    t = F.trim(_c(col))
    at = F.instr(t, ". ")
    return F.when(at > 0, F.substring(t, at + 2, F.length(t))).otherwise(t)


def chip_id(col: str | Column) -> Column:
    return F.substring_index(_c(col), "_R", 1)


def error(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    return F.col(y_pred) - F.col(y_true)


def short_hash(*cols: str | Column, length: int = 8) -> Column:
    return F.substring(F.md5(F.concat(*[_c(c) for c in cols])), 1, length)


def iso_date(col: str | Column) -> Column:
    return F.to_date(F.substring(_c(col), 1, 10))


def text_or(col: str | Column, default: str) -> Column:
    c = _c(col)
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str, drop_first: bool = False) -> DataFrame:
    """0/1 columns per value in alphabetical order; a null matches no value."""
    kept = sorted(values)[1 if drop_first else 0 :]
    return df.withColumns(
        {f"{prefix}_{v}": F.coalesce((F.col(col) == v).cast("double"), F.lit(0.0)) for v in kept}
    )


def ordinal_code(col: str | Column, codes: Mapping[str, int]) -> Column:
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(col)).cast("long")


def config_key(*cols: str | Column) -> Column:
    return F.concat_ws("_", *[_c(c).cast("string") for c in cols])


def direction(coef: str | Column, positive: str = "older", negative: str = "younger") -> Column:
    return F.when(_c(coef) > 0, positive).otherwise(negative)


def threshold_label(col: str | Column, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """First label whose bound exceeds the value; the last label catches the rest."""
    x = _c(col)
    out = F.when(x.isNull(), F.lit(None))
    for b, label in zip(bounds, labels):
        out = out.when(x < b, label)
    return out.otherwise(labels[-1])


def p_stars(p: str | Column) -> Column:
    return threshold_label(p, [0.001, 0.01, 0.05], ["***", "**", "*", "ns"])


def pad_to_grid(vec: str | Column, rows: int, cols: int) -> Column:
    """Zero-pad an array to rows * cols values and cut it into rows."""
    v = _c(vec)
    room = F.greatest(F.lit(0), F.lit(rows * cols) - F.size(v))
    full = F.concat(v, F.array_repeat(F.lit(0.0), room))
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(full, i * cols + 1, cols))


def polynomial2(vec: str | Column) -> Column:
    """Degree-2 expansion without bias: the values, then x_i * x_j for i <= j."""
    v = _c(vec)
    products = F.flatten(F.transform(v, lambda x, i: F.transform(F.slice(v, i + 1, F.size(v) - i), lambda y: x * y)))
    return F.concat(v, products)
