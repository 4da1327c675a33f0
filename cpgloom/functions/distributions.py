"""Small numeric helpers for columns of already aggregated results (no SciPy here)."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Two-sided 95 % points of Student's t for 1 .. 30 degrees of freedom.
T_975 = [
    12.706204736432095, 4.302652729696142, 3.182446305284263, 2.7764451051977987, 2.5705818366147395,
    2.4469118487916806, 2.3646242510102993, 2.3060041350333704, 2.2621571627409915, 2.2281388519649385,
    2.200985160082949, 2.1788128296634177, 2.1603686564610127, 2.1447866879169273, 2.131449545559323,
    2.1199052992210112, 2.1098155778331806, 2.10092204024096, 2.093024054408263, 2.0859634472658364,
    2.079613844727662, 2.0738730679040147, 2.0686576104190406, 2.0638985616280205, 2.059538552753294,
    2.055529438642871, 2.0518305164802833, 2.048407141795244, 2.045229642132703, 2.0422724563012373,
]


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz iteration)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    if df > 1e7:  # the normal with its 1/df terms: the beta function loses digits here
        return normal_two_sided(t * (1.0 - 0.25 / df) / math.sqrt(1.0 + t * t / (2.0 * df)))
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else normal_two_sided(v)).astype("float64")


# The normal quantile's rational approximation AS 241 (Wichura 1988), accurate to 16 digits.  By range:
# numerator, then denominator, from the constant term up.
QUANTILE_CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
QUANTILE_SIDE = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
QUANTILE_TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)


def _ratio(x: Column, polynomials: tuple[list[float], list[float]]) -> Column:
    top, bottom = (reduce(lambda value, c: value * x + F.lit(c), reversed(p[:-1]), F.lit(p[-1])) for p in polynomials)
    return top / bottom


def normal_quantile(p: str | Column) -> Column:
    """Standard normal quantile of ``p`` by SQL functions; null unless 0 < p < 1."""
    p = (F.col(p) if isinstance(p, str) else p).cast("double")
    off = p - 0.5
    depth = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    outside = F.when(depth <= 5.0, _ratio(depth - 1.6, QUANTILE_SIDE)).otherwise(_ratio(depth - 5.0, QUANTILE_TAIL))
    near = off * _ratio(0.180625 - off * off, QUANTILE_CENTRE)
    return F.when((p > 0) & (p < 1), F.when(F.abs(off) <= 0.425, near).otherwise(F.signum(off) * outside))


def t_975(df_col):
    """95 % two-sided t point: the table up to 30 degrees, then a four-term expansion in 1/df."""
    z = NormalDist().inv_cdf(0.975)
    n = df_col.cast("double")
    terms = (
        F.lit(z)
        + (z**3 + z) / 4 / n
        + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (n * n)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (n * n * n)
    )
    exact = F.try_element_at(F.array(*[F.lit(v) for v in T_975]), df_col.cast("int"))
    return F.when(df_col <= 0, F.lit(None)).when(df_col <= len(T_975), exact).otherwise(terms)
