"""Guarded arithmetic, growth, the normal distribution and vector similarity as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def positive(c: Column) -> Column:
    """Text or number as a positive finite double, else null."""
    x = finite(c.try_cast("double"))
    return F.when(x > 0, x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def yoy(current: Column, previous: Column) -> Column:
    """Growth on the year before in percent, null where that was zero."""
    return ratio(current - previous, F.abs(previous)) * 100


# W. J. Cody's rational approximations of the error function, near zero and beyond.
ERF_NEAR = 0.46875
ERF_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
ERF_C = (
    5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
    1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8,
)
ERF_D = (
    1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
    4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03,
)


def _rational(x: Column | np.ndarray, above: tuple[float, ...], below: tuple[float, ...]) -> Column | np.ndarray:
    """above[-1] leads the numerator's polynomial, one the denominator's."""
    top, bottom = x * above[-1], x
    for p, q in zip(above[:-2], below[:-1], strict=True):
        top, bottom = (top + p) * x, (bottom + q) * x
    return (top + above[-2]) / (bottom + below[-1])


def erf(x: Column) -> Column:
    """The error function, within 1e-15 of its value."""
    a = F.abs(x)
    near = x * _rational(x * x, ERF_A, ERF_B)
    far = F.signum(x) * (1 - F.exp(-x * x) * _rational(F.least(a, F.lit(6.0)), ERF_C, ERF_D))
    return F.when(a <= ERF_NEAR, near).when(a < 6, far).otherwise(F.signum(x))


def norm_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / 1.4142135623730951))


def norm_cdf_tail(x: Column) -> Column:
    """``norm_cdf`` of x under -0.67 with the digits that 1 + erf loses, so that small ones keep their order; 0 under -8.4, as in ``norm_cdf_sql``."""
    a = x / -1.4142135623730951
    return F.when(x < -8.4, 0.0).otherwise(0.5 * F.exp(-a * a) * _rational(a, ERF_C, ERF_D))


def norm_cdf_array(x: np.ndarray) -> np.ndarray:
    """``norm_cdf`` of the numbers of an array."""
    x = x / 1.4142135623730951
    a = np.abs(x)
    near = x * _rational(np.minimum(a, ERF_NEAR) ** 2, ERF_A, ERF_B)
    far = np.sign(x) * (1 - np.exp(-x * x) * _rational(np.minimum(a, 6.0), ERF_C, ERF_D))
    return 0.5 * (1 + np.where(a <= ERF_NEAR, near, np.where(a < 6, far, np.sign(x))))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / 2.5066282746310002


def norm_cdf_sql(x: str) -> str:
    """By its power series x + x^3 / 3 + x^5 / (3 * 5) + ..., which shares nothing with ``norm_cdf``."""
    term = "exp((2 * k + 1) * ln(greatest(abs(v), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))"
    series = f"0.5 + sign(v) * exp(-v * v / 2) / 2.5066282746310002 * list_sum(list_transform(range(0, 150), lambda k: {term}))"
    return f"(list_transform([({x})::DOUBLE], lambda v: CASE WHEN v > 8.4 THEN 1.0 WHEN v < -8.4 THEN 0.0 WHEN v IS NOT NULL THEN {series} END)[1])"


def norm_pdf_sql(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) / 2.5066282746310002)"


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# The published response surface of the Engle-Granger statistic of two series with a constant.
EG_LOW, EG_HIGH, EG_BREAK, EG_MOST = -18.86, 0.92, -2.62, "2.92 + 1.5012 * t + 0.039796 * t * t"
EG_UPPER = "2.1945 + 0.64695 * t - 0.29198 * t * t - 0.042377 * t * t * t"


def with_engle_granger_p(df: DataFrame, t: str, name: str = "p") -> DataFrame:
    """``df`` with ``name``, the p of the Engle-Granger statistic in the column ``t``.

    The argument of the normal distribution is a column of its own on the way, and p is generated as a list of one, through which no
    later filter is pushed: written into every place of the rational functions the argument makes an expression that is too long to be compiled.
    """
    polynomial = lambda x: F.expr(x.replace("t", t))
    c, x = F.col(t), F.col("_eg_x")
    cut = df.withColumn("_eg_x", F.when(c <= EG_BREAK, polynomial(EG_MOST)).when(c > EG_BREAK, polynomial(EG_UPPER)))
    most, upper = norm_cdf_tail(x), norm_cdf(x)  # the first polynomial is under -0.73 up to the break
    p = F.when(c <= EG_LOW, 0.0).when(c > EG_HIGH, 1.0).when(c <= EG_BREAK, most).when(c > EG_BREAK, upper)
    return cut.select(*df.columns, F.inline(F.array(F.struct(p.alias(name)))))


def engle_granger_p_sql(t: str) -> str:
    polynomial = lambda x: norm_cdf_sql(x.replace("t", f"({t})"))
    return f"CASE WHEN {t} <= {EG_LOW} THEN 0.0 WHEN {t} > {EG_HIGH} THEN 1.0 WHEN {t} <= {EG_BREAK} THEN {polynomial(EG_MOST)} ELSE {polynomial(EG_UPPER)} END"
