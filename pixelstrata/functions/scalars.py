"""Small native column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def rnd(c, digits: int = 6) -> Column:
    """Round a statistic for stable comparison between engines.

    Means over 2^k pixels often sit exactly on a rounding boundary, where the
    summation order decides; the small offset moves such ties off the boundary.
    """
    return F.round(dbl(c) + F.lit(3.7 * 10.0 ** (-digits - 4)), digits)


def big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def safe_div(num, den) -> Column:
    """num / den, NULL where the denominator is (nearly) zero or either is not finite."""
    n, d = dbl(num), dbl(den)
    finite = (F.abs(n) < F.lit(float("inf"))) & (F.abs(d) < F.lit(float("inf"))) & ~F.isnan(n) & ~F.isnan(d)
    return F.when(finite & (F.abs(d) >= EPS), F.try_divide(n, d))


def ratio(num, den) -> Column:
    """num / den with NULL for a zero denominator (ANSI-safe)."""
    return F.try_divide(dbl(num), dbl(den))


def clip(c, lo, hi) -> Column:
    return F.least(F.greatest(dbl(c), F.lit(float(lo))), F.lit(float(hi)))


def corr_agg(x, y) -> Column:
    """Pearson correlation as an aggregate; NULL when either side is constant.

    Built from centred moments: the built-in ``corr`` raises on constant input
    in ANSI mode.
    """
    a, b = dbl(x), dbl(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return corr_from_moments(F.covar_pop(a, b), F.var_pop(a), F.var_pop(b))


def corr_from_moments(cov, vx, vy) -> Column:
    den = F.sqrt(vx) * F.sqrt(vy)
    return F.when(den > EPS, F.try_divide(cov, den))


def skew_kurt(x) -> tuple[Column, Column]:
    """Population skewness and excess kurtosis aggregates."""
    return F.skewness(dbl(x)), F.kurtosis(dbl(x))


def finite(c) -> Column:
    """NULL for NaN and infinities."""
    d = dbl(c)
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def psnr_from_mse(mse, data_range: float) -> Column:
    """20 log10(range) - 10 log10(mse); +inf for a perfect match."""
    m = dbl(mse)
    return F.when(m.isNull(), F.lit(None).cast("double")).when(m <= EPS, F.lit(float("inf"))).otherwise(
        F.lit(20.0) * F.log10(F.lit(float(data_range))) - F.lit(10.0) * F.log10(F.greatest(m, F.lit(EPS)))
    )


def flag_list(*pairs) -> Column:
    """Sorted, distinct, ';'-joined names of the conditions that hold."""
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs])
    return F.concat_ws(";", F.array_sort(F.array_distinct(F.array_compact(arr))))


def reflect(i, n) -> Column:
    """Index into [0, n) with the edge sample repeated (d c b a | a b c d | d c b a)."""
    return F.when(i < 0, -1 - i).when(i >= n, 2 * n - 1 - i).otherwise(i)


def let(value: Column, body) -> Column:
    """Bind a value once for use inside array lambdas.

    Columns referenced in a lambda are inlined and would be evaluated per element.
    """
    return F.transform(F.array(value), body)[0]


def array_sum(c) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
