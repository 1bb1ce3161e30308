"""Statistics as native expressions: Pearson r and its two-sided p-value.

No SciPy and no UDF.  For Pearson r with n pairs the t statistic has
df = n - 2 degrees of freedom and satisfies cos^2(theta) = 1 - r^2,
sin(theta) = |r| for theta = atan(t / sqrt(df)).  The Student-t
probability P(|T| <= t) then has the finite series of Abramowitz & Stegun
26.7.3 (odd df) and 26.7.4 (even df); the p-value is its complement.  The
series is summed with ``aggregate`` over ``sequence`` -- O(df) work per
*result row*, never per input row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pearson_r(x, y) -> Column:
    """Aggregate: Pearson r, NULL when either side is constant.

    ``corr`` is avoided on purpose: under ANSI mode it raises on a constant
    column even behind a guarding CASE.
    """
    x, y = _c(x), _c(y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _t_cdf(s: Column, c2: Column, dof: Column) -> Column:
    """P(|T| <= t) for integer ``dof`` >= 1, given sin(theta) and cos^2(theta).

    Both parities share one series 1 + a_1 c2 + ... + a_m c2^m with
    a_k = a_{k-1} * (2k-1)/(2k) (even dof, m = (dof-2)/2) or
    a_k = a_{k-1} * 2k/(2k+1) (odd dof, m = (dof-3)/2), summed by a single
    ``aggregate`` over k = 1..m.
    """
    odd = (dof % 2) == 1
    m = F.when(odd, F.floor((dof - 3) / 2)).otherwise(F.floor((dof - 2) / 2)).cast("int")
    ks = F.when(m >= 1, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))

    def step(acc, k):
        kd = k.cast("double")
        term = acc["t"] * F.when(odd, 2 * kd / (2 * kd + 1)).otherwise((2 * kd - 1) / (2 * kd)) * c2
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    series = F.aggregate(ks, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step)["s"]
    theta = F.asin(s)
    return (F.when(dof == 1, F.lit(2.0 / math.pi) * theta)
            .when(odd, F.lit(2.0 / math.pi) * (theta + s * F.sqrt(c2) * series))
            .otherwise(s * series))


def _p_value(r: Column, s: Column, c2: Column, dof: Column) -> Column:
    # least/greatest skip NULLs, so the NULL test must use the input r.
    return (F.when(r.isNull() | dof.isNull() | (dof < 1), F.lit(None).cast("double"))
            .when(s >= 1.0, F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - _t_cdf(s, c2, dof))))


def _sin_theta(r: Column) -> Column:
    return F.abs(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def pearson_p_value(r, n) -> Column:
    """Two-sided p-value of Pearson r over n pairs (NULL when r is NULL or n < 3)."""
    r = _c(r)
    s = _sin_theta(r)
    return _p_value(r, s, F.lit(1.0) - s * s, _c(n).cast("int") - 2)


def with_p_value(df: DataFrame, r: str, n: str, alias: str = "p") -> DataFrame:
    """``df`` plus the p-value column ``alias``.  Same value as
    ``pearson_p_value``; sin/cos^2/df are staged as columns first so the
    series' lambda captures plain columns (cheaper to analyse and evaluate)."""
    staged = df.select("*", _sin_theta(F.col(r)).alias("_p_s"), (F.col(n).cast("int") - 2).alias("_p_dof"))
    staged = staged.select("*", (F.lit(1.0) - F.col("_p_s") * F.col("_p_s")).alias("_p_c2"))
    p = _p_value(F.col(r), F.col("_p_s"), F.col("_p_c2"), F.col("_p_dof"))
    return staged.select(*[F.col(c) for c in df.columns], p.alias(alias))
