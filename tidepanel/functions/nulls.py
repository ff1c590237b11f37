"""The missing-value contract: missing is NULL, infinity is a value, NaN never stays in a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def column(x) -> Column:
    """A column from a name, a number or a column."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def finite(x: Column) -> Column:
    """Infinities become missing, as rolling inputs require."""
    return F.when(F.abs(x) != F.lit(INF), x)


def ieee_div(a, b) -> Column:
    """Division by the IEEE rules: x/0 is signed infinity and 0/0 missing."""
    a, b = column(a).cast("double"), column(b).cast("double")
    return no_nan(F.when(b == 0, a * F.lit(INF)).otherwise(a / b))


def ieee_log(x) -> Column:
    """Natural logarithm with log(0) = -infinity; missing below zero."""
    x = column(x).cast("double")
    return F.when(x == 0, F.lit(-INF)).when(x > 0, F.ln(x))


def paired(a: Column, b: Column) -> tuple[Column, Column]:
    """Both sides, missing unless both are present."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def safe_corr(a: Column, b: Column, over=None) -> Column:
    """Pearson correlation of the rows with both sides; missing when one side is constant."""
    a, b = paired(a, b)
    cov, sa, sb = F.covar_samp(a, b), F.stddev_samp(a), F.stddev_samp(b)
    if over is not None:
        cov, sa, sb = cov.over(over), sa.over(over), sb.over(over)
    return cov / F.nullif(sa * sb, F.lit(0.0))


def unbiased_skew(skew: Column, n: Column, deviation: Column) -> Column:
    """Sample-corrected skewness from the population one; 0 on constant values, missing under 3."""
    fixed = skew * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return F.when(n >= 3, F.when(deviation == 0, F.lit(0.0)).otherwise(fixed))


def unbiased_kurtosis(kurtosis: Column, n: Column, deviation: Column, flat: float) -> Column:
    """Sample-corrected excess kurtosis from the population excess; ``flat`` on constant values, missing under 4."""
    fixed = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * kurtosis + 6)
    return F.when(n >= 4, F.when(deviation == 0, F.lit(flat)).otherwise(fixed))
