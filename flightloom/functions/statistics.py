"""Lists of aggregates over one signal, with the missing-value rules of the pipeline (NULLs are skipped)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile(c: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    return F.percentile(c, F.lit(q))


def summary(c: Column, name: str) -> list[Column]:
    """min, max, mean, median, sample std, p10, p90, interquartile range; all NULL over no values."""
    out = {"min": F.min(c), "max": F.max(c), "mean": F.avg(c), "median": quantile(c, 0.5), "std": F.stddev_samp(c), "p10": quantile(c, 0.1), "p90": quantile(c, 0.9), "iqr": quantile(c, 0.75) - quantile(c, 0.25)}
    return [v.alias(f"{name}_{k}") for k, v in out.items()]


def skew(c: Column) -> Column:
    """Bias-corrected skewness (NULL below 3 values)."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis (NULL below 4 values)."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def share(condition: Column) -> Column:
    """Share of rows that meet a condition; unknown counts as not met."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def only(condition: Column, c: Column) -> Column:
    return F.when(condition, c)


def variation(c: Column, guard: float = 1e-6) -> Column:
    """std over |mean|, NULL where the mean is next to 0."""
    m = F.abs(F.avg(c))
    return F.when(m > guard, F.stddev_samp(c) / m)


def first_by(c: Column, order: Column) -> Column:
    return F.min_by(c, order)


def last_by(c: Column, order: Column) -> Column:
    return F.max_by(c, order)


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope; 0 where x or y does not vary."""
    flat = (F.coalesce(F.stddev_pop(y), F.lit(0.0)) == 0) | (F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0)
    return F.when(flat, 0.0).otherwise(F.regr_slope(y, x))


def correlation(x: Column, y: Column) -> Column:
    """0 where either does not vary."""
    both = x.isNotNull() & y.isNotNull()
    flat = (F.coalesce(F.stddev_pop(only(both, x)), F.lit(0.0)) == 0) | (F.coalesce(F.stddev_pop(only(both, y)), F.lit(0.0)) == 0)
    return F.when(flat, 0.0).otherwise(F.corr(x, y))


def errors(actual: Column, predicted: Column, mean: Column) -> list[Column]:
    """RMSE, MAE, MAPE, bias, std of the error and R2 (`mean` is the mean of the actual values, one value)."""
    e = predicted - actual
    total = F.sum(F.pow(actual - mean, F.lit(2.0)))
    return [
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e) / F.when(actual != 0, F.abs(actual))) * 100).alias("mape"),
        F.avg(e).alias("bias"),
        F.stddev_samp(e).alias("error_std"),
        (1 - F.sum(e * e) / F.nullif(total, F.lit(0.0))).alias("r2"),
    ]
