"""Cross-validation folds, blends, corrections and error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import errors
from . import quantiles
from .ranking import ranked


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): groups dealt by size in turns (largest first, there and back), so that folds have like sizes."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    r = F.col("_r")
    turn, at = F.floor(r / k), r % k
    return ranked(sizes, [-F.col("_n"), F.col(group)], "_r").select(group, F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))


def time_folds(df: DataFrame, group: str, t: str, k: int) -> DataFrame:
    """(group, fold) by each group's first time; the last fold takes the remainder. Train on all smaller folds; fold 0 is never tested."""
    first = df.groupBy(group).agg(F.min(t).alias("_t"))
    size = max(1, first.count() // k)
    return ranked(first, [F.col("_t"), F.col(group)], "_r").select(group, F.least(F.floor(F.col("_r") / size), F.lit(k - 1)).cast("int").alias("fold"))


def shuffle_split(group: Column, share: float, seed: int = 42) -> Column:
    """True for about that share of the groups, by a hash of the group."""
    return F.pmod(F.xxhash64(F.lit(seed), group), F.lit(10_000)) < int(share * 10_000)


def _bin(df: DataFrame, c: str, q: int) -> Column:
    """How many of the exact inner quantiles of c over df a value is above."""
    edges = sorted({e for e in quantiles.exact(df, {c: [i / q for i in range(1, q)]})[c] if e is not None})
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: F.col(c) > e))


def quintile_bias(train: DataFrame, rows: DataFrame, predicted: str, actual: str, q: int = 5) -> DataFrame:
    """`rows` with the mean error of their prediction's quantile in `train` taken off (edges that coincide are one)."""
    bin_of = _bin(train, predicted, q)
    dealt = train.groupBy(bin_of.alias("_bin")).agg(F.avg(F.col(predicted) - F.col(actual)).alias("_bias"))
    out = rows.withColumn("_bin", bin_of).join(F.broadcast(dealt), "_bin", "left")
    return out.withColumn("corrected", F.col(predicted) - F.coalesce("_bias", F.lit(0.0))).drop("_bin", "_bias")


def ensemble(*models: Column) -> Column:
    return sum(models[1:], models[0]) / len(models)


def tail_blend(baseline: Column, other: Column, threshold: float) -> Column:
    """Large baselines count for four fifths, middling ones for half, small ones not at all."""
    return F.when(baseline > threshold, 0.8 * baseline + 0.2 * other).when(baseline > threshold / 2, 0.5 * baseline + 0.5 * other).otherwise(other)


def error_table(df: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    """Error metrics by group; the mean that R2 needs is the group's."""
    means = df.groupBy(*by).agg(F.avg(actual).alias("_mean"))
    same = [df[c].eqNullSafe(means[c]) for c in by]
    joined = df.join(means, same).select(df["*"], "_mean") if by else df.join(F.broadcast(means), F.lit(True))
    return joined.groupBy(*by).agg(*errors(F.col(actual), F.col(predicted), F.col("_mean")), F.count(F.lit(1)).alias("n"))


def error_statistics(df: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    """Mean, median, std and mean absolute error, shares over and under, and errors beyond a fifth of the actual value, by group."""
    e, a = F.col(predicted) - F.col(actual), F.col(actual)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    large = F.abs(e / F.nullif(a, F.lit(0.0))) > 0.2
    rest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("std_error"), F.avg(F.abs(e)).alias("mae"), share(e > 0).alias("over"), share(e < 0).alias("under"), share(large).alias("large"), F.avg(a).alias("mean_actual"), F.min(a).alias("min_actual"), F.max(a).alias("max_actual"))
    middle = quantiles.by_group(df.withColumn("_e", e), by, "_e", [0.5], ["median_error"])
    return rest.join(middle, [rest[c].eqNullSafe(middle[c]) for c in by]).select(rest["*"], "median_error")


def quantile_bin(df: DataFrame, c: str, name: str, q: int = 5) -> DataFrame:
    """Adds the number (from 0) of the quantile of c over the table, closed on the right; edges that coincide are one."""
    return df.withColumn(name, _bin(df, c, q))


def leakage(df: DataFrame, columns: list[str], target: str, limit: float = 0.95) -> DataFrame:
    """(column, corr, covar, same, flagged) of each numeric column with the target."""
    one = df.agg(*[F.struct(F.corr(c, target).alias("corr"), F.covar_samp(c, target).alias("covar"), F.coalesce(F.max(F.abs(F.col(c) - F.col(target))) <= 1e-8, F.lit(False)).alias("same")).alias(c) for c in columns])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])).alias("r"))
    return rows.select("r.column", "r.v.corr", "r.v.covar", "r.v.same", (F.coalesce(F.abs("r.v.corr") > limit, F.lit(False)) | F.col("r.v.same")).alias("flagged"))


def label_codes(df: DataFrame, c: str) -> DataFrame:
    """(value, code): codes from 0 in alphabetical order over all rows."""
    return ranked(df.where(F.col(c).isNotNull()).select(F.col(c).alias("value")).distinct(), [F.col("value")], "code").select("value", F.col("code").cast("int").alias("code"))


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that a hash of their key chooses, the same ones in every run and engine."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary")), key).limit(n)


def non_negative(c: Column, floor: float = 0.1) -> Column:
    return F.greatest(c, F.lit(floor))
