"""Joins of points to intervals, to the nearest in time, to grids, and to dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles


def points_in_intervals(points: DataFrame, intervals: DataFrame, on: str, t: str, start: str, end: str, bucket: int | None = None) -> DataFrame:
    """Every point with every interval of its entity that contains it, both ends included; intervals may overlap.

    With `bucket` (in units of t) both sides also meet on time buckets, so that
    one entity's work spreads over many tasks and only near intervals are compared."""
    inside = (F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))
    if bucket is None:
        return points.join(intervals, on).where(inside)
    of = lambda c: F.floor(F.col(c) / bucket).cast("long")
    dealt = intervals.withColumn("_bucket", F.explode(F.sequence(of(start), of(end))))
    return points.withColumn("_bucket", of(t)).join(dealt, [on, "_bucket"]).where(inside).drop("_bucket")


def nearest_in_time(left: DataFrame, right: DataFrame, on: str, left_t: str, right_t: str, within: int, key: list[str], order: str) -> DataFrame:
    """Left rows with the right row of the same entity nearest in time, at most `within` away (ties: smaller `order`).

    Both sides are dealt into buckets of that width; a right row goes into its
    own and both neighbours, so that no window is searched twice and days have
    no seams.  Left rows without a partner keep NULLs.  `key` names a left row."""
    dealt = right.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(right_t) / within).cast("long") + i for i in (-1, 0, 1)])))
    asked = left.withColumn("_bucket", F.floor(F.col(left_t) / within).cast("long"))
    others = [c for c in right.columns if c != on]
    joined = asked.join(dealt.withColumn("_on", F.col(on)).drop(on).withColumnRenamed("_bucket", "_b"), (F.col(on) == F.col("_on")) & (F.col("_bucket") == F.col("_b")) & (F.abs(F.col(left_t) - F.col(right_t)) <= within), "left")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.abs(F.col(left_t) - F.col(right_t)).asc_nulls_last(), F.col(order).asc_nulls_last()))
    return joined.withColumn("_r", rank).where("_r = 1").select(*left.columns, *others)


def grid_nearest(points: DataFrame, grid: DataFrame, lat: str, lon: str, step: float, on: list[str]) -> DataFrame:
    """Points with the nearest cell of a regular grid (columns lat_i, lon_i and `on`); longitudes modulo 360."""
    cells = int(round(360 / step))
    at = points.withColumn("lat_i", F.round(F.col(lat) / step).cast("long")).withColumn("lon_i", F.pmod(F.round(F.pmod(F.col(lon), F.lit(360.0)) / step).cast("long"), F.lit(cells)))
    return at.join(grid, ["lat_i", "lon_i", *on], "left")


def log_pressure(levels: Column, p: Column) -> Column:
    """Value at pressure p from array<struct<level, val>> sorted by level: linear in log(level), clipped to the range."""
    lower = F.try_element_at(F.filter(levels, lambda x: x["level"] <= p), F.lit(-1))
    upper = F.try_element_at(F.filter(levels, lambda x: x["level"] >= p), F.lit(1))
    weight = (F.log(p) - F.log(lower["level"])) / F.nullif(F.log(upper["level"]) - F.log(lower["level"]), F.lit(0.0))
    return F.coalesce(lower["val"] + (upper["val"] - lower["val"]) * weight, lower["val"], upper["val"])


def dimension(facts: DataFrame, dim: DataFrame, on: str, order: str, columns: list[str]) -> DataFrame:
    """Left join that takes the first row of a dimension's key; Spark broadcasts it where it is small."""
    first = dim.withColumn("_r", F.row_number().over(Window.partitionBy(on).orderBy(order))).where("_r = 1").select(on, *columns)
    return facts.join(first, on, "left")


def two_ended(facts: DataFrame, places: DataFrame, key: str, ends: dict[str, str], columns: list[str]) -> DataFrame:
    """The same dimension joined once for each end: ends = {prefix: fact column}."""
    for prefix, column in ends.items():
        named = places.select(F.col(key).alias(column), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
        facts = facts.join(named, column, "left")
    return facts


def with_fallback(left: DataFrame, right: DataFrame, on: list[str], fallback: list[str], value: str) -> DataFrame:
    """Left rows with the right side's value by the first keys, or, where these find none, by the second ones (its first row there)."""
    first = right.groupBy(*on).agg(F.min(value).alias("_first"))
    second = right.groupBy(*fallback).agg(F.min(value).alias("_second"))
    out = left.join(first, on, "left").join(second, fallback, "left")
    return out.withColumn(value, F.coalesce("_first", "_second")).drop("_first", "_second")


def only_new(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that adds the columns that left does not have; none is renamed."""
    have = {c.lower() for c in left.columns}
    return left.join(right.select(*on, *[c for c in right.columns if c.lower() not in have]), on, "left")


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of both, in the order of the first."""
    return [c for c in a.columns if c in b.columns]


def submission(template: DataFrame, predictions: DataFrame, key: str, value: str, name: str | None = None) -> DataFrame:
    """Template rows with their prediction; missing ones take the median, none is below 0."""
    got = template.drop(value).join(predictions.select(key, value), key, "left")
    median = F.lit(quantiles.exact(predictions, {value: [0.5]})[value][0]).cast("double")
    return got.withColumn(value, F.greatest(F.coalesce(F.col(value), median), F.lit(0.0))).withColumnRenamed(value, name or value)
