"""Filling missing features from groups, hierarchically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles, ranking


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fills each column with its exact median over the table (see `quantiles`)."""
    found = quantiles.exact(df, {c: [0.5] for c in columns})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, (m,) in found.items() if m is not None})


def bounds(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, least: int = 100) -> dict[str, tuple[float, float] | None]:
    """The exact outer percentiles of each column, None below `least` values or where they coincide."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    found = quantiles.exact(df, {c: [low, high] for c in columns if counts[c] >= least})
    return {c: tuple(found[c]) if c in found and found[c][0] < found[c][1] else None for c in columns}


def clipped(c: Column, b: tuple[float, float] | None) -> Column:
    """Inside bounds; no bounds change nothing, NULL stays NULL."""
    return c if b is None else F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(b[1])), F.lit(b[0])))


def weighted_mean(v: Column, w: Column) -> Column:
    w = F.when(v.isNotNull(), w)
    return F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0))


def weighted_median(df: DataFrame, keys: list[str], v: str, w: str) -> DataFrame:
    """First value at which the cumulative weight reaches half of the total; (keys, wmedian)."""
    some = df.where(F.col(v).isNotNull())
    order = Window.partitionBy(*keys).orderBy(v)
    reached = some.withColumn("_cum", F.sum(w).over(order)).withColumn("_all", F.sum(w).over(Window.partitionBy(*keys)))
    return reached.groupBy(*keys).agg(F.min(F.when(F.col("_cum") >= F.col("_all") / 2, F.col(v))).alias("wmedian"))


def hierarchical(df: DataFrame, c: str, weight: str, levels: list[list[str]], least: list[int], median: bool = False) -> DataFrame:
    """Fills NULLs of c from the finest group that has enough values, then from coarser ones, then from all.

    levels name the group keys from fine to coarse; least says how many values
    a group needs.  Values are clipped to the 1st and 99th percentile going in
    at the finest level and coming out.  Missing weights count as 1, at the
    finest level zero ones, too.  Groups with a NULL key serve nobody."""
    limits = bounds(df, [c])[c]
    out = df
    names = []
    for k, (keys, n) in enumerate(zip([*levels, []], [*least, 1], strict=True)):
        w = F.coalesce(F.nullif(F.col(weight), F.lit(0.0)) if k == 0 else F.col(weight), F.lit(1.0))
        v = clipped(F.col(c), limits) if k == 0 else F.col(c)
        base = out.select(*keys, v.alias("_v"), F.when(v.isNotNull(), w).alias("_w"))
        for key in keys:
            base = base.where(F.col(key).isNotNull())
        name = f"_f{k}"
        names.append(name)
        count = base.groupBy(*keys).agg(F.count("_v").alias("_n"), weighted_mean(F.col("_v"), F.col("_w")).alias(name))
        if median:
            held = (weighted_median(base, keys, "_v", "_w") if keys else ranking.weighted_median(base, "_v", "_w")).withColumnRenamed("wmedian", name)
            count = count.drop(name).join(held, keys) if keys else count.drop(name).crossJoin(F.broadcast(held))
        count = count.where(F.col("_n") >= n).drop("_n")
        out = out.join(count, keys, "left") if keys else out.join(F.broadcast(count), F.lit(True), "left")
    return out.withColumn(c, F.coalesce(F.col(c), clipped(F.coalesce(*names), limits))).drop(*names)


def group_median(df: DataFrame, c: str, keys: list[str]) -> DataFrame:
    """Fills NULLs with the group's median, then the table's; NULL is a key of its own."""
    return cascade(df, c, [keys])


def cascade(df: DataFrame, c: str, keys: list[list[str]]) -> DataFrame:
    """coalesce over medians by each list of keys, then the table's median."""
    out = df
    for n, k in enumerate(keys):
        found = quantiles.by_group(df, k, c, [0.5], [f"_m{n}"])
        found = found.select(*[F.col(x).alias(f"_k{n}_{x}") for x in k], f"_m{n}")
        out = out.join(found, [out[x].eqNullSafe(F.col(f"_k{n}_{x}")) for x in k], "left").drop(*[f"_k{n}_{x}" for x in k])
    filled = out.withColumn(c, F.coalesce(F.col(c), *[f"_m{n}" for n in range(len(keys))])).drop(*[f"_m{n}" for n in range(len(keys))])
    return medians(filled, [c])


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null, share): one pass over the table, most missing first is up to the caller."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    rows = counts.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("n_null")) for c in columns])).alias("r"))
    return rows.select("r.column", "r.n_null", (F.col("r.n_null") / F.nullif(F.col("_n"), F.lit(0))).alias("share"))


def sparse_columns(df: DataFrame, columns: list[str], most: float) -> list[str]:
    """Columns with a larger share of NULLs than `most` (one small row comes to the driver)."""
    return [r["column"] for r in profile(df, columns).where(F.col("share") > most).collect()]


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at most one distinct value: min equals max, found in one pass."""
    row = df.agg(*[F.coalesce(F.min(c).eqNullSafe(F.max(c)), F.lit(True)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def column_report(df: DataFrame, columns: list[str], most: float = 0.8) -> DataFrame:
    """(column, share, sparse, constant): share of NULLs, whether it is above `most`, and whether at most one value occurs; one pass over the table."""
    n = F.count(F.lit(1))
    each = [F.struct(F.lit(c).alias("column"), (F.sum(F.col(c).isNull().cast("long")) / F.nullif(n, F.lit(0))).alias("share"), F.coalesce(F.min(c).eqNullSafe(F.max(c)), F.lit(True)).alias("constant")) for c in columns]
    rows = df.agg(F.array(*each).alias("_r")).select(F.explode("_r").alias("r"))
    return rows.select("r.column", "r.share", (F.col("r.share") > most).alias("sparse"), "r.constant")


def feature_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, rmse, n): mean of each column and the root of the mean square from it, as imputed features are reported."""
    each = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("rmse"), F.count(c).alias("n")) for c in columns]
    return df.agg(F.array(*each).alias("_r")).select(F.explode("_r").alias("r")).select("r.*").where("n > 0")


def null_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in columns})
