"""Ranks over a whole table without a window over all of its rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Rows that are meant to be ranked in one task.
PART_ROWS = 100_000


def ranked(df: DataFrame, order: list[Column], name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds a number from 0 in the given order (ascending, without ties, NULLs first).

    Spark deals the rows out by ranges of the order, as for a sort; the parts are
    written with their number, so that it is the same for who counts them and who
    numbers rows inside them."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    parts = max(1, ceil(df.count() / part_rows))
    cut = df.withColumn("_key", key)
    if parts == 1:
        # all rows fit into one task
        return cut.withColumn(name, (F.row_number().over(Window.orderBy("_key")) - 1).cast("long")).drop("_key")
    cut = staged(cut.repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id()))
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a part
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = cut.withColumn("_inside", F.row_number().over(Window.partitionBy("_part").orderBy("_key")))
    return inside.join(before, "_part").withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_key", "_part", "_before", "_inside")


def weighted_median(df: DataFrame, v: str, w: str, parts: int = 1000) -> DataFrame:
    """(wmedian): first value at which the cumulative weight reaches half, over the whole table, with a sort of one part of the values only."""
    sums = df.where(F.col(v).isNotNull()).groupBy(F.col(v).alias("_v")).agg(F.sum(w).alias("_w"))
    cuts = sums.agg(F.percentile_approx("_v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10 * parts).alias("c")).first()["c"] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts))])
    dealt = sums.withColumn("_part", F.size(F.filter(bounds, lambda b: b < F.col("_v"))) if cuts else F.lit(0))
    rows = sorted((r["_part"], r["s"]) for r in dealt.groupBy("_part").agg(F.sum("_w").alias("s")).collect())
    total, before, at = sum(s or 0.0 for _, s in rows), 0.0, -1
    for at, s in rows:
        if before + (s or 0.0) >= total / 2:
            break
        before += s or 0.0
    upto = F.sum("_w").over(Window.partitionBy("_part").orderBy("_v"))
    found = dealt.where(F.col("_part") == at).withColumn("_cum", upto + F.lit(before))
    return found.agg(F.coalesce(F.min(F.when(F.col("_cum") >= total / 2, F.col("_v"))), F.max("_v")).alias("wmedian"))
