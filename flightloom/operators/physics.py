"""Mass and fuel along a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Points that are folded at once.
CHUNK = 256


def with_burn(df: DataFrame, entity: str, order: str, flow: str, dt: str) -> DataFrame:
    """Adds burnt (kg): sum of the previous flow times the time to this point (left Riemann)."""
    w = Window.partitionBy(entity).orderBy(order)
    df = df.withColumn("_step", F.coalesce(F.lag(flow).over(w) * F.col(dt) / 3600, F.lit(0.0)))
    return df.withColumn("burnt", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def clamp_mass(tow: Column, burnt: Column) -> Column:
    return F.greatest(tow - burnt, 0.5 * tow)


def mass_recursion(df: DataFrame, entity: str, order: str, tow: str, flow_of_mass, state: list[str], dt: str) -> DataFrame:
    """Mass where the flow depends on it: m0 = tow, m[i+1] = max(m[i] - flow(m[i], point i) dt[i+1] / 3600, tow / 2).

    flow_of_mass(m, point) is a column expression in kg/h; a NULL flow leaves
    the mass as it is.  One entity's points are folded in order, JVM-side, in
    chunks, so that no point copies all points before it; a track's length bounds
    the array.  Returns entity, order, mass, flow."""
    points = df.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(dt), F.col(tow), *[F.col(c) for c in state]))).alias("_p"))
    first = F.try_element_at("_p", F.lit(1))[tow]
    empty = F.expr(f"cast(array() as array<struct<{order}:{dict(df.dtypes)[order]},mass:double,flow:double>>)")
    fresh = lambda m, f, begun: F.struct(m.alias("m"), f.alias("f"), begun.alias("begun"), empty.alias("out"))

    def step(s: Column, p: Column) -> Column:
        burn = F.coalesce(s["f"] * p[dt] / 3600, F.lit(0.0))
        m = F.when(s["begun"], F.greatest(s["m"] - burn, 0.5 * first)).otherwise(s["m"])
        f = flow_of_mass(m, p).cast("double")
        return F.struct(m.alias("m"), f.alias("f"), F.lit(True).alias("begun"), F.concat(s["out"], F.array(F.struct(p[order].alias(order), m.alias("mass"), f.alias("flow")))).alias("out"))

    def chunk(s: Column, at: Column) -> Column:
        done = F.aggregate(F.slice("_p", at, F.lit(CHUNK)), fresh(s["m"], s["f"], at > 1), step)
        return F.transform(F.array(done), lambda x: F.struct(x["m"].alias("m"), x["f"].alias("f"), F.concat(s["outs"], F.array(x["out"])).alias("outs")))[0]

    start = F.struct(first.cast("double").alias("m"), F.lit(None).cast("double").alias("f"), F.expr(f"cast(array() as array<array<struct<{order}:{dict(df.dtypes)[order]},mass:double,flow:double>>>)").alias("outs"))
    folded = points.select(entity, F.flatten(F.aggregate(F.sequence(F.lit(1), F.size("_p"), F.lit(CHUNK)), start, chunk, lambda s: s["outs"])).alias("_o"))
    return folded.select(entity, F.explode("_o").alias("_r")).select(entity, f"_r.{order}", "_r.mass", "_r.flow")


def trapezoid(df: DataFrame, keys: list[str], t_s: str, flow_kg_h: str, *then: str) -> DataFrame:
    """(keys, kg): time integral, at least 0; fewer than two points or any missing flow give 0.

    then: columns that order readings of one time."""
    w = Window.partitionBy(*keys).orderBy(t_s, *then)
    area = (F.col(flow_kg_h) + F.lag(flow_kg_h).over(w)) / 2 * (F.col(t_s) - F.lag(t_s).over(w)) / 3600
    total = df.withColumn("_a", area).groupBy(*keys).agg(F.sum("_a").alias("_s"), F.count(flow_kg_h).alias("_n"), F.count(F.lit(1)).alias("_all"))
    return total.select(*keys, F.when((F.col("_n") < F.col("_all")) | (F.col("_all") < 2), 0.0).otherwise(F.greatest(F.coalesce("_s", F.lit(0.0)), F.lit(0.0))).alias("kg"))


def valid_tow(tow: Column, oew: Column, mtow: Column) -> Column:
    return tow.isNotNull() & (oew.isNull() | (tow >= oew)) & (mtow.isNull() | (tow <= mtow))


def clip_tow(tow: Column, oew: Column, mtow: Column) -> Column:
    return F.when(oew.isNotNull() & mtow.isNotNull(), F.greatest(oew, F.least(mtow, tow))).otherwise(tow)


def corrected_flow(flow: Column, multiplier: Column) -> Column:
    """No multiplier: 1."""
    return flow * F.coalesce(multiplier, F.lit(1.0))
