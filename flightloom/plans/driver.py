"""The whole feature table of intervals: flight, interval and segments together, couplings, and how an interval stands to its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins, trajectory
from . import profiles
from .features import with_pseudo_intervals

#: What an interval is compared by with the one before and after it.
LAGGED = ("tas_mean", "altitude_mean", "fuel", "headwind_mean", "mult_mean", "mass_mean", "vertical_rate_mean", "distance")
_SQUARED = ("altitude_mean", "tas_mean", "headwind_mean", "fuel", "vertical_rate_mean", "mass_mean", "density_mean")
_LOGGED = ("altitude_mean", "tas_mean", "fuel", "mass_mean", "density_mean")

#: Columns that follow from an interval's own, as expressions of the profile.
COUPLED = {
    "mult_tas": "mult_mean * tas_mean", "mult_o_headwind": "mult_o_mean * headwind_mean", "mult_rate": "mult_mean * vertical_rate_mean",
    "mult_diff": "mult_mean - mult_o_mean", "mult_ratio": "CASE WHEN mult_o_mean > 0 THEN mult_mean / mult_o_mean END",
    "mult_gt_1_1": "CASE WHEN mult_mean > 1.1D THEN 1.0D ELSE 0.0D END", "mult_gt_1_2": "CASE WHEN mult_mean > 1.2D THEN 1.0D ELSE 0.0D END", "mult_lt_0_9": "CASE WHEN mult_mean < 0.9D THEN 1.0D ELSE 0.0D END",
    **{f"{c}_sq": f"{c} * {c}" for c in _SQUARED}, **{f"{c}_log": f"CASE WHEN {c} > 0 THEN ln({c}) END" for c in _LOGGED},
    "alt_tas": "altitude_mean * tas_mean", "headwind_fuel": "CASE WHEN fuel <> 0 THEN headwind_mean * fuel END", "rate_mass": "CASE WHEN mass_mean <> 0 THEN vertical_rate_mean * mass_mean END",
}


def beside(columns: tuple[str, ...], flight: str, start: str) -> dict[str, Column]:
    """Value of the interval before and after, difference and ratio (0 over 0 is 1), over rows that hold the made-up intervals, too."""
    w = Window.partitionBy(flight).orderBy(start)
    out = {}
    for c in columns:
        v, before, after = F.col(c), F.lag(c).over(w), F.lead(c).over(w)
        ratio = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.when((a == 0) & (b == 0), 1.0).otherwise(a / (b + 1e-6)))
        out |= {f"{c}_prev": before, f"{c}_prev_diff": v - before, f"{c}_prev_ratio": ratio(v, before), f"{c}_next": after, f"{c}_next_diff": after - v, f"{c}_next_ratio": ratio(after, v)}
    return out


def around(columns: tuple[str, ...], flight: str, order: str) -> dict[str, Column]:
    """Mean and spread over three real intervals, and the distance from the mean; fuel so far and the whole flight's turns."""
    w = Window.partitionBy(flight).orderBy(order)
    three = w.rowsBetween(-1, 1)
    out = {}
    for c in columns:
        out |= {f"{c}_mean_3": F.avg(c).over(three), f"{c}_std_3": F.stddev_samp(c).over(three), f"{c}_dev_3": F.col(c) - F.avg(c).over(three)}
    sofar = F.when(F.col("fuel").isNotNull(), F.sum("fuel").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out | {"fuel_so_far": sofar, "flight_turned": F.sum("turned").over(Window.partitionBy(flight))}


def interval_table(readings: DataFrame, intervals: DataFrame, flight: str = "flight_id", idx: str = "idx", start: str = "i_start", end: str = "i_end", t: str = "t", bucket: int | None = None, segments: int = 20, segment_columns: tuple[str, ...] = ("groundspeed_mean", "altitude_mean", "vertical_rate_mean", "flow_mean")) -> DataFrame:
    """One row an interval: its profile, `flight_*` of its flight, `segNN_*` of its equal parts and what lies between them (`between_*`), couplings, neighbours.

    The first and the last interval of a flight are compared with made-up ones of
    their length beside them, where the flight has more than one.  Intervals without
    readings stay, with NULLs.  readings have the columns that `profiles` names;
    numbers of intervals are unique."""
    every = with_pseudo_intervals(intervals.select(flight, idx, start, end), flight, start, end).withColumnRenamed("kind", "side")
    readings = readings.drop("side")
    inside = joins.points_in_intervals(readings, every, flight, t, start, end, bucket)
    own = profiles.aggregated(profiles.with_motion(inside, [idx, "side"]), [idx, "side"], {k: f"CAST({v} AS DOUBLE)" for k, v in profiles.INTERVAL.items()})
    rows = every.join(own, [idx, "side"], "left")
    rows = rows.withColumns(beside(LAGGED, flight, start)).where("side = 'real'").drop("side")
    rows = rows.withColumns(around(LAGGED, flight, start)).withColumns({k: F.expr(v) for k, v in COUPLED.items()})
    whole = profiles.aggregated(profiles.with_motion(readings, [flight]), [flight], {k: f"CAST({v} AS DOUBLE)" for k, v in profiles.FLIGHT.items()})
    out = rows.join(whole.select(flight, *[F.col(k).alias(f"flight_{k}") for k in profiles.FLIGHT]), flight, "left")
    if segments:
        cut = trajectory.segments(intervals.select(flight, idx, start, end), start, end, segments)
        parts = joins.points_in_intervals(readings, cut, flight, t, "seg_start", "seg_end", bucket)
        long = profiles.segment_profile(profiles.with_motion(parts, [idx, "seg"]), [idx, "seg"])
        wide = trajectory.pivot_segments(long, [idx], list(segment_columns), segments)
        between = profiles.between_segments(long, idx)
        out = out.join(wide, idx, "left").join(between.select(idx, *[F.col(k).cast("double").alias(f"between_{k}") for k in profiles.BETWEEN]), idx, "left")
    return out
