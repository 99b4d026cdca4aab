"""Composed feature tables: flights, intervals with neighbours, station reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins


def with_pseudo_intervals(intervals: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Adds an interval of the same length before the first and after the last of each entity that has more than one.

    Column kind is real, prev or next; lags and leads of the real ones then
    have neighbours at the edges, and the others are dropped afterwards."""
    w = Window.partitionBy(entity)
    marked = intervals.withColumns({"_lo": F.min(start).over(w), "_hi": F.max(end).over(w), "_n": F.count(F.lit(1)).over(w)})
    size = F.col(end) - F.col(start)
    before = marked.where((F.col(start) == F.col("_lo")) & (F.col("_n") > 1)).withColumns({"kind": F.lit("prev"), "_s": F.col(start) - size, "_e": F.col(start)})
    after = marked.where((F.col(end) == F.col("_hi")) & (F.col("_n") > 1)).withColumns({"kind": F.lit("next"), "_s": F.col(end), "_e": F.col(end) + size})
    names = [F.col("_s").alias(c) if c == start else F.col("_e").alias(c) if c == end else F.col(c) for c in intervals.columns]
    extra = [x.select(*names, "kind") for x in (before, after)]
    return intervals.withColumn("kind", F.lit("real")).unionByName(extra[0]).unionByName(extra[1])


def station_features(flights: DataFrame, reports: DataFrame, fields: list[str], key: str, within: int = 7200, first: str | None = None) -> DataFrame:
    """Fields of the reports nearest to departure and arrival, 0 where a station has none, and their differences.

    flights: key, origin, destination, departure, arrival; reports: station, valid, fields.
    first: a column of the reports; of those equally near the earlier one counts, of one time the one with its least value."""
    order = F.struct("valid", first) if first else F.col("valid")
    told = reports.select("station", "valid", *fields, order.alias("_order"))
    out = flights
    for side, place, t in (("origin", "origin", "departure"), ("destination", "destination", "arrival")):
        asked = flights.select(key, F.col(place).alias("station"), F.col(t).alias("_t"))
        near = joins.nearest_in_time(asked, told, "station", "_t", "valid", within, [key], "_order")
        out = out.join(near.select(key, *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"{side}_{c}") for c in fields]), key, "left")
    return out.withColumns({f"diff_{c}": F.col(f"destination_{c}") - F.col(f"origin_{c}") for c in fields})
