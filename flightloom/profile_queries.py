"""Queries of the full profiles.  The SQL has the same aggregates, translated where the engines' names differ."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import phases as P
from .operators import joins, series, trajectory
from .plans import profiles as R
from .plans.tables import INTERVALS, TRACKS, intervals, tracks
from .queries import _rounded, d, query

#: Further readings, as expressions of both engines.
MORE = {
    "mass": "60000 - CAST(pid % 1009 AS DOUBLE)", "mass_o": "60500 - CAST(pid % 997 AS DOUBLE)", "thrust": "40000 + groundspeed * 20", "drag": "35000 + groundspeed * 18", "flow_o": "CASE WHEN pid % 19 = 0 THEN NULL ELSE 450 + groundspeed * 3.5D END",
    "mult": "0.8D + CAST(pid % 41 AS DOUBLE) / 100", "mult_o": "0.9D + CAST(pid % 23 AS DOUBLE) / 100", "press": "200 + CAST(pid % 800 AS DOUBLE)", "rebuilt": "pid % 11 = 0",
}

#: Seconds of a bucket in which points and intervals meet.
BUCKET = 86_400


def duck(s: str) -> str:
    """An expression as DuckDB writes it."""
    s = re.sub(r"percentile\((.+?), array\(([^)]*)\)\)\[(\d)\]", lambda m: f"quantile_cont({m[1]}, {m[2].split(', ')[int(m[3])]})", s)
    s = re.sub(r"(\d+(?:\.\d+)?)D\b", r"\1::DOUBLE", s).replace("percentile(", "quantile_cont(").replace("min_by(", "arg_min_null(").replace("max_by(", "arg_max_null(").replace("power(", "pow(")
    return s


def columns(aggregates: dict[str, str]) -> str:
    return ", ".join(d(duck(v), f'"{k}"') for k, v in aggregates.items())


_READ = f"more AS (SELECT *, {', '.join(f'{duck(v)} AS {k}' for k, v in MORE.items())} FROM tracks)"


def _motion_sql(source: str, key: str) -> str:
    """CTEs ph, mo and pr: readings of `source` with the columns of profiles.with_motion."""
    return f"""ph AS (SELECT *, {R.PHASE} AS phase FROM {source}),
    mo AS (SELECT *, t - lag(t) OVER w AS dt, (TAS - lag(TAS) OVER w) / nullif((t - lag(t) OVER w)::DOUBLE, 0) AS tas_acc, ((track - lag(track) OVER w + 180) % 360 + 360) % 360 - 180 AS turn, lag(phase) OVER w AS phase_before,
        (groundspeed - lag(groundspeed) OVER s) / nullif((t - lag(t) OVER s)::DOUBLE, 0) AS phase_acc FROM ph WINDOW w AS (PARTITION BY {key} ORDER BY us), s AS (PARTITION BY {key}, phase ORDER BY us)),
    pr AS (SELECT *, coalesce(sum(groundspeed * dt / 3600) OVER (PARTITION BY {key} ORDER BY us), 0) AS dist FROM mo)"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).withColumns({k: F.expr(v) for k, v in MORE.items()})


@query(f"""WITH {INTERVALS}, {_READ}, p AS (SELECT i.idx, m.* FROM more m JOIN intervals i ON m.flight_id = i.flight_id AND m.t BETWEEN i.i_start AND i.i_end), {_motion_sql("p", "idx")}
    SELECT i.idx, a.* EXCLUDE (idx) FROM intervals i LEFT JOIN (SELECT idx, {columns(R.INTERVAL)} FROM pr GROUP BY idx) a USING (idx)""")
def interval_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of an interval's readings; intervals without readings stay."""
    each = intervals(spark, sf_dir)
    inside = joins.points_in_intervals(_readings(spark, sf_dir), each, "flight_id", "t", "i_start", "i_end", bucket=BUCKET)
    found = R.aggregated(R.with_motion(inside, ["idx"]), ["idx"], {k: f"CAST({v} AS DOUBLE)" for k, v in R.INTERVAL.items()})
    return each.select("idx").join(_rounded(found, ["idx"]), "idx", "left")


@query(f"""WITH {TRACKS}, {_READ}, {_motion_sql("more", "flight_id")} SELECT flight_id, {columns(R.FLIGHT)} FROM pr GROUP BY flight_id""")
def flight_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.aggregated(R.with_motion(_readings(spark, sf_dir), ["flight_id"]), ["flight_id"], {k: f"CAST({v} AS DOUBLE)" for k, v in R.FLIGHT.items()})
    return _rounded(found, ["flight_id"])


@query(f"""WITH {TRACKS}, {_READ}, {_motion_sql("more", "flight_id")} SELECT flight_id, {columns(R.WHOLE)} FROM pr GROUP BY flight_id""")
def takeoff_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole track's values from which the take-off weight is learnt."""
    found = R.aggregated(R.with_motion(_readings(spark, sf_dir), ["flight_id"]), ["flight_id"], {k: f"CAST({v} AS DOUBLE)" for k, v in R.WHOLE.items()})
    return _rounded(found, ["flight_id"])


_OVERLAY = "CASE WHEN z <= 120 OR altitude < 1500 AND vertical_rate < -300 THEN 'landing' WHEN s <= 120 OR altitude < 1500 AND vertical_rate > 500 THEN 'takeoff' WHEN vertical_rate < -300 THEN 'descent' WHEN vertical_rate > 300 THEN 'climb' ELSE 'cruise' END"


@query(f"""WITH {TRACKS}, e AS (SELECT *, t - min(t) OVER (PARTITION BY flight_id) AS s, max(t) OVER (PARTITION BY flight_id) - t AS z FROM tracks), o AS (SELECT *, {_OVERLAY} AS overlay FROM e),
    x AS (SELECT *, t - lag(t) OVER w AS over_dt, (groundspeed - lag(groundspeed) OVER w) / nullif((t - lag(t) OVER w)::DOUBLE, 0) AS over_acc FROM o WINDOW w AS (PARTITION BY flight_id, overlay ORDER BY us)) SELECT flight_id, {columns(R.FIVE_PHASES)} FROM x GROUP BY flight_id""")
def five_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Window.partitionBy("flight_id")
    overlay = P.overlay_phase(F.col("vertical_rate"), F.col("altitude"), F.col("t") - F.min("t").over(whole), F.max("t").over(whole) - F.col("t"))
    found = R.aggregated(R.with_overlay(tracks(spark, sf_dir), "flight_id", overlay), ["flight_id"], {k: f"CAST({v} AS DOUBLE)" for k, v in R.FIVE_PHASES.items()})
    return _rounded(found, ["flight_id"])


_SEGMENTS = f"""{INTERVALS}, {_READ}, sg AS (SELECT idx, flight_id, s AS seg, i_start + s * ((i_end - i_start) / 5.0::DOUBLE) AS a, i_start + (s + 1) * ((i_end - i_start) / 5.0::DOUBLE) AS b FROM intervals, range(5) g(s)),
    p AS (SELECT g.idx, g.seg, m.* FROM sg g JOIN more m ON g.flight_id = m.flight_id AND m.t >= g.a AND m.t <= g.b), {_motion_sql("p", "idx, seg")},
    sp AS (SELECT *, avg(vertical_rate) OVER w AS vertical_rate_m, stddev_samp(vertical_rate) OVER w AS vertical_rate_s, avg(TAS) OVER w AS TAS_m, stddev_samp(TAS) OVER w AS TAS_s FROM pr WINDOW w AS (PARTITION BY idx, seg)),
    se AS (SELECT idx, seg, {", ".join(f'{duck(v)} AS "{k}"' for k, v in R.SEGMENT.items())} FROM sp GROUP BY idx, seg HAVING count(*) >= 2)"""


def _segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = trajectory.segments(intervals(spark, sf_dir), "i_start", "i_end", n=5)
    inside = joins.points_in_intervals(_readings(spark, sf_dir), cut, "flight_id", "t", "seg_start", "seg_end", bucket=BUCKET)
    return R.segment_profile(R.with_motion(inside, ["idx", "seg"]), ["idx", "seg"])


@query(f"""WITH {_SEGMENTS} SELECT idx, seg, {", ".join(d(f'"{k}"', f'"{k}"') for k in R.SEGMENT)} FROM se""")
def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth of an interval with two readings at least (readings of these tables lie hours apart)."""
    found = _segment_profile(spark, sf_dir)
    return _rounded(found.select("idx", "seg", *[F.col(k).cast("double").alias(k) for k in R.SEGMENT]), ["idx", "seg"])


@query(f"""WITH {_SEGMENTS}, de AS (SELECT *, CASE WHEN lead(seg) OVER w = seg + 1 THEN lead(groundspeed_mean) OVER w - groundspeed_mean END AS d_gs, CASE WHEN lead(seg) OVER w = seg + 1 THEN lead(altitude_mean) OVER w - altitude_mean END AS d_alt,
    CASE WHEN flow_mean IS NOT NULL THEN count(flow_mean) OVER w END AS flow_i, count(flow_mean) OVER (PARTITION BY idx) AS flow_n, CASE WHEN altitude_mean IS NOT NULL THEN count(altitude_mean) OVER w END AS alt_i, max(altitude_mean) OVER (PARTITION BY idx) AS alt_top, min(altitude_mean) OVER (PARTITION BY idx) AS alt_low
    FROM se WINDOW w AS (PARTITION BY idx ORDER BY seg)) SELECT idx, {columns(R.BETWEEN)} FROM de GROUP BY idx""")
def between_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.between_segments(_segment_profile(spark, sf_dir), "idx")
    return _rounded(found.select("idx", *[F.col(k).cast("double").alias(k) for k in R.BETWEEN]), ["idx"])


@query(f"""WITH {_SEGMENTS} SELECT idx, {", ".join(d(f"max(CASE WHEN seg = {s} THEN {c} END)", f"seg{s:02d}_{n}") for s in range(5) for n, c in (("thrust_power", "thrust_mean * groundspeed_mean"), ("drag_power", "drag_mean * groundspeed_mean"), ("vertical_rate_mean", "vertical_rate_mean"), ("fpa", "fpa")))} FROM se GROUP BY idx""")
def wide_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _segment_profile(spark, sf_dir).withColumns({f"{k}_power": F.col(f"{k}_mean") * F.col("groundspeed_mean") for k in ("thrust", "drag")})
    return _rounded(trajectory.pivot_segments(long, ["idx"], ["thrust_power", "drag_power", "vertical_rate_mean", "fpa"], n=5), ["idx"])


@query(f"""WITH {TRACKS}, s AS (SELECT *, abs((groundspeed - lag(groundspeed) OVER w) / nullif((t - lag(t) OVER w)::DOUBLE, 0)) AS r, abs((lead(groundspeed) OVER w - groundspeed) / nullif((lead(t) OVER w - t)::DOUBLE, 0)) AS n FROM tracks WINDOW w AS (PARTITION BY flight_id ORDER BY us))
    SELECT flight_id, pid, {d("CASE WHEN coalesce(r > 0.01 AND n > 0.01 OR abs(n - r) > 0.05, false) THEN NULL ELSE groundspeed END", "groundspeed")} FROM s""")
def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = trajectory.derivative_filter(F.col("groundspeed"), F.col("t"), series.by("flight_id", "us"), 0.01, 0.05)
    return _rounded(tracks(spark, sf_dir).select("flight_id", "pid", kept.alias("groundspeed")), ["flight_id", "pid"])
