"""Rebuilding tracks: cleaning, gap synthesis, smoothing, segments."""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.atmosphere import FOOT, KNOT, clamp, isa_pressure, isa_temperature, mach_to_tas
from ..functions.geo import haversine, interpolate_angle, interpolate_position
from ..functions.geodesy import along, inverse
from ..functions.phases import CLAMPS, flight_phase, gap_phase
from .series import by
from .tracks import Steps, floats, replaced, whole


# Slowest and fastest climb of a synthesised stretch, 2 and 12 m/s in ft/min.
RATES = (393.7, 2362.2)


def derivative_filter(c: Column, t: Column, w: Window, first: float, second: float) -> Column:
    """NULL where the rate of change, or its change, from the reading before is beyond the limits (public libraries differ in detail)."""
    rate = F.abs((c - F.lag(c).over(w)) / F.nullif((t - F.lag(t).over(w)).cast("double"), F.lit(0.0)))
    ahead = F.abs((F.lead(c).over(w) - c) / F.nullif((F.lead(t).over(w) - t).cast("double"), F.lit(0.0)))
    spike = (rate > first) & (ahead > first) | (F.abs(ahead - rate) > second)
    return F.when(F.coalesce(spike, F.lit(False)), F.lit(None)).otherwise(c)


def median_filter(df: DataFrame, entity: str, order: str, columns: list[str], rows: int = 11) -> DataFrame:
    """Centred rolling median over `rows` rows, through a window of collected neighbours."""
    w = by(entity, order).rowsBetween(-(rows // 2), rows // 2)

    def median(a: Column) -> Column:
        s, n = F.array_sort(a), F.size(a)
        return F.when(n > 0, (s[F.floor((n - 1) / 2).cast("int")] + s[F.floor(n / 2).cast("int")]) / 2)

    held = df.withColumns({f"_w_{c}": F.collect_list(c).over(w) for c in columns})
    return held.withColumns({c: F.when(F.col(c).isNotNull(), median(F.col(f"_w_{c}"))) for c in columns}).drop(*[f"_w_{c}" for c in columns])


def sigma_filter(df: DataFrame, entity: str, order: str, columns: list[str], rows: int = 17, sigmas: float = 3.0, spread: int | None = None) -> DataFrame:
    """NULL where a reading is further from the rolling median over `rows` rows than so many stds of that difference over `spread` rows (as many by default)."""
    around = (spread or rows) // 2
    w = by(entity, order).rowsBetween(-around, around)
    soft = median_filter(df.withColumns({f"_m_{c}": F.col(c) for c in columns}), entity, order, [f"_m_{c}" for c in columns], rows)
    off = {f"_d_{c}": F.abs(F.col(c) - F.col(f"_m_{c}")) for c in columns}
    out = soft.withColumns(off)
    out = out.withColumns({f"_s_{c}": F.stddev_pop(f"_d_{c}").over(w) for c in columns})
    return out.withColumns({c: F.when(F.col(f"_d_{c}") <= sigmas * F.greatest(F.col(f"_s_{c}"), F.lit(1e-9)), F.col(c)) for c in columns}).drop(*[f"_{k}_{c}" for k in "mds" for c in columns])


def ends_of_gaps(df: DataFrame, entity: str, t_s: str, columns: list[str], least: float = 30, most: float = 28800, *then: str) -> DataFrame:
    """One row a hole with both ends' readings (a_*, b_*), its length, and its place in the flight; `then` orders readings of one time."""
    w = by(entity, t_s, *then)
    whole = Window.partitionBy(entity)
    sides = df.select(entity, F.lag(t_s).over(w).alias("t0"), F.col(t_s).alias("t1"), *[F.lag(c).over(w).alias(f"a_{c}") for c in columns], *[F.col(c).alias(f"b_{c}") for c in columns], F.min(t_s).over(whole).alias("_s"), F.max(t_s).over(whole).alias("_e"))
    holes = sides.where((F.col("t1") - F.col("t0") > least) & (F.col("t1") - F.col("t0") <= most))
    return holes.withColumn("place", (F.col("t0") - F.col("_s")) / F.nullif((F.col("_e") - F.col("_s")).cast("double"), F.lit(0.0))).drop("_s", "_e")


def synthesize(gaps: DataFrame, entity: str, t_s: str, step: int = 1, ellipsoid: bool = False, learnt: tuple[str, DataFrame] | None = None) -> DataFrame:
    """A row for each `step` seconds inside a hole: position on the great circle (or the geodesic of the ellipsoid), linear altitude, turned track, and speeds by phase.

    Cruise holds the mean Mach number of the ends and no vertical rate, its rows
    lie between the ends; climb and descent hold the mean calibrated speed and a
    steady rate of 2 to 12 m/s, their rows begin and end at the ends. Needs
    latitude, longitude, altitude, track, mach, CAS, groundspeed at both ends;
    where there is TAS, too, the air speed runs over from and to it.  learnt: a
    column of the holes and a table from `learn_speeds`, whose speeds and rates of
    that column's value and phase stand before those of the ends."""
    ends = [F.col(c) for c in ("a_latitude", "a_longitude", "b_latitude", "b_longitude")]
    known = gaps.withColumn("phase", gap_phase(F.col("a_altitude"), F.col("b_altitude"), F.col("place")))
    known = known.withColumn("_d", inverse(*ends)) if ellipsoid else known.withColumn("_d", haversine(*ends, 1.0))
    if learnt:
        kind, speeds = learnt
        known = known.join(F.broadcast(speeds.select(kind, "phase", "learnt_mach", "learnt_CAS", "learnt_rate")), [kind, "phase"], "left")
    rows = known.where(F.col("t1") - F.col("t0") > step).withColumn(t_s, F.explode(F.sequence(F.col("t0") + step, F.col("t1") - step, F.lit(step).cast("long"))))
    level = F.col("phase") == "cruise"
    i, n = (F.col(t_s) - F.col("t0"), F.col("t1") - F.col("t0") - 1) if step == 1 else (F.floor((F.col(t_s) - F.col("t0")) / step), F.floor((F.col("t1") - F.col("t0") - 1) / step))
    f = F.when(level, i / (n + 1)).otherwise((i - 1) / F.greatest(n - 1, F.lit(1)))
    if ellipsoid:
        near = (F.abs(ends[0] - ends[2]) < 1e-4) & (F.abs(ends[1] - ends[3]) < 1e-4) | F.col("_d").isNull()
        at = along(ends[0], ends[1], F.col("_d.start"), F.col("_d.distance") * f)
        rows = rows.withColumn("_at", F.when(~near, F.struct(at["latitude"].alias("latitude"), at["longitude"].alias("longitude"))))
        lat, lon = F.coalesce("_at.latitude", ends[0]), F.coalesce("_at.longitude", ends[1])
    else:
        lat, lon = interpolate_position(*ends, f, F.col("_d"))
    altitude = F.col("a_altitude") + (F.col("b_altitude") - F.col("a_altitude")) * f
    h = altitude * FOOT
    mean = lambda c: (F.coalesce(f"a_{c}", f"b_{c}") + F.coalesce(f"b_{c}", f"a_{c}")) / 2
    before = lambda name, c: F.coalesce(F.col(f"learnt_{name}"), c) if learnt else c
    cruise = mach_to_tas(before("mach", mean("mach")), isa_temperature(h)) / KNOT
    other = before("CAS", mean("CAS")) / F.sqrt(F.greatest(isa_pressure(h) / 101325.0, F.lit(0.1)))
    steady = before("rate", (F.col("b_altitude") - F.col("a_altitude")) / (F.col("t1") - F.col("t0")) * 60)
    climbing = F.col("phase") == "climb"
    steady = F.when(climbing, clamp(steady, *RATES)).otherwise(clamp(steady, -RATES[1], -RATES[0]))
    speed = F.when(level, cruise).otherwise(other)
    tas = F.coalesce(blend(speed, F.col("a_TAS"), F.col("b_TAS"), i, n), speed) if "a_TAS" in gaps.columns else speed
    return rows.select(
        entity, t_s, "phase", lat.alias("latitude"), lon.alias("longitude"), altitude.alias("altitude"),
        interpolate_angle(F.col("a_track"), F.col("b_track"), f).alias("track"), F.when(level, 0.0).otherwise(steady).alias("vertical_rate"),
        tas.alias("TAS"), (F.col("a_groundspeed") + (F.col("b_groundspeed") - F.col("a_groundspeed")) * f).alias("groundspeed"), F.lit(True).alias("is_reconstructed"),
    )


def learn_speeds(df: DataFrame, kind: str, least: int = 1) -> DataFrame:
    """(kind, phase, learnt_mach, learnt_CAS, learnt_rate, n): mean speeds and rates of each type in cruise, climb and descent, from its readings."""
    phased = df.where(F.col(kind).isNotNull()).withColumn("phase", flight_phase(F.col("vertical_rate"), F.col("altitude"))).where("phase <> 'ground'")
    found = phased.groupBy(kind, "phase").agg(F.avg(clamp(F.col("mach"), *CLAMPS["mach"])).alias("learnt_mach"), F.avg(clamp(F.col("CAS"), *CLAMPS["CAS"])).alias("learnt_CAS"), F.avg("vertical_rate").alias("learnt_rate"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= least)


def blend(c: Column, start: Column, end: Column, i: Column, n: Column, points: int = 5) -> Column:
    """Runs a synthesised value over from its ends: linear over `points` rows each side, left alone in short holes (i from 1 to n).

    The first row is the value before the hole; the last one is a step short of the value after it."""
    head, tail = (i - 1) / points, (i - 1 - (n - points)) / points
    return F.when(n < 2 * points, c).when(i <= points, start * (1 - head) + c * head).when(i > n - points, c * (1 - tail) + end * tail).otherwise(c)


def gaussian(v: np.ndarray, known: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, sigma: float, rows: int = 10, angle: bool = False) -> np.ndarray:
    """Gaussian means at the places `at` of tracks that go from `first` to `last`, weights of missing rows dropped; angles are averaged as turns from the row's own."""
    turned = lambda d: np.where((r := np.fmod(d, 360.0)) < 0, np.fmod(r + 360.0, 360.0), r)
    total, weight = np.zeros(len(at)), np.zeros(len(at))
    for k in range(-rows, rows + 1):
        near = np.clip(at - k, first, last)
        there = (near == at - k) & known[near]
        x = turned(v[near] - v[at] + 180) - 180 if angle else v[near]
        g = exp(-0.5 * (k / sigma) ** 2)
        total, weight = total + np.where(there, x * g, 0.0), weight + np.where(there, g, 0.0)
    return turned(v[at] + total / weight) if angle else total / weight


def smooth_at_gaps(df: DataFrame, entity: str, t_s: str, sigmas: dict[str, float], window: int = 10, least: float = 2) -> DataFrame:
    """Gaussian means within `window` rows of holes that are still longer than `least` seconds; elsewhere readings stay.

    Only rows near a hole are computed; a task goes through many tracks at once."""

    def run(rows: pa.Table, start: np.ndarray) -> pa.Table:
        t, end = floats(rows, t_s), np.append(start[1:], len(rows)) - 1
        length = end - start + 1
        first, last = np.repeat(start, length), np.repeat(end, length)
        hole = np.append(False, np.diff(t) > least)
        hole[start] = False
        # holes up to each row
        n = np.append(0, np.cumsum(hole))
        here = np.arange(len(rows))
        near = n[np.minimum(here + window, last) + 1] > n[np.maximum(here - window + 1, first)]
        for c, sigma in sigmas.items():
            column = rows[c]
            known = column.is_valid().to_numpy()
            v = floats(rows, c).copy()
            at = np.flatnonzero(near & known)
            v[at] = gaussian(v, known, at, first[at], last[at], sigma, window, angle=c == "track")
            rows = rows.set_column(rows.schema.get_field_index(c), rows.schema.field(c), pa.array(v, mask=~known).cast(column.type, safe=False))
        return rows

    return whole(df, entity, t_s, run, df.schema)


def kalman(df: DataFrame, entity: str, t_s: str, columns: list[str], noise: float = 1.0, reading: float = 25.0, reject: float = 3.0) -> DataFrame:
    """Constant-velocity Kalman smoother (forward filter, backward pass) for each column; readings beyond `reject` sigmas are skipped.

    A truly sequential computation along a track; a task goes through many tracks side by side."""

    def smooth(z: np.ndarray, t: np.ndarray, start: np.ndarray) -> np.ndarray:
        n = np.add.reduceat((~np.isnan(z)).astype(int), start)
        steps = Steps(start, len(z))
        kept, z, t = z, z[steps.order], t[steps.order]
        # the covariance of a track is (a, b; b, c)
        x, v = np.zeros(len(start)), np.zeros(len(start))
        a, b, c = np.full(len(start), reading), np.zeros(len(start)), np.full(len(start), 100.0)
        for i in range(steps.n - 1, -1, -1):
            first = z[steps[i]]
            x[: len(first)] = np.where(np.isnan(first), x[: len(first)], first)
        ahead, now = np.zeros((5, len(z))), np.zeros((5, len(z)))
        for i in range(steps.n):
            rows = steps[i]
            wide = rows.stop - rows.start
            x, v, a, b, c = (k[:wide] for k in (x, v, a, b, c))
            dt = t[rows] - t[steps[i - 1]][:wide] if i else np.zeros(wide)
            x, a, b, c = x + dt * v, a + 2 * dt * b + dt**2 * c + noise * dt**3 / 3, b + dt * c + noise * dt**2 / 2, c + noise * dt
            ahead[:, rows] = x, v, a, b, c
            off, s = z[rows] - x, a + reading
            counts = np.abs(off) <= reject * np.sqrt(s)
            k, l, off = np.where(counts, a / s, 0.0), np.where(counts, b / s, 0.0), np.where(counts, off, 0.0)
            x, v, a, b, c = x + k * off, v + l * off, a - k * a, b - k * b, c - l * b
            now[:, rows] = x, v, a, b, c
        for i in range(steps.n - 2, -1, -1):
            after = steps[i + 1]
            rows = slice(steps[i].start, steps[i].start + after.stop - after.start)
            xp, vp, ap, bp, cp = ahead[:, after]
            dx, dv, det = now[0, after] - xp, now[1, after] - vp, ap * cp - bp * bp
            f, g = (cp * dx - bp * dv) / det, (ap * dv - bp * dx) / det
            g = g + (t[after] - t[rows]) * f
            now[0, rows] += now[2, rows] * f + now[3, rows] * g
            now[1, rows] += now[3, rows] * f + now[4, rows] * g
        out = np.empty_like(kept)
        out[steps.order] = now[0]
        return np.where(np.repeat(n < 2, np.diff(np.append(start, len(kept)))), kept, out)

    def run(rows: pa.Table, start: np.ndarray) -> pa.Table:
        t = floats(rows, t_s)
        for c in columns:
            rows = replaced(rows, c, smooth(floats(rows, c), t, start))
        return rows

    return whole(df, entity, t_s, run, df.schema)


def segments(intervals: DataFrame, start: str, end: str, n: int = 20) -> DataFrame:
    """n equal segments of each interval: seg from 0, seg_start, seg_end, in the unit of the bounds (as doubles)."""
    size = (F.col(end) - F.col(start)) / F.lit(float(n))
    out = intervals.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("seg_start", F.col(start) + F.col("seg") * size).withColumn("seg_end", F.col(start) + (F.col("seg") + 1) * size)


def pivot_segments(long: DataFrame, keys: list[str], columns: list[str], n: int = 20) -> DataFrame:
    """segNN_* columns from one row a segment, in one aggregation."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("seg") == s, F.col(c))).alias(f"seg{s:02d}_{c}") for s in range(n) for c in columns])


def between_segments(long: DataFrame, key: str, c: str, n: int = 20) -> DataFrame:
    """Spread, shares of the halves, centre of mass, slope and peak of a value over an interval's segments."""
    s, v = F.col("seg"), F.col(c)
    total = F.nullif(F.sum(v), F.lit(0.0))
    return long.groupBy(key).agg(
        F.stddev_pop(v).alias(f"{c}_seg_std"), (F.max(v) - F.min(v)).alias(f"{c}_seg_range"),
        (F.sum(F.when(s < n // 2, v)) / total).alias(f"{c}_first_half"), (F.sum(F.when(s >= n // 2, v)) / total).alias(f"{c}_last_half"),
        (F.sum(v * (s + 1)) / total).alias(f"{c}_centre"), F.regr_slope(v, s.cast("double")).alias(f"{c}_slope"),
        F.max_by(s, F.struct(v, -s)).alias(f"{c}_peak"),
    )


def fill_from_neighbours(long: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A missing segment takes the mean of the segments beside it (the one that there is at the ends)."""
    w = by(key, "seg")
    fill = lambda c: F.coalesce(F.col(c), (F.coalesce(F.lag(c).over(w), F.lead(c).over(w)) + F.coalesce(F.lead(c).over(w), F.lag(c).over(w))) / 2)
    return long.withColumns({c: fill(c) for c in columns})


def position_in_flight(start: Column, end: Column, takeoff: Column, landing: Column) -> dict[str, Column]:
    span = F.nullif((landing - takeoff).cast("double"), F.lit(0.0))
    return {"pos_start": (start - takeoff) / span, "pos_end": (end - takeoff) / span, "pos_mid": ((start + end) / 2 - takeoff) / span, "pos_span": (end - start) / span, "since_takeoff": start - takeoff, "to_landing": landing - end}
