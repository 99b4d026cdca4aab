"""Full feature profiles of intervals, flights, phases and segments: named aggregates in SQL, applied in one pass each.

Each profile is a dictionary from column to aggregate, so that a caller can take
a part of it, and Catalyst prunes what nobody reads.  Values are as in the
operators: NULLs are skipped, a share counts unknown as not met, what a phase or
sign does not have is 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The signals of an interval that get all eight statistics, by prefix.
SIGNALS = {
    "altitude": "altitude", "groundspeed": "groundspeed", "tas": "TAS", "tas_acc": "tas_acc", "vertical_rate": "vertical_rate", "vertical_rate_abs": "abs(vertical_rate)", "mass": "mass",
    "flow": "flow", "thrust": "thrust", "drag": "drag", "mass_o": "mass_o", "flow_o": "flow_o", "mult": "mult", "mult_o": "mult_o",
}
PHASES = ("climb", "cruise", "descent", "ground")
FIVE = ("takeoff", "climb", "cruise", "descent", "landing")

PHASE = "CASE WHEN altitude < 500 THEN 'ground' WHEN vertical_rate > CASE WHEN altitude < 10000 THEN 500 ELSE 300 END THEN 'climb' WHEN vertical_rate < -CASE WHEN altitude < 10000 THEN 500 ELSE 300 END THEN 'descent' ELSE 'cruise' END"
SIN, COS = "sin(radians(track))", "cos(radians(track))"
HEAD, CROSS = f"(-(u * {SIN} + v * {COS}) / 0.514444D)", f"(abs(u * {COS} - v * {SIN}) / 0.514444D)"
WIND = "(sqrt(u * u + v * v) / 0.514444D)"
RHO = "(press * 100 / (287.05D * temp_k))"
QBAR = f"(0.5D * {RHO} * power(TAS * 0.514444D, 2))"
ISA_DEV = "(temp_k - (288.15D - 0.0065D * altitude * 0.3048D))"


def only(condition: str, c: str) -> str:
    return f"CASE WHEN {condition} THEN {c} END"


def share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0D ELSE 0.0D END)"


def or_zero(aggregate: str) -> str:
    return f"coalesce({aggregate}, 0.0D)"


def statistics(c: str, name: str) -> dict[str, str]:
    """min, max, mean, median, sample std, p10, p90, interquartile range; all percentiles of a signal are one aggregate."""
    p = [f"percentile({c}, array(0.1, 0.25, 0.5, 0.75, 0.9))[{k}]" for k in range(5)]
    out = {"min": f"min({c})", "max": f"max({c})", "mean": f"avg({c})", "median": p[2], "std": f"stddev_samp({c})", "p10": p[0], "p90": p[4], "iqr": f"{p[3]} - {p[1]}"}
    return {f"{name}_{k}": v for k, v in out.items()}


def signed(c: str, name: str, sides: dict[str, str]) -> dict[str, str]:
    """Mean, std, max and min of a value's positive and negative side, 0 without any."""
    return {f"{name}_{side}_{k}": or_zero(f"{f}({only(f'{c} {test} 0', c)})") for side, test in sides.items() for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min"))}


def cv(c: str) -> str:
    return only(f"abs(avg({c})) > 0.000001D", f"stddev_samp({c}) / abs(avg({c}))")


INTERVAL = {
    "n_points": "count(*)",
    **{k: v for name, c in SIGNALS.items() for k, v in statistics(c, name).items()},
    "alt_start": "min_by(altitude, us)", "alt_end": "max_by(altitude, us)", "alt_change": "max_by(altitude, us) - min_by(altitude, us)",
    "mass_start": "min_by(mass, us)", "mass_end": "max_by(mass, us)", "mass_change": "min_by(mass, us) - max_by(mass, us)",
    "altitude_cv": cv("altitude"), "tas_cv": cv("TAS"), "vertical_rate_cv": f"coalesce({cv('vertical_rate')}, {only('count(vertical_rate) > 0', '0.0D')})",
    "vertical_rate_level": f"CASE WHEN {share(PHASE + ' = ' + chr(39) + 'cruise' + chr(39))} > 0.5D THEN 0.0D ELSE avg(vertical_rate) END",
    **signed("vertical_rate", "rate", {"climb": ">", "descent": "<"}), **signed("tas_acc", "accel", {"pos": ">", "neg": "<"}),
    **{f"frac_{p}": share(f"phase = '{p}'") for p in PHASES},
    "frac_slow": share("groundspeed < 250"), "frac_middle": share("groundspeed >= 250 AND groundspeed < 450"), "frac_fast": share("groundspeed >= 450"),
    **{f"frac_alt_{lo}": share(f"altitude >= {lo} AND altitude < {lo + 10000}") for lo in (0, 10000, 20000)}, "frac_alt_30000": share("altitude >= 30000"), "frac_rebuilt": share("rebuilt"),
    "headwind_mean": f"avg({HEAD})", "headwind_std": f"stddev_pop({HEAD})", "headwind_p10": f"percentile({HEAD}, 0.1)", "headwind_p90": f"percentile({HEAD}, 0.9)", "headwind_shear": f"percentile({HEAD}, 0.9) - percentile({HEAD}, 0.1)", "frac_tailwind": share(f"{HEAD} < 0"),
    "crosswind_mean": f"avg({CROSS})", "crosswind_std": f"stddev_pop({CROSS})", "crosswind_p95": f"percentile({CROSS}, 0.95)", "wind_mean": f"avg({WIND})", "wind_std": f"stddev_samp({WIND})",
    "density_mean": f"avg({RHO})", "density_std": f"stddev_pop({RHO})", "qbar_mean": f"avg({QBAR})", "qbar_std": f"stddev_pop({QBAR})", "isa_dev_mean": f"avg({ISA_DEV})", "isa_dev_std": f"stddev_pop({ISA_DEV})",
    "n_phase_changes": "count(CASE WHEN phase <> phase_before THEN 1 END)",
    "has_toc": "coalesce(max(CASE WHEN phase = 'cruise' AND phase_before = 'climb' THEN 1 ELSE 0 END), 0)", "has_tod": "coalesce(max(CASE WHEN phase = 'descent' AND phase_before = 'cruise' THEN 1 ELSE 0 END), 0)",
    "distance": or_zero("sum(groundspeed * dt / 3600)"), "turned": or_zero("sum(abs(turn))"), "fuel": or_zero("sum(flow * dt / 3600)"), "fuel_o": or_zero("sum(flow_o * dt / 3600)"), "fuel_mult": or_zero("sum(flow * mult * dt / 3600)"),
    "thrust_to_weight": "avg(thrust) / nullif(avg(mass) * 9.80665D, 0)", "excess_power": "(avg(thrust) - avg(drag)) / nullif(avg(mass), 0)", "flow_ratio": "avg(flow) / nullif(avg(flow_o), 0)", "flow_diff": "avg(flow) - avg(flow_o)",
}

FLIGHT = {
    "n_points": "count(*)", "duration": "max(t) - min(t)",
    **{f"{c}_{k}": f"{f}({c})" for c in ("altitude", "groundspeed", "TAS", "vertical_rate") for k, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_samp"))},
    **{f"phase_{p}_fraction": share(f"phase = '{p}'") for p in PHASES},
    **{f"{p}_{k}": or_zero(f.format(*[only(f"phase = '{p}'", c) for c in cs])) for p in PHASES[:3] for k, f, *cs in (
        ("time", "max({0}) - min({0})", "t"), ("distance", "max({0}) - min({0})", "dist"), ("avg_speed", "avg({0})", "groundspeed"), ("max_speed", "max({0})", "groundspeed"), ("median_speed", "percentile({0}, 0.5)", "groundspeed"),
        ("avg_tas", "avg({0})", "TAS"), ("median_tas", "percentile({0}, 0.5)", "TAS"), ("avg_altitude", "avg({0})", "altitude"), ("max_altitude", "max({0})", "altitude"), ("median_altitude", "percentile({0}, 0.5)", "altitude"),
        ("std_altitude", "stddev_samp({0})", "altitude"), ("avg_vr", "avg({0})", "vertical_rate"), ("median_vr", "percentile({0}, 0.5)", "vertical_rate"), ("accel", "avg({0})", "phase_acc"))},
    "track_change": or_zero("sum(abs(turn))"), "net_distance_ratio": "max(dist) / nullif(max(t) - min(t), 0)", "fuel": or_zero("sum(flow * dt / 3600)"),
}

#: Five phases of a flight; distance and time between consecutive readings of the same phase.
FIVE_PHASES = {
    f"{p}_{k}": or_zero(f.format(*[only(f"overlay = '{p}'", c) for c in cs])) for p in FIVE for k, f, *cs in (
        ("n", "count({0})", "t"), ("time", "sum({0})", "over_dt"), ("distance", "sum({0})", "groundspeed * over_dt / 3600"), ("avg_gs", "avg({0})", "groundspeed"), ("max_gs", "max({0})", "groundspeed"), ("min_gs", "min({0})", "groundspeed"), ("median_gs", "percentile({0}, 0.5)", "groundspeed"),
        ("avg_tas", "avg({0})", "TAS"), ("median_tas", "percentile({0}, 0.5)", "TAS"), ("avg_cas", "avg({0})", "CAS"), ("avg_mach", "avg({0})", "mach"), ("avg_altitude", "avg({0})", "altitude"), ("max_altitude", "max({0})", "altitude"), ("median_altitude", "percentile({0}, 0.5)", "altitude"),
        ("std_altitude", "stddev_samp({0})", "altitude"), ("avg_vr", "avg({0})", "vertical_rate"), ("median_vr", "percentile({0}, 0.5)", "vertical_rate"), ("accel", "avg({0})", "over_acc"))
}

#: A whole track for the take-off weight.
WHOLE = {
    **{f"{name}_{k}": f for name, c in (("altitude", "altitude"), ("groundspeed", "groundspeed"), ("tas", "TAS"), ("cas", "CAS"), ("mach", "mach"), ("vr", "vertical_rate"), ("wind", WIND), ("temperature", "temp_k"), ("pressure", "press")) for k, f in (("avg", f"avg({c})"), ("max", f"max({c})"), ("std", f"stddev_samp({c})"), ("median", f"percentile({c}, 0.5)"))},
    "n_rows": "count(*)", "n_altitude": "count(altitude)", "n_mach": "count(mach)", "n_tas": "count(TAS)",
    # ratios with a denominator of 1 at least
    "tas_cas_ratio": "avg(TAS) / greatest(avg(CAS), 1)", "climb_time_ratio": "sum(CASE WHEN phase = 'climb' THEN coalesce(dt, 0) ELSE 0 END) / greatest(max(t) - min(t), 1)", "cruise_time_ratio": "sum(CASE WHEN phase = 'cruise' THEN coalesce(dt, 0) ELSE 0 END) / greatest(max(t) - min(t), 1)",
    "wind_effect": "(avg(groundspeed) - avg(TAS)) / greatest(avg(TAS), 1)", "climb_performance": f"avg({only('vertical_rate > 0', 'vertical_rate')}) / greatest(avg(mass) / 1000, 1)", "route_inefficiency": "max(dist) / greatest(avg(groundspeed), 1)",
}

_TRIMMED = "avg(CASE WHEN {0}_s > 0 AND abs({0} - {0}_m) > 3 * {0}_s THEN NULL ELSE {0} END)"
_ANGLE = f"degrees(asin(greatest(-1.0D, least(1.0D, {_TRIMMED.format('vertical_rate')} / ({_TRIMMED.format('TAS')} + 0.000001D)))))"
SEGMENT = {
    "n": "count(*)", **{f"{name}_mean": f"avg({c})" for name, c in (("altitude", "altitude"), ("groundspeed", "groundspeed"), ("flow", "flow"), ("flow_o", "flow_o"), ("mass", "mass"), ("mass_o", "mass_o"), ("thrust", "thrust"), ("drag", "drag"), ("temperature", "temp_k"), ("track", "track"), ("mult", "mult"), ("mult_o", "mult_o"), ("density", RHO), ("headwind", HEAD), ("crosswind", CROSS), ("tas_accel", "tas_acc"))},
    "vertical_rate_mean": "coalesce(avg(vertical_rate), (max_by(altitude, us) - min_by(altitude, us)) / nullif(max(t) - min(t), 0) * 60, 0)", "track_std": "stddev_samp(track)", "mult_std": "stddev_samp(mult)", "mult_o_std": "stddev_samp(mult_o)",
    "qbar_mean": f"0.5D * avg({RHO}) * power(avg(TAS) * 0.514444D, 2)", "fpa": _ANGLE, "aoa_proxy": _ANGLE,
    "curvature": "sum(abs(turn)) / nullif(avg(groundspeed) * sum(dt) / 3600, 0)", "excess_power": "(avg(thrust) - avg(drag)) / nullif(avg(mass), 0)", "thrust_weight": "avg(thrust) / nullif(avg(mass) * 9.80665D, 0)", "drag_weight": "avg(drag) / nullif(avg(mass) * 9.80665D, 0)",
    "sfc": "avg(flow) / nullif(avg(thrust), 0)", "sfc_o": "avg(flow_o) / nullif(avg(thrust), 0)", "flow_diff": "avg(flow) - avg(flow_o)", "flow_ratio": "avg(flow) / nullif(avg(flow_o), 0)",
}

#: Between the segments of an interval: needs the segments' means, their deltas to the next segment, and place and number of those with a flow or an altitude.
BETWEEN = {
    "mean_gs_acceleration": "avg(d_gs)", "max_gs_acceleration": "max(d_gs)", "min_gs_deceleration": "min(d_gs)", "gs_acceleration_std": "stddev_pop(d_gs)", "mean_alt_delta": "avg(d_alt)",
    **{f"{k}_{side}_power{tail}": f"{f}({side}_mean * groundspeed_mean)" for side in ("thrust", "drag") for k, f, tail in (("total", "sum", ""), ("avg", "avg", ""), ("std", "stddev_pop", ""))},
    **{f"seg_{c}_{k}": f.format(f"{c}_mean") for c in ("flow", "flow_o", "vertical_rate", "mass", "mass_o") for k, f in (("std", "stddev_pop({0})"), ("range", "max({0}) - min({0})"))}, **{f"seg_{c}_cv": f"stddev_pop({c}_mean) / (avg({c}_mean) + 0.01D)" for c in ("flow", "flow_o")},
    "fuel_share_first_half": "CASE WHEN max(flow_n) >= 4 AND sum(flow_mean) > 0 THEN sum(CASE WHEN flow_i <= floor(flow_n / 2) THEN flow_mean END) / sum(flow_mean) END", "fuel_share_last_half": "CASE WHEN max(flow_n) >= 4 AND sum(flow_mean) > 0 THEN sum(CASE WHEN flow_i > floor(flow_n / 2) THEN flow_mean END) / sum(flow_mean) END",
    "fuel_com_index": "CASE WHEN max(flow_n) >= 4 AND sum(flow_mean) > 0 THEN sum(flow_i * flow_mean) / sum(flow_mean) END", "alt_trend": "CASE WHEN count(altitude_mean) >= 3 THEN regr_slope(altitude_mean, CAST(alt_i AS DOUBLE)) END",
    "alt_peak": "CASE WHEN count(altitude_mean) >= 3 THEN min(CASE WHEN altitude_mean = alt_top THEN alt_i - 1 END) END", "alt_valley": "CASE WHEN count(altitude_mean) >= 3 THEN min(CASE WHEN altitude_mean = alt_low THEN alt_i - 1 END) END",
    **{f"seg_{c}_{k}": f"CASE WHEN count({c}_mean) > 1 THEN {f.format(f'{c}_mean')} END" for c in ("mult", "mult_o") for k, f in (("std", "stddev_pop({0})"), ("range", "max({0}) - min({0})"))},
}


def aggregated(df: DataFrame, keys: list[str], aggregates: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(v).alias(k) for k, v in aggregates.items()])


def with_motion(points: DataFrame, keys: list[str], t: str = "t", us: str = "us") -> DataFrame:
    """Readings with their phase and the changes from the reading before (of the same keys): dt, tas_acc, turn, phase_before, dist, phase_acc."""
    w = Window.partitionBy(*keys).orderBy(us)
    same = Window.partitionBy(*keys, "phase").orderBy(us)
    dt = lambda o: F.nullif((F.col(t) - F.lag(t).over(o)).cast("double"), F.lit(0.0))
    out = points.withColumn("phase", F.expr(PHASE))
    out = out.withColumns({"dt": F.col(t) - F.lag(t).over(w), "tas_acc": (F.col("TAS") - F.lag("TAS").over(w)) / dt(w), "turn": F.pmod(F.col("track") - F.lag("track").over(w) + 180, F.lit(360.0)) - 180})
    out = out.withColumns({"phase_before": F.lag("phase").over(w), "phase_acc": (F.col("groundspeed") - F.lag("groundspeed").over(same)) / dt(same)})
    return out.withColumn("dist", F.coalesce(F.sum(F.col("groundspeed") * F.col("dt") / 3600).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))


def with_overlay(points: DataFrame, key: str, overlay, t: str = "t", us: str = "us") -> DataFrame:
    """Adds overlay (one of five phases), and over_dt and over_acc from the reading before of the same phase."""
    same = Window.partitionBy(key, "overlay").orderBy(us)
    out = points.withColumn("overlay", overlay)
    out = out.withColumn("over_dt", F.col(t) - F.lag(t).over(same))
    return out.withColumn("over_acc", (F.col("groundspeed") - F.lag("groundspeed").over(same)) / F.nullif(F.col("over_dt").cast("double"), F.lit(0.0)))


def segment_profile(inside: DataFrame, keys: list[str]) -> DataFrame:
    """Means and derived values of segments with two readings at least; angles leave out readings beyond three standard deviations."""
    w = Window.partitionBy(*keys)
    spread = {f"{c}_{k}": f(c).over(w) for c in ("vertical_rate", "TAS") for k, f in (("m", F.avg), ("s", F.stddev_samp))}
    return aggregated(inside.withColumns(spread), keys, SEGMENT).where("n >= 2")


def between_segments(segments: DataFrame, key: str, seg: str = "seg") -> DataFrame:
    """How an interval's segments change from one to the next and over the interval."""
    w, whole = Window.partitionBy(key).orderBy(seg), Window.partitionBy(key)
    delta = lambda c: F.when(F.lead(seg).over(w) == F.col(seg) + 1, F.lead(c).over(w) - F.col(c))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = segments.withColumns({
        "d_gs": delta("groundspeed_mean"), "d_alt": delta("altitude_mean"), "flow_i": F.when(F.col("flow_mean").isNotNull(), F.count("flow_mean").over(upto)), "flow_n": F.count("flow_mean").over(whole),
        "alt_i": F.when(F.col("altitude_mean").isNotNull(), F.count("altitude_mean").over(upto)), "alt_top": F.max("altitude_mean").over(whole), "alt_low": F.min("altitude_mean").over(whole),
    })
    return aggregated(placed, [key], BETWEEN)
