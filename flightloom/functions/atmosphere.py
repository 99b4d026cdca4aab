"""Standard atmosphere, air speeds and wind as column expressions (NULL in, NULL out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ICAO standard atmosphere and unit factors.
T0, LAPSE, T_TROPOPAUSE, H_TROPOPAUSE = 288.15, 0.0065, 216.65, 11000.0
P0, G0, R_AIR, GAMMA, RHO0 = 101325.0, 9.80665, 287.05287, 1.4, 1.225
R_SHORT = 287.05
KNOT, FOOT = 0.514444, 0.3048


def clean(c: Column) -> Column:
    """NaN and infinities become NULL; Spark would rank NaN above all numbers."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 (ANSI mode raises otherwise)."""
    return a / F.nullif(b, F.lit(0.0))


def clamp(c: Column, low: float, high: float) -> Column:
    """NULL stays NULL: greatest and least alone would return the limit."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def isa_temperature(h_m: Column) -> Column:
    return F.when(h_m <= H_TROPOPAUSE, T0 - LAPSE * h_m).when(h_m.isNotNull(), F.lit(T_TROPOPAUSE))


def isa_pressure(h_m: Column, r: float = R_AIR) -> Column:
    """Pa; the height is limited to 0 to 25 km."""
    h = clamp(h_m, 0, 25000)
    low = P0 * F.pow(1 - LAPSE * h / T0, F.lit(G0 / (R_AIR * LAPSE)))
    at_tropopause = P0 * (T_TROPOPAUSE / T0) ** (G0 / (R_AIR * LAPSE))
    high = at_tropopause * F.exp(-G0 * (h - H_TROPOPAUSE) / (r * T_TROPOPAUSE))
    return F.when(h <= H_TROPOPAUSE, low).otherwise(high)


def pressure_hpa_from_feet(alt_ft: Column) -> Column:
    """hPa, not limited, with R = 287.05."""
    h = alt_ft * FOOT
    exponent = G0 / (R_SHORT * LAPSE)
    low = P0 * F.pow(F.greatest(1 - LAPSE * h / T0, F.lit(0.0)), F.lit(exponent))
    high = P0 * (T_TROPOPAUSE / T0) ** exponent * F.exp(-G0 * (h - H_TROPOPAUSE) / (R_SHORT * T_TROPOPAUSE))
    return F.when(h <= H_TROPOPAUSE, low).otherwise(high) / 100


def sound_speed(temp_k: Column, r: float = R_SHORT) -> Column:
    return F.sqrt(GAMMA * r * F.when(temp_k >= 0, temp_k))


def mach_to_tas(mach: Column, temp_k: Column, r: float = R_SHORT) -> Column:
    """m/s."""
    return mach * sound_speed(temp_k, r)


def tas_to_mach(tas_ms: Column, temp_k: Column, r: float = R_SHORT) -> Column:
    return ratio(tas_ms, sound_speed(temp_k, r))


def tas_to_cas(tas_ms: Column, h_m: Column) -> Column:
    """With the pressure ratio (at least 0.1) in the place of the density ratio, as the pipeline has it."""
    return tas_ms * F.sqrt(F.when(h_m.isNotNull(), F.greatest(isa_pressure(h_m) / P0, F.lit(0.1))))


def cas_to_tas(cas: Column, rho: Column) -> Column:
    return ratio(cas, F.sqrt(F.when(rho > 0, rho) / RHO0))


def density(p_hpa: Column, temp_k: Column, q: Column | None = None) -> Column:
    """kg/m3; with humidity q by virtual temperature."""
    warmth = temp_k * (1 + 0.608 * F.coalesce(q, F.lit(0.0))) if q is not None else temp_k
    return ratio(p_hpa * 100, R_SHORT * warmth)


def dynamic_pressure(rho: Column, tas_kt: Column) -> Column:
    return 0.5 * rho * F.pow(tas_kt * KNOT, F.lit(2.0))


def isa_deviation(temp_k: Column, alt_ft: Column) -> Column:
    """Against the lapse rate at every height, without a tropopause."""
    return temp_k - (T0 - LAPSE * alt_ft * FOOT)


def wind_components(u: Column, v: Column, track_deg: Column) -> dict[str, Column]:
    """Wind speed, headwind and absolute crosswind in knots."""
    a = F.radians(track_deg)
    along = u * F.sin(a) + v * F.cos(a)
    across = u * F.cos(a) - v * F.sin(a)
    return {"wind_speed": F.hypot(u, v) / KNOT, "headwind": -along / KNOT, "crosswind": F.abs(across) / KNOT}


def ground_to_air_speed(gs: Column, track_deg: Column, u: Column, v: Column) -> Column:
    """TAS from ground speed, track and wind, all in one unit."""
    a = F.radians(track_deg)
    return F.hypot(gs * F.sin(a) - u, gs * F.cos(a) - v)


def air_to_ground_speed(tas: Column, track_deg: Column, u: Column, v: Column) -> Column:
    """Ground speed from TAS along the track and wind."""
    a = F.radians(track_deg)
    return F.hypot(tas * F.sin(a) + u, tas * F.cos(a) + v)


def crude_mach(tas_kt: Column, alt_ft: Column) -> Column:
    celsius = 15 - 6.5 * alt_ft * FOOT / 1000
    return ratio(tas_kt, 661 * F.sqrt(F.when(celsius.isNotNull(), F.greatest(celsius + 273.15, F.lit(0.0)))) / 15)


def fuel_density_kg_per_l(celsius: Column) -> Column:
    return 0.8 * (1 - 0.0007 * (celsius - 15))
