"""Encodings, buckets and derived ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .atmosphere import ratio


def cyclic(c: Column, period: float, name: str) -> dict[str, Column]:
    angle = c * (2 * math.pi / period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def calendar(ts: Column) -> dict[str, Column]:
    """Hour, month, day of year, day of week (Monday 0), season, share of the day, with cyclic encodings."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    out = {"hour": F.hour(ts), "month": F.month(ts), "day_of_year": F.dayofyear(ts), "weekday": F.weekday(ts), "season": F.floor(F.month(ts) % 12 / 3).cast("int"), "day_share": second / 86400.0}
    return out | cyclic(F.hour(ts), 24, "hour") | cyclic(F.month(ts), 12, "month") | cyclic(F.dayofyear(ts), 365.25, "doy")


def bucket(c: Column, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """Label of the interval; closed on the right (low, high], or on the left with right=False. NULL outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        inside = ((c > low) & (c <= high)) if right else ((c >= low) & (c < high))
        out = F.when(inside, label).otherwise(out)
    return out


def crossed(*columns: Column) -> Column:
    """Interaction category; NULL parts read `nan`."""
    return F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in columns])


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def over(a: Column, b: Column, floor: float = 1.0) -> Column:
    """a over b, where b counts as `floor` at least."""
    return a / F.greatest(b, F.lit(floor))


def compared(a: Column, b: Column, name: str) -> dict[str, Column]:
    """Difference, ratio, percentage, square and agreement of two estimates."""
    d = a - b
    return {f"{name}_diff": d, f"{name}_ratio": ratio(a, b), f"{name}_pct": F.when(b > 0, d / b * 100), f"{name}_sq": d * d, f"{name}_agree": F.exp(-F.abs(d) / 100)}


def energy(mass: Column, h1_m: Column, h2_m: Column, v1_ms: Column, v2_ms: Column, seconds: Column) -> dict[str, Column]:
    """Changes of potential and kinetic energy in MJ, their sum, per kg, and mean power in MW."""
    pe, ke = mass * 9.80665 * (h2_m - h1_m) / 1e6, 0.5 * mass * (v2_ms * v2_ms - v1_ms * v1_ms) / 1e6
    return {"d_pe": pe, "d_ke": ke, "d_energy": pe + ke, "energy_per_kg": ratio(pe + ke, mass), "power": ratio(pe + ke, seconds)}


def nonlinear(c: Column, name: str) -> dict[str, Column]:
    return {f"{name}_sq": c * c, f"{name}_cube": c * c * c, f"{name}_log": F.when(c > 0, F.log(c))}


def physics_interactions(mtow: Column, oew: Column, distance: Column, seconds: Column, error: Column) -> dict[str, Column]:
    mass = F.greatest(mtow - oew, F.lit(1.0))
    return {"mass_above_oew": mass, "distance_per_mass": distance / mass, "time_per_mass": seconds / mass, "error_mass_per_distance": error * mass / (distance + 1e-6)}


def operating_interactions(c: dict[str, Column]) -> dict[str, Column]:
    """Errors, shape and imbalance of phases combined, each where its parts are among `c`: error, mass, distance, mach_altitude,
    efficiency, cruise_tas, aspect_ratio, cruise_distance, cruise_share, ground_distance, climb_s, descent_s, total_s, fuel_per_tow, fuel_per_mass."""
    has = lambda *names: all(n in c for n in names)
    tiny = 1e-6
    out = {}
    for name, a, b in (("error_x_mass", "error", "mass"), ("error_x_distance", "error", "distance"), ("mach_altitude_eff", "mach_altitude", "efficiency"), ("tas_x_aspect_ratio", "cruise_tas", "aspect_ratio")):
        if has(a, b):
            out[name] = c[a] * c[b]
    level = c["cruise_distance"] if has("cruise_distance") else c["distance"] * c["cruise_share"] if has("distance", "cruise_share") else c["ground_distance"] * c["cruise_share"] if has("ground_distance", "cruise_share") else None
    if level is not None and has("distance"):
        out["level_distance_fraction"] = level / (c["distance"] + tiny)
    for phase in ("climb", "descent"):
        if has(f"{phase}_s", "total_s"):
            out[f"{phase}_time_fraction"] = c[f"{phase}_s"] / (c["total_s"] + tiny)
    burnt = c["fuel_per_tow"] if has("fuel_per_tow") else c["fuel_per_mass"] * c["mass"] if has("fuel_per_mass", "mass") else None
    if burnt is not None and has("ground_distance"):
        out["fuel_efficiency_per_nm"] = burnt / (c["ground_distance"] + tiny)
    return out


def fuel_derived(a: Column, o: Column, seconds: Column, tow: Column, mass: Column, shares: dict[str, Column]) -> dict[str, Column]:
    """What follows from two estimates of an interval's fuel: rates an hour, shares of masses, rates by phase, and how the two compare."""
    hours = F.nullif(seconds / 3600.0, F.lit(0.0))
    out = {"rate_a": a / hours, "rate_o": o / hours, "per_tow": ratio(a, tow), "per_mass": ratio(a, mass)}
    out |= {f"rate_{k}": a * share / hours for k, share in shares.items()}
    return out | {"diff": a - o, "sq_diff": (a - o) * (a - o), "ratio_ao": ratio(a, o), "pct": ratio(a - o, o) * 100, "agreement": F.exp(-F.abs(a - o) / 100.0)}


def recomputed(pairs: dict[str, tuple[str, str]], squares: list[str]) -> dict[str, Column]:
    """What follows from filled columns, anew: pairs {name: (a, b)} give difference and ratio, squares their square."""
    out = {f"{n}_{k}": v for n, (a, b) in pairs.items() for k, v in (("diff", F.col(a) - F.col(b)), ("ratio", ratio(F.col(a), F.col(b))))}
    return out | {f"{c}_sq": F.col(c) * F.col(c) for c in squares}


def mode_of(shares: dict[str, Column], old: Column) -> Column:
    """The phase with the largest share where `old` is missing (the first of equals, `unknown` if none has any)."""
    zero = {k: F.coalesce(c, F.lit(0.0)) for k, c in shares.items()}
    top = F.greatest(*zero.values())
    return F.coalesce(old, F.when(top > 0, F.coalesce(*[F.when(c == top, F.lit(k)) for k, c in zero.items()])).otherwise(F.lit("unknown")))


def flag(c: Column) -> Column:
    """A flag that is not known is false."""
    return F.coalesce(c, F.lit(False))


def pruned(dtypes: list[tuple[str, str]], prefixes: tuple[str, ...] = ("name_",), suffixes: tuple[str, ...] = ("_ts",), parts: tuple[str, ...] = ("mass_change", "has_data"), kinds: tuple[str, ...] = ("string",), keep: tuple[str, ...] = ()) -> list[str]:
    """Columns that neither name nor type exclude."""
    return [c for c, t in dtypes if c in keep or not (c.startswith(prefixes) or c.endswith(suffixes) or any(p in c for p in parts) or t in kinds)]


def routed(shares: dict[str, float], weighted: tuple[str, ...] = ("mean", "std", "frac"), most: float = 0.5, kept: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """How to fill which column, by name and share of missing values: weighted by duration, plain, or coarse (`most` or more missing)."""
    out: dict[str, list[str]] = {"weighted": [], "plain": [], "coarse": []}
    for c, share in shares.items():
        if c not in kept and share > 0:
            out["coarse" if share >= most else "weighted" if any(k in c for k in weighted) else "plain"].append(c)
    return out


def missing_order(shares: dict[str, float], first: tuple[str, ...] = ("fuel", "mass")) -> list[str]:
    """Columns with missing values, those named as `first` before others, then fewest missing first."""
    return sorted((c for c, s in shares.items() if s > 0), key=lambda c: (not any(k in c for k in first), shares[c], c))


def pounds(c: Column) -> Column:
    return c / 2.2046226218


def synonym(c: Column, names: dict[str, str]) -> Column:
    """Upper-cased code, replaced where the map has it."""
    up = F.upper(F.trim(c))
    if not names:
        return up
    pairs = F.create_map(*[F.lit(x) for k, v in sorted(names.items()) for x in (k.upper(), v.upper())])
    return F.coalesce(F.try_element_at(pairs, up), up)


def select_by_type(kind: Column, raw_types: list[str], raw: Column, corrected: Column) -> Column:
    """The raw column for some types, else the corrected one, raw where that is missing."""
    return F.when(kind.isin(raw_types), raw).otherwise(F.coalesce(corrected, raw))


# What in a column's name says that it cannot be negative, and what says that it can.
NON_NEGATIVE = ("mass", "fuel", "flow", "distance", "duration", "altitude", "speed", "pressure", "density", "fraction", "count", "std")
SIGNED = ("diff", "delta", "change", "rate", "accel", "slope", "skew", "kurt", "deviation", "headwind", "lag", "lead")


def is_non_negative(name: str) -> bool:
    low = name.lower()
    return any(k in low for k in NON_NEGATIVE) and not any(k in low for k in SIGNED)
