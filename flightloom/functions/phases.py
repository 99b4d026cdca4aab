"""Flight phases, limits and choices between sources of a speed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .atmosphere import KNOT, clamp

# Physical limits that values are clamped to, and caps beyond which they count as missing.
CLAMPS = {"groundspeed": (50, 600), "mach": (0.15, 0.90), "TAS": (50, 600), "CAS": (50, 400), "vertical_rate": (-6000, 6000), "altitude": (0, 50000)}
MACH_RANGE = (0.40, 0.90)


def flight_phase(vertical_rate: Column, altitude: Column) -> Column:
    """ground, climb, descent or cruise; NULL altitude counts as high, NULL rate as cruise."""
    band = F.when(altitude < 10000, 500).otherwise(300)
    return F.when(altitude < 500, "ground").when(vertical_rate > band, "climb").when(vertical_rate < -band, "descent").otherwise("cruise")


def one_hot(c: Column, values: list[str], prefix: str) -> dict[str, Column]:
    """0/1 columns, 0 for NULL."""
    return {f"{prefix}_{v}": F.coalesce((c == v).cast("int"), F.lit(0)) for v in values}


def overlay_phase(vertical_rate: Column, altitude: Column, since_start: Column, to_end: Column) -> Column:
    """Five phases; what is named first here wins: landing, takeoff, descent, climb, cruise."""
    landing = (to_end <= 120) | ((altitude < 1500) & (vertical_rate < -300))
    takeoff = (since_start <= 120) | ((altitude < 1500) & (vertical_rate > 500))
    return F.when(landing, "landing").when(takeoff, "takeoff").when(vertical_rate < -300, "descent").when(vertical_rate > 300, "climb").otherwise("cruise")


def gap_phase(alt1: Column, alt2: Column, fraction: Column) -> Column:
    """Phase of a hole between two readings; small changes are told by the place in the flight."""
    d = alt2 - alt1
    high = ((alt1 + alt2) / 2 >= 26000) & (F.abs(d) < 1000)
    return F.when(high | (F.abs(d) == 300), "cruise").when(d < -300, "descent").when(d > 300, "climb").when(fraction < 0.3, "climb").when(fraction > 0.7, "descent").otherwise("cruise")


def clamp_kinematics(columns: list[str]) -> dict[str, Column]:
    return {c: clamp(F.col(c), *CLAMPS[c]) for c in columns if c in CLAMPS}


def null_if(c: Column, bad: Column) -> Column:
    """NULL where the test is true; an unknown test keeps the value."""
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(None)).otherwise(c)


def global_caps() -> dict[str, Column]:
    gs, tas, cas, mach, vr, alt = (F.col(c) for c in ("groundspeed", "TAS", "CAS", "mach", "vertical_rate", "altitude"))
    return {
        "groundspeed": null_if(gs, (gs < 0) | (gs > 750)),
        "TAS": null_if(tas, (tas > 600) | ((tas < 60) & (alt > 1500))),
        "CAS": null_if(cas, (cas < 0) | (cas > 420)),
        "mach": null_if(mach, (mach < MACH_RANGE[0]) | (mach > MACH_RANGE[1])),
        "vertical_rate": null_if(vr, F.abs(vr) > 8000),
    }


def phase_caps() -> dict[str, Column]:
    """Caps by height; they come before the global ones."""
    gs, tas, vr, alt = (F.col(c) for c in ("groundspeed", "TAS", "vertical_rate", "altitude"))
    low, high = alt < 1500, alt >= 20000
    middle = (alt >= 1500) & (alt < 20000)
    return {
        "groundspeed": null_if(gs, low & (gs > 200)),
        "TAS": null_if(tas, (middle & (tas > 500)) | (high & ((tas < 350) | (tas > 550)))),
        "vertical_rate": null_if(vr, (middle & (F.abs(vr) > 5000)) | (high & (F.abs(vr) > 1000))),
    }


def consistency(sound_speed: Column) -> dict[str, Column]:
    """Optional: readings that contradict each other become NULL (mach against TAS, ground speed against TAS)."""
    tas, mach, gs = F.col("TAS"), F.col("mach"), F.col("groundspeed")
    off = F.abs(tas - mach * sound_speed) > 0.08 * sound_speed
    return {"mach": null_if(mach, off), "TAS": null_if(tas, off), "groundspeed": null_if(gs, F.abs(gs - tas) > 200)}


def mach_plausible(mach: Column, altitude: Column) -> Column:
    limit = F.when(altitude < 10000, 0.5).when(altitude < 20000, 0.7).otherwise(MACH_RANGE[1])
    return (mach >= MACH_RANGE[0]) & (mach <= MACH_RANGE[1]) & (mach < limit)


def choose_speed(altitude: Column, wind: Column, cas: Column, mach: Column) -> tuple[Column, Column]:
    """TAS by the order that suits the height, and which source it came from."""
    orders = [(altitude < 10000, "wind cas mach"), (altitude < 20000, "cas mach wind"), (F.lit(True), "mach cas wind")]
    of = {"wind": wind, "cas": cas, "mach": mach}
    pick = lambda f: reduce(lambda out, o: F.when(o[0], f(o[1].split())).otherwise(out), reversed(orders), F.lit(None))
    value = pick(lambda names: F.coalesce(*[of[n] for n in names]))
    source = pick(lambda names: F.coalesce(*[F.when(of[n].isNotNull(), n) for n in names]))
    return value, source


def taxi_speed(tas: Column, gs_kt: Column, altitude: Column) -> Column:
    """On the ground a missing TAS (m/s) is the ground speed, at most 1.5."""
    slow = ((altitude < 500) & (gs_kt < 50)) | (gs_kt < 5)
    return F.when(tas.isNull() & slow, clamp(gs_kt * KNOT, 0, 1.5)).otherwise(tas)


def filled_tag(before: Column, after: Column) -> Column:
    return F.when(before.isNull() & after.isNotNull(), "filled").otherwise("unknown")
