"""The query of the composed interval table, with SQL for its couplings, neighbours and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import driver as D
from .plans import profiles as R
from .plans.tables import INTERVALS, intervals
from .profile_queries import _READ, BUCKET, _motion_sql, _readings, duck
from .queries import _rounded, d, query

_OWN = ("tas_mean", "altitude_mean", "fuel", "headwind_mean", "mult_mean", "mult_o_mean", "mass_mean", "vertical_rate_mean", "distance", "density_mean", "turned")
#: Products of large values are shown in millions, so that rounding is far from what a double holds.
_LARGE = [k for k in D.COUPLED if k.endswith("_sq") or k in ("alt_tas", "headwind_fuel", "rate_mass")]
_FLIGHT = ("n_points", "duration", "climb_time", "phase_cruise_fraction")


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CASE WHEN {a} = 0 AND {b} = 0 THEN 1 ELSE {a} / ({b} + 1e-6) END END"


_BESIDE = [x for c in D.LAGGED for x in ((f"{c}_prev", f"p_{c}"), (f"{c}_prev_diff", f"{c} - p_{c}"), (f"{c}_prev_ratio", _ratio(c, f"p_{c}")), (f"{c}_next", f"n_{c}"), (f"{c}_next_diff", f"n_{c} - {c}"), (f"{c}_next_ratio", _ratio(f"n_{c}", c)))]
_AROUND = [x for c in D.LAGGED for x in ((f"{c}_mean_3", f"avg({c}) OVER th"), (f"{c}_std_3", f"stddev_samp({c}) OVER th"), (f"{c}_dev_3", f"{c} - avg({c}) OVER th"))]

_SQL = f"""WITH {INTERVALS}, {_READ},
    ev AS (SELECT *, 'real' AS side FROM intervals UNION ALL SELECT flight_id, idx, i_start - (i_end - i_start), i_start, 'prev' FROM intervals WHERE idx % 8 = 0 UNION ALL SELECT flight_id, idx, i_end, i_end + (i_end - i_start), 'next' FROM intervals WHERE idx % 8 = 7),
    p AS (SELECT e.idx, e.side, m.* FROM ev e JOIN more m ON m.flight_id = e.flight_id AND m.t BETWEEN e.i_start AND e.i_end), {_motion_sql("p", "idx, side")},
    own AS (SELECT idx, side, {", ".join(f'({duck(R.INTERVAL[c])})::DOUBLE AS "{c}"' for c in _OWN)} FROM pr GROUP BY idx, side),
    ro AS (SELECT ev.*, own.* EXCLUDE (idx, side) FROM ev LEFT JOIN own USING (idx, side)),
    lg AS (SELECT *, {", ".join(f"lag({c}) OVER w AS p_{c}, lead({c}) OVER w AS n_{c}" for c in D.LAGGED)} FROM ro WINDOW w AS (PARTITION BY flight_id ORDER BY i_start)),
    fl AS (SELECT idx // 8 AS flight_id, sum(turned) AS flight_turned FROM own WHERE side = 'real' GROUP BY 1),
    fm AS (SELECT *, {R.PHASE} AS fphase FROM more), ft AS (SELECT flight_id, count(*)::DOUBLE AS n_points, (max(t) - min(t))::DOUBLE AS duration, coalesce(max(t) FILTER (fphase = 'climb') - min(t) FILTER (fphase = 'climb'), 0)::DOUBLE AS climb_time, avg((fphase = 'cruise')::INT::DOUBLE) AS phase_cruise_fraction FROM fm GROUP BY 1)
    SELECT idx, {", ".join(d(f'"{c}"', f'"{c}"') for c in _OWN)}, {", ".join(d(f"({duck(v)}) / 1e6" if k in _LARGE else duck(v), f'"{k}"') for k, v in D.COUPLED.items())}, {", ".join(d(e, f'"{k}"') for k, e in _BESIDE)}, {", ".join(d(e, f'"{k}"') for k, e in _AROUND)},
    {d("CASE WHEN fuel IS NOT NULL THEN sum(fuel) OVER (PARTITION BY lg.flight_id ORDER BY i_start ROWS UNBOUNDED PRECEDING) END", "fuel_so_far")}, {d("fl.flight_turned", "flight_turned")}, {", ".join(d(f"ft.{c}", f"flight_{c}") for c in _FLIGHT)}
    FROM lg LEFT JOIN fl USING (flight_id) LEFT JOIN ft USING (flight_id) WHERE side = 'real' WINDOW th AS (PARTITION BY lg.flight_id ORDER BY i_start ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""


@query(_SQL)
def interval_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed table of intervals without their segments (which `segment_features` and `between_segments` have)."""
    out = D.interval_table(_readings(spark, sf_dir).drop("kind"), intervals(spark, sf_dir), bucket=BUCKET, segments=0)
    names = ["idx", *_OWN, *D.COUPLED, *[k for k, _ in (*_BESIDE, *_AROUND)], "fuel_so_far", "flight_turned", *[f"flight_{c}" for c in _FLIGHT]]
    return _rounded(out.select(*names).withColumns({k: F.col(k) / 1e6 for k in _LARGE}), ["idx"])
