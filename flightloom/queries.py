"""Queries over the driver's tables, by operator, each with its SQL where SQL can express it.

Doubles are rounded to four digits on both sides, as engines add in different
orders; a small shift first keeps values off the ties, which engines round
differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import atmosphere as A
from .functions import features as X
from .functions import geo as G
from .functions import phases as P
from .functions import statistics as S
from .operators import folds, imputation, joins, nearest, physics, series, trajectory
from .plans.tables import FLIGHTS, INTERVALS, TRACKS, flights, intervals, tracks
from .streaming import events as stream

#: Added before rounding, on both sides.
SHIFT = 0.0000031415926

FLAGSHIP = "interval_features"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: Column | str, name: str | None = None) -> Column:
    """Rounded to four digits; -0.0 is 0.0."""
    return (F.round((F.col(c) if isinstance(c, str) else c) + SHIFT, 4) + F.lit(0.0)).alias(name or (c if isinstance(c, str) else "value"))


def rs(columns: dict[str, Column]) -> list[Column]:
    return [r(c, k) for k, c in columns.items()]


def d(expression: str, name: str) -> str:
    return f"round(({expression})::DOUBLE + {SHIFT}::DOUBLE, 4) + 0.0 AS {name}"


ROW = ["flight_id", "pid"]


def by_time() -> Window:
    return series.by("flight_id", "us")


OVER = "OVER (PARTITION BY flight_id ORDER BY us)"

# ---------------------------------------------------------------- scalar physics

_ISA_T = "CASE WHEN h <= 11000 THEN 288.15 - 0.0065 * h WHEN h IS NOT NULL THEN 216.65 END"
_EXP = "9.80665::DOUBLE / (287.05287::DOUBLE * 0.0065::DOUBLE)"
_HC = "greatest(0.0::DOUBLE, least(25000.0::DOUBLE, h))"
_ISA_P = f"CASE WHEN h IS NULL THEN NULL WHEN {_HC} <= 11000 THEN 101325 * pow(1 - 0.0065::DOUBLE * {_HC} / 288.15::DOUBLE, {_EXP}) ELSE 101325 * pow(216.65::DOUBLE / 288.15::DOUBLE, {_EXP}) * exp(-9.80665::DOUBLE * ({_HC} - 11000) / (287.05287::DOUBLE * 216.65::DOUBLE)) END"
_EXP2 = "9.80665::DOUBLE / (287.05::DOUBLE * 0.0065::DOUBLE)"
_HPA = f"CASE WHEN h <= 11000 THEN 101325 * pow(greatest(1 - 0.0065::DOUBLE * h / 288.15::DOUBLE, 0), {_EXP2}) WHEN h IS NOT NULL THEN 101325 * pow(216.65::DOUBLE / 288.15::DOUBLE, {_EXP2}) * exp(-9.80665::DOUBLE * (h - 11000) / (287.05::DOUBLE * 216.65::DOUBLE)) END / 100"


@query(f"""WITH {TRACKS}, m AS (SELECT *, altitude * 0.3048::DOUBLE AS h FROM tracks), p AS (SELECT *, {_HPA} AS hpa FROM m),
    s AS (SELECT *, hpa * 100 / (287.05::DOUBLE * temp_k) AS rho, sqrt(1.4::DOUBLE * 287.05::DOUBLE * temp_k) AS a FROM p)
    SELECT flight_id, pid, {d(_ISA_T, "isa_t")}, {d(_ISA_P, "isa_p")}, {d("hpa", "hpa")}, {d("mach * a", "mach_tas")}, {d("TAS / a", "tas_mach")},
    {d(f"CASE WHEN h IS NOT NULL THEN TAS * sqrt(greatest(({_ISA_P}) / 101325, 0.1)) END", "tas_cas")}, {d("CAS / sqrt(rho / 1.225)", "cas_tas")}, {d("rho", "rho")},
    {d("hpa * 100 / (287.05::DOUBLE * (temp_k * (1 + 0.608::DOUBLE * 0.01::DOUBLE)))", "rho_humid")}, {d("0.5 * rho * pow(TAS * 0.514444::DOUBLE, 2)", "qbar")},
    {d("temp_k - (288.15 - 0.0065 * altitude * 0.3048)", "isa_dev")}, {d("CASE WHEN h IS NOT NULL THEN TAS / (661 * sqrt(greatest(15 - 6.5::DOUBLE * altitude * 0.3048::DOUBLE / 1000 + 273.15, 0)) / 15) END", "crude_mach")},
    {d("0.8 * (1 - 0.0007::DOUBLE * (temp_k - 273.15 - 15))", "fuel_density")} FROM s""")
def atmosphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = F.col("altitude") * A.FOOT, F.col("temp_k")
    hpa = A.pressure_hpa_from_feet(F.col("altitude"))
    rho = A.density(hpa, t)
    return tracks(spark, sf_dir).select(*ROW, *rs({
        "isa_t": A.isa_temperature(h), "isa_p": A.isa_pressure(h), "hpa": hpa, "mach_tas": A.mach_to_tas(F.col("mach"), t), "tas_mach": A.tas_to_mach(F.col("TAS"), t),
        "tas_cas": A.tas_to_cas(F.col("TAS"), h), "cas_tas": A.cas_to_tas(F.col("CAS"), rho), "rho": rho, "rho_humid": A.density(hpa, t, F.lit(0.01)), "qbar": A.dynamic_pressure(rho, F.col("TAS")),
        "isa_dev": A.isa_deviation(t, F.col("altitude")), "crude_mach": A.crude_mach(F.col("TAS"), F.col("altitude")), "fuel_density": A.fuel_density_kg_per_l(t - 273.15),
    }))


@query(f"""WITH {TRACKS}, a AS (SELECT *, radians(track) AS k FROM tracks)
    SELECT flight_id, pid, {d("sqrt(u*u + v*v) / 0.514444::DOUBLE", "wind_speed")}, {d("-(u * sin(k) + v * cos(k)) / 0.514444::DOUBLE", "headwind")}, {d("abs(u * cos(k) - v * sin(k)) / 0.514444::DOUBLE", "crosswind")},
    {d("sqrt(pow(groundspeed * sin(k) - u, 2) + pow(groundspeed * cos(k) - v, 2))", "gs_tas")}, {d("sqrt(pow(TAS * sin(k) + u, 2) + pow(TAS * cos(k) + v, 2))", "tas_gs")} FROM a""")
def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v, k = F.col("u"), F.col("v"), F.col("track")
    return tracks(spark, sf_dir).select(*ROW, *rs(A.wind_components(u, v, k) | {"gs_tas": A.ground_to_air_speed(F.col("groundspeed"), k, u, v), "tas_gs": A.air_to_ground_speed(F.col("TAS"), k, u, v)}))


_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians(la2) - radians(la1)) / 2), 2) + cos(radians(la1)) * cos(radians(la2)) * pow(sin(radians(lo2 - lo1) / 2), 2))))"


@query(f"""WITH {TRACKS}, n AS (SELECT *, latitude AS la1, longitude AS lo1, lead(latitude) {OVER} AS la2, lead(longitude) {OVER} AS lo2, lead(us) {OVER} AS us2, lead(track) {OVER} AS k2 FROM tracks),
    b AS (SELECT *, {_HAV} AS m, degrees(atan2(sin(radians(lo2 - lo1)) * cos(radians(la2)), cos(radians(la1)) * sin(radians(la2)) - sin(radians(la1)) * cos(radians(la2)) * cos(radians(lo2 - lo1)))) AS az, (us2 - us) / 1e6 AS dt FROM n)
    SELECT flight_id, pid, {d("m / 1000", "km")}, {d("CASE WHEN az < 0 THEN az + 360 ELSE az END", "course")}, {d("m / CASE WHEN dt > 0 THEN dt END / 1000", "speed")},
    {d("least(abs(k2 - track), 360 - abs(k2 - track))", "turn")}, {d("((k2 - track + 180) % 360 + 360) % 360 - 180", "signed_turn")} FROM b""")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    la, lo, k = F.col("latitude"), F.col("longitude"), F.col("track")
    nxt = lambda c: F.lead(c).over(by_time())
    return tracks(spark, sf_dir).select(*ROW, *rs({
        "km": G.haversine(la, lo, nxt(la), nxt(lo)) / 1000, "course": G.track_from_positions(la, lo, by_time()), "speed": G.speed_from_positions(la, lo, F.col("us") / 1e6, by_time()) / 1000,
        "turn": G.angle_between(k, nxt(k)), "signed_turn": G.signed_turn(k, nxt(k)),
    }))


_PHASE = "CASE WHEN altitude < 500 THEN 'ground' WHEN vertical_rate > CASE WHEN altitude < 10000 THEN 500 ELSE 300 END THEN 'climb' WHEN vertical_rate < -CASE WHEN altitude < 10000 THEN 500 ELSE 300 END THEN 'descent' ELSE 'cruise' END"


@query(f"""WITH {TRACKS}, e AS (SELECT *, t - min(t) OVER (PARTITION BY flight_id) AS s, max(t) OVER (PARTITION BY flight_id) - t AS z FROM tracks)
    SELECT flight_id, pid, {_PHASE} AS phase, (({_PHASE}) = 'climb')::INTEGER AS phase_climb, (({_PHASE}) = 'cruise')::INTEGER AS phase_cruise,
    CASE WHEN z <= 120 OR altitude < 1500 AND vertical_rate < -300 THEN 'landing' WHEN s <= 120 OR altitude < 1500 AND vertical_rate > 500 THEN 'takeoff' WHEN vertical_rate < -300 THEN 'descent' WHEN vertical_rate > 300 THEN 'climb' ELSE 'cruise' END AS overlay FROM e""")
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Window.partitionBy("flight_id")
    phase = P.flight_phase(F.col("vertical_rate"), F.col("altitude"))
    over = P.overlay_phase(F.col("vertical_rate"), F.col("altitude"), F.col("t") - F.min("t").over(whole), F.max("t").over(whole) - F.col("t"))
    return tracks(spark, sf_dir).select(*ROW, phase.alias("phase"), *[c.alias(k) for k, c in P.one_hot(phase, ["climb", "cruise"], "phase").items()], over.alias("overlay"))


@query(f"""WITH {TRACKS}, p AS (SELECT flight_id, pid, altitude, mach, CAS, CASE WHEN altitude < 1500 AND groundspeed > 200 THEN NULL ELSE groundspeed END AS groundspeed,
    CASE WHEN altitude >= 1500 AND altitude < 20000 AND TAS > 500 OR altitude >= 20000 AND (TAS < 350 OR TAS > 550) THEN NULL ELSE TAS END AS TAS,
    CASE WHEN altitude >= 1500 AND altitude < 20000 AND abs(vertical_rate) > 5000 OR altitude >= 20000 AND abs(vertical_rate) > 1000 THEN NULL ELSE vertical_rate END AS vertical_rate FROM tracks),
    g AS (SELECT flight_id, pid, altitude, CASE WHEN groundspeed < 0 OR groundspeed > 750 THEN NULL ELSE groundspeed END AS groundspeed, CASE WHEN TAS > 600 OR TAS < 60 AND altitude > 1500 THEN NULL ELSE TAS END AS TAS,
    CASE WHEN CAS < 0 OR CAS > 420 THEN NULL ELSE CAS END AS CAS, CASE WHEN mach < 0.4 OR mach > 0.9 THEN NULL ELSE mach END AS mach, CASE WHEN abs(vertical_rate) > 8000 THEN NULL ELSE vertical_rate END AS vertical_rate FROM p)
    SELECT flight_id, pid, {d("groundspeed", "groundspeed")}, {d("TAS", "TAS")}, {d("CAS", "CAS")}, {d("mach", "mach")}, {d("vertical_rate", "vertical_rate")}, {d("CASE WHEN mach IS NOT NULL THEN greatest(0.15, least(0.9, mach)) END", "clamped")} FROM g""")
def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracks(spark, sf_dir).withColumns(P.phase_caps()).withColumns(P.global_caps())
    return out.select(*ROW, *[r(c) for c in ("groundspeed", "TAS", "CAS", "mach", "vertical_rate")], r(P.clamp_kinematics(["mach"])["mach"], "clamped"))


@query(f"""WITH {TRACKS}, c AS (SELECT *, sqrt(1.4::DOUBLE * 287.05::DOUBLE * temp_k) AS a FROM tracks), s AS (SELECT *, groundspeed - 5 AS w, CAS * 1.2::DOUBLE AS k, mach * a AS m, coalesce(abs(TAS - mach * a) > 0.08 * a, false) AS off FROM c)
    SELECT flight_id, pid, {d("CASE WHEN altitude < 10000 THEN coalesce(w, k, m) WHEN altitude < 20000 THEN coalesce(k, m, w) ELSE coalesce(m, k, w) END", "chosen")},
    CASE WHEN altitude < 10000 THEN 'wind' WHEN altitude < 20000 THEN CASE WHEN k IS NOT NULL THEN 'cas' WHEN m IS NOT NULL THEN 'mach' ELSE 'wind' END ELSE CASE WHEN m IS NOT NULL THEN 'mach' WHEN k IS NOT NULL THEN 'cas' ELSE 'wind' END END AS source,
    {d("CASE WHEN TAS IS NULL AND (altitude < 500 AND groundspeed < 50 OR groundspeed < 5) THEN greatest(0, least(1.5, groundspeed * 0.514444)) ELSE TAS END", "taxi")}, mach >= 0.4 AND mach <= 0.9 AND mach < CASE WHEN altitude < 10000 THEN 0.5 WHEN altitude < 20000 THEN 0.7 ELSE 0.9 END AS plausible,
    {d("CASE WHEN off THEN NULL ELSE mach END", "mach")}, {d("CASE WHEN abs(groundspeed - TAS) > 200 THEN NULL ELSE groundspeed END", "groundspeed")} FROM s""")
def speed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.sound_speed(F.col("temp_k"))
    value, source = P.choose_speed(F.col("altitude"), F.col("groundspeed") - 5, F.col("CAS") * 1.2, F.col("mach") * a)
    sure = P.consistency(a)
    return tracks(spark, sf_dir).select(*ROW, r(value, "chosen"), source.alias("source"), r(P.taxi_speed(F.col("TAS"), F.col("groundspeed"), F.col("altitude")), "taxi"), P.mach_plausible(F.col("mach"), F.col("altitude")).alias("plausible"), r(sure["mach"], "mach"), r(sure["groundspeed"], "groundspeed"))


@query(f"""SELECT event_id AS pid, hour(ts)::INTEGER AS hour, month(ts)::INTEGER AS month, dayofyear(ts)::INTEGER AS day_of_year, (isodow(ts) - 1)::INTEGER AS weekday, (month(ts) % 12 // 3)::INTEGER AS season, {d("(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0", "day_share")},
    {d("sin(hour(ts) * (2 * pi() / 24))", "hour_sin")}, {d("cos(hour(ts) * (2 * pi() / 24))", "hour_cos")}, {d("sin(month(ts) * (2 * pi() / 12))", "month_sin")}, {d("cos(month(ts) * (2 * pi() / 12))", "month_cos")}, {d("sin(dayofyear(ts) * (2 * pi() / 365.25))", "doy_sin")}, {d("cos(dayofyear(ts) * (2 * pi() / 365.25))", "doy_cos")} FROM events""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.calendar(F.col("ts"))
    whole = ("hour", "month", "day_of_year", "weekday", "season")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("pid"), *[c.cast("int").alias(k) if k in whole else r(c, k) for k, c in out.items()])


@query(f"""SELECT o_orderkey, CASE WHEN p > 0 AND p <= 50 THEN 'low' WHEN p > 50 AND p <= 200 THEN 'mid' WHEN p > 200 AND p <= 100000 THEN 'high' END AS price_bin, CASE WHEN m >= 1 AND m < 4 THEN 'q1' WHEN m >= 4 AND m < 7 THEN 'q2' WHEN m >= 7 AND m < 13 THEN 'h2' END AS season,
    o_orderstatus || '_' || o_orderpriority AS crossed, substring(o_orderpriority, 1, 2) AS pre, {d("ln(p) / greatest(m, 2.0)", "ratio")}, {d("p * p", "p_sq")}, {d("p * p * p", "p_cube")}, {d("CASE WHEN p > 0 THEN ln(p) END", "p_log")}
    FROM (SELECT *, o_totalprice / 1000 AS p, month(o_orderdate) AS m FROM orders)""")
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"p": F.col("o_totalprice") / 1000, "m": F.month("o_orderdate")})
    return o.select("o_orderkey", X.bucket(F.col("p"), [0, 50, 200, 100000], ["low", "mid", "high"]).alias("price_bin"), X.bucket(F.col("m"), [1, 4, 7, 13], ["q1", "q2", "h2"], right=False).alias("season"), X.crossed(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("crossed"), X.prefix(F.col("o_orderpriority"), 2).alias("pre"), r(X.over(F.log("p"), F.col("m"), 2.0), "ratio"), *rs({f"p_{k}": v for k, v in (("sq", F.col("p") * F.col("p")), ("cube", X.nonlinear(F.col("p"), "p")["p_cube"]), ("log", X.nonlinear(F.col("p"), "p")["p_log"]))}))


@query(f"""WITH {TRACKS}, {FLIGHTS}, j AS (SELECT t.*, f.tow, f.typ, f.oew, f.mtow, lag(altitude) {OVER} AS h1, lag(groundspeed) {OVER} AS g1, t - lag(t) {OVER} AS dt FROM tracks t JOIN flights f USING (flight_id)),
    e AS (SELECT *, tow * 9.80665::DOUBLE * (altitude - h1) * 0.3048::DOUBLE / 1e6 AS pe, 0.5 * tow * (pow(groundspeed * 0.514444::DOUBLE, 2) - pow(g1 * 0.514444::DOUBLE, 2)) / 1e6 AS ke FROM j)
    SELECT flight_id, pid, {d("TAS - CAS", "s_diff")}, {d("TAS / nullif(CAS, 0)", "s_ratio")}, {d("CASE WHEN CAS > 0 THEN (TAS - CAS) / CAS * 100 END", "s_pct")}, {d("exp(-abs(TAS - CAS) / 100)", "s_agree")}, {d("pe + ke", "d_energy")}, {d("(pe + ke) / nullif(dt::DOUBLE, 0)", "power")},
    {d("CASE WHEN typ IN ('T1', 'T2') THEN flow ELSE coalesce(flow * CASE WHEN pid % 3 = 0 THEN NULL ELSE 1.1 END, flow) END", "fuel")}, {d("greatest(mtow - oew, 1)", "mass_above_oew")} FROM e""")
def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = tracks(spark, sf_dir).join(flights(spark, sf_dir), "flight_id")
    j = j.withColumns({"h1": F.lag("altitude").over(by_time()), "g1": F.lag("groundspeed").over(by_time()), "dt": F.col("t") - F.lag("t").over(by_time())})
    e = X.energy(F.col("tow"), F.col("h1") * A.FOOT, F.col("altitude") * A.FOOT, F.col("g1") * A.KNOT, F.col("groundspeed") * A.KNOT, F.col("dt").cast("double"))
    c = X.compared(F.col("TAS"), F.col("CAS"), "s")
    m = X.physics_interactions(F.col("mtow"), F.col("oew"), F.lit(1.0), F.lit(1.0), F.lit(0.0))
    fuel = X.select_by_type(F.col("typ"), ["T1", "T2"], F.col("flow"), F.col("flow") * F.when(F.col("pid") % 3 != 0, 1.1))
    return j.select(*ROW, *rs({k: c[k] for k in ("s_diff", "s_ratio", "s_pct", "s_agree")} | {"d_energy": e["d_energy"], "power": e["power"], "fuel": fuel, "mass_above_oew": m["mass_above_oew"]}))


# ---------------------------------------------------------------- filters and sets


@query(f"""WITH {TRACKS}, n AS (SELECT *, count(*) OVER (PARTITION BY flight_id) AS c FROM tracks WHERE altitude IS NOT NULL), {FLIGHTS},
    z AS (SELECT flight_id, altitude, avg(altitude) OVER (PARTITION BY flight_id) AS m, stddev_samp(altitude) OVER (PARTITION BY flight_id) AS s FROM n WHERE c >= 10 AND flight_id IN (SELECT flight_id FROM flights WHERE typ <> 'T3') AND flight_id NOT IN (SELECT flight_id FROM flights WHERE origin = 1))
    SELECT flight_id, {d("avg(CASE WHEN abs(altitude - m) <= 1.5 * s THEN altitude END)", "trimmed")}, count(*) AS n FROM z GROUP BY flight_id""")
def filtered_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flights(spark, sf_dir)
    kept = series.enough_rows(tracks(spark, sf_dir).dropna(subset=["altitude"]), "flight_id", 10)
    kept = kept.join(f.where("typ <> 'T3'"), "flight_id", "left_semi").join(f.where("origin = 1"), "flight_id", "left_anti")
    whole = Window.partitionBy("flight_id")
    z = kept.withColumns({"m": F.avg("altitude").over(whole), "s": F.stddev_samp("altitude").over(whole)})
    return z.groupBy("flight_id").agg(r(F.avg(S.only(F.abs(F.col("altitude") - F.col("m")) <= 1.5 * F.col("s"), F.col("altitude"))), "trimmed"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TRACKS} SELECT "column", n_null, {d("n_null / n", "share")} FROM (SELECT count(*) AS n, count(*) - count(altitude) AS altitude, count(*) - count(mach) AS mach, count(*) - count(TAS) AS TAS, count(*) - count(flow) AS flow FROM tracks) UNPIVOT (n_null FOR "column" IN (altitude, mach, TAS, flow))""")
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imputation.profile(tracks(spark, sf_dir), ["altitude", "mach", "TAS", "flow"]).select("column", "n_null", r("share"))


@query(f"""WITH {TRACKS}, u AS (SELECT flight_id, t // 3600 AS hour, pid FROM tracks UNION ALL SELECT flight_id, t // 3600 AS hour, pid + 1 FROM tracks WHERE pid % 2 = 0)
    SELECT flight_id, hour, min(pid) AS pid, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS both_sets, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_left FROM u GROUP BY flight_id, hour""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select("flight_id", F.expr("t div 3600").alias("hour"), "pid")
    first = series.dedupe_first(t.unionByName(t.where("pid % 2 = 0").withColumn("pid", F.col("pid") + 1)), ["flight_id", "hour"], "pid")
    a, b = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey")
    counts = a.intersect(b).agg(F.count(F.lit(1)).alias("both_sets")).crossJoin(a.exceptAll(b).distinct().agg(F.count(F.lit(1)).alias("only_left")))
    return first.crossJoin(F.broadcast(counts))


# ---------------------------------------------------------------- windows


@query(f"""WITH {TRACKS} SELECT flight_id, pid, {d(f"altitude - lag(altitude) {OVER}", "d_altitude")}, {d(f"(groundspeed - lag(groundspeed) {OVER}) / nullif((us - lag(us) {OVER})::DOUBLE, 0) * 1e6", "accel")},
    {d("avg(altitude) OVER (PARTITION BY flight_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)", "trail")}, {d("coalesce(avg(altitude) OVER (PARTITION BY flight_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 86399999999 FOLLOWING), altitude)", "ahead")},
    {d(f"coalesce(sum(flow) {OVER}, 0)", "cum_flow")}, {d(f"coalesce(max(altitude) {OVER}, 0)", "cum_max")},
    {d("avg(groundspeed) OVER (PARTITION BY flight_id ORDER BY us ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "roll_mean")}, {d("stddev_samp(groundspeed) OVER (PARTITION BY flight_id ORDER BY us ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "roll_std")},
    {d(f"CASE WHEN lag(groundspeed) {OVER} IS NOT NULL THEN groundspeed / (lag(groundspeed) {OVER} + 1e-6) END", "g_lag_ratio")}, {d(f"groundspeed - lead(groundspeed) {OVER}", "g_lead_diff")} FROM tracks""")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("groundspeed")
    n, c = series.neighbours(g, by_time(), "g"), series.centred(g, by_time())
    return tracks(spark, sf_dir).select(*ROW, *rs({
        "d_altitude": series.change(F.col("altitude"), by_time()), "accel": series.rate(g, F.col("us"), by_time()) * 1e6, "trail": series.trailing_mean(F.col("altitude"), "flight_id", "us", 86400), "ahead": series.forward_mean(F.col("altitude"), "flight_id", "us", 86400),
        "cum_flow": series.running(F.col("flow"), by_time()), "cum_max": series.running(F.col("altitude"), by_time(), "max"), "roll_mean": c["roll_mean"], "roll_std": c["roll_std"], "g_lag_ratio": n["g_lag_ratio"], "g_lead_diff": n["g_lead_diff"],
    }))


_IP = """i AS (SELECT *, row_number() OVER w AS n FROM tracks WINDOW w AS (PARTITION BY flight_id ORDER BY us)),
    j AS (SELECT *, last_value(mach IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN mach IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pi, first_value(mach IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN mach IS NOT NULL THEN n END IGNORE NULLS) OVER a AS ni FROM i
    WINDOW b AS (PARTITION BY flight_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY flight_id ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"""WITH {TRACKS}, {_IP} SELECT flight_id, pid, {d("CASE WHEN mach IS NOT NULL THEN mach WHEN n - pi <= 1 OR ni - n <= 1 THEN coalesce(pv + (nv - pv) * (n - pi) / nullif((ni - pi)::DOUBLE, 0), pv, nv) END", "both_ways")}, {d("CASE WHEN mach IS NOT NULL THEN mach WHEN n - pi <= 30 THEN pv + (nv - pv) * (n - pi) / nullif((ni - pi)::DOUBLE, 0) END", "inside")} FROM j""")
def interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select("flight_id", "us", "pid", F.col("mach").alias("both_ways"), F.col("mach").alias("inside"))
    out = series.interpolate(t, "flight_id", "us", ["both_ways"], 1)
    return series.interpolate(out, "flight_id", "us", ["inside"], 30, inside=True).select(*ROW, r("both_ways"), r("inside"))


@query(f"""WITH {TRACKS}, s AS (SELECT flight_id, t, us, coalesce(abs(vertical_rate) < 1500, false) AS c FROM tracks), k AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY us) - row_number() OVER (PARTITION BY flight_id, c ORDER BY us) AS g FROM s),
    e AS (SELECT flight_id, max(t) - min(t) AS x FROM k WHERE c GROUP BY flight_id, g) SELECT flight_id, count(*) AS n_runs, sum(x)::BIGINT AS total_s, max(x) AS longest_s FROM e WHERE x > 30 GROUP BY flight_id""")
def level_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.runs(tracks(spark, sf_dir), "flight_id", "us", F.abs("vertical_rate") < 1500, F.col("t"), 30)


@query(f"""WITH {TRACKS}, g AS (SELECT flight_id, t AS gap_end, lag(t) OVER (PARTITION BY flight_id ORDER BY t) AS gap_start FROM tracks) SELECT flight_id, gap_end, gap_start, gap_end - gap_start AS gap_s FROM g WHERE gap_end - gap_start > 30 AND gap_end - gap_start <= 28800""")
def track_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gaps(tracks(spark, sf_dir), "flight_id", "t", 30, 28800)


# ---------------------------------------------------------------- aggregates and joins of points to intervals

_IN = f"{INTERVALS}, p AS (SELECT i.idx, i.i_start, i.i_end, t.* FROM tracks t JOIN intervals i ON t.flight_id = i.flight_id AND t.t BETWEEN i.i_start AND i.i_end)"


def _inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.points_in_intervals(tracks(spark, sf_dir), intervals(spark, sf_dir), "flight_id", "t", "i_start", "i_end", bucket=86_400)


def _summary_sql(c: str, name: str) -> str:
    return ", ".join([d(f"min({c})", f"{name}_min"), d(f"max({c})", f"{name}_max"), d(f"avg({c})", f"{name}_mean"), d(f"median({c})", f"{name}_median"), d(f"stddev_samp({c})", f"{name}_std"), d(f"quantile_cont({c}, 0.1)", f"{name}_p10"), d(f"quantile_cont({c}, 0.9)", f"{name}_p90"), d(f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", f"{name}_iqr")])


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keys or t != "double" else r(c) for c, t in df.dtypes])


@query(f"""WITH {_IN}, a AS (SELECT idx, count(*) AS n, {_summary_sql("altitude", "alt")}, {_summary_sql("groundspeed", "gs")}, {d("arg_min(groundspeed, us)", "gs_first")}, {d("arg_max(groundspeed, us)", "gs_last")}, {d("avg((groundspeed < 250)::INT)", "slow_share")}, {d("avg(coalesce(altitude < 10000, false)::INT)", "low_share")},
    {d("stddev_samp(groundspeed) / abs(avg(groundspeed))", "gs_cv")}, {d("coalesce(max(CASE WHEN vertical_rate < 0 THEN vertical_rate END), 0)", "max_descent")}, {d("stddev_pop(u)", "u_std")} FROM p GROUP BY idx)
    SELECT i.idx, coalesce(a.n, 0) AS n, a.* EXCLUDE (idx, n) FROM intervals i LEFT JOIN a USING (idx)""")
def interval_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every interval with the statistics of the points in it; empty intervals stay."""
    g, v = F.col("groundspeed"), F.col("vertical_rate")
    stats = _inside(spark, sf_dir).groupBy("idx").agg(
        F.count(F.lit(1)).alias("_n"), *S.summary(F.col("altitude"), "alt"), *S.summary(g, "gs"), S.first_by(g, F.col("us")).alias("gs_first"), S.last_by(g, F.col("us")).alias("gs_last"), S.share(g < 250).alias("slow_share"), S.share(F.col("altitude") < 10000).alias("low_share"),
        S.variation(g).alias("gs_cv"), F.coalesce(F.max(S.only(v < 0, v)), F.lit(0.0)).alias("max_descent"), F.stddev_pop("u").alias("u_std"),
    )
    out = intervals(spark, sf_dir).select("idx").join(stats, "idx", "left").withColumn("n", F.coalesce("_n", F.lit(0)).cast("long"))
    return _rounded(out.select("idx", "n", *[c for c in stats.columns if c not in ("idx", "_n")]), ["idx", "n"])


@query(f"""WITH {TRACKS} SELECT flight_id, {d("skewness(groundspeed)", "skew")}, {d("kurtosis(groundspeed)", "kurt")}, {", ".join(d(f"quantile_cont(groundspeed, {q / 100})", f"p{q:02d}") for q in (5, 25, 50, 75, 95))}, {d("CASE WHEN stddev_pop(altitude) = 0 OR stddev_pop(t) = 0 THEN 0 ELSE regr_slope(altitude, t) END", "climb_slope")} FROM tracks GROUP BY flight_id""")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("groundspeed")
    out = tracks(spark, sf_dir).groupBy("flight_id").agg(S.skew(g).alias("skew"), S.kurtosis(g).alias("kurt"), *[S.quantile(g, q / 100).alias(f"p{q:02d}") for q in (5, 25, 50, 75, 95)], S.slope(F.col("altitude"), F.col("t").cast("double")).alias("climb_slope"))
    return _rounded(out, ["flight_id"])


@query(f"""WITH {TRACKS}, c AS (SELECT *, {_PHASE} AS phase FROM tracks) SELECT flight_id, {", ".join(f"count(*) FILTER (phase = '{p}') AS n_{p}, {d(f"avg(groundspeed) FILTER (phase = '{p}')", f"gs_{p}")}, {d(f"avg((phase = '{p}')::INT)", f"share_{p}")}" for p in ("climb", "cruise", "descent", "ground"))},
    CASE greatest(avg((phase = 'climb')::INT), avg((phase = 'cruise')::INT), avg((phase = 'descent')::INT), avg((phase = 'ground')::INT)) WHEN avg((phase = 'climb')::INT) THEN 'climb' WHEN avg((phase = 'cruise')::INT) THEN 'cruise' WHEN avg((phase = 'descent')::INT) THEN 'descent' ELSE 'ground' END AS mode FROM c GROUP BY flight_id""")
def phase_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["climb", "cruise", "descent", "ground"]
    c = tracks(spark, sf_dir).withColumn("phase", P.flight_phase(F.col("vertical_rate"), F.col("altitude")))
    out = c.groupBy("flight_id").agg(*[x for p in names for x in (F.count(S.only(F.col("phase") == p, F.lit(1))).alias(f"n_{p}"), F.avg(S.only(F.col("phase") == p, F.col("groundspeed"))).alias(f"gs_{p}"), S.share(F.col("phase") == p).alias(f"share_{p}"))])
    top = F.greatest(*[F.col(f"share_{p}") for p in names])
    mode = F.coalesce(*[F.when(F.col(f"share_{p}") == top, p) for p in names])
    return _rounded(out.withColumn("mode", mode), ["flight_id"])


@query(f"""WITH {_IN}, a AS (SELECT *, (flow + lag(flow) OVER w) / 2 * (t - lag(t) OVER w) / 3600.0 AS s FROM p WINDOW w AS (PARTITION BY idx ORDER BY t)) SELECT idx, {d("CASE WHEN count(flow) < count(*) OR count(*) < 2 THEN 0 ELSE greatest(coalesce(sum(s), 0), 0) END", "kg")} FROM a GROUP BY idx""")
def fuel_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return physics.trapezoid(_inside(spark, sf_dir), ["idx"], "t", "flow", "us").select("idx", r("kg"))


@query(f"""WITH {TRACKS}, s AS (SELECT *, lag(track) {OVER} AS k1, lag(altitude) {OVER} AS h1, t - lag(t) {OVER} AS dt, lag(groundspeed) {OVER} AS g1, {_PHASE} AS phase FROM tracks), c AS (SELECT *, ((track - k1 + 180) % 360 + 360) % 360 - 180 AS turn, lag(phase) {OVER} AS ph1 FROM s)
    SELECT flight_id, {d("sum(abs(turn))", "turned")}, count(*) FILTER (abs(turn) > 25) AS n_turns, {d("coalesce(sum(turn) FILTER (turn < 0), 0)", "left_turn")}, {d("coalesce(sum(turn) FILTER (turn > 0), 0)", "right_turn")}, {d("sum(groundspeed * dt / 3600.0)", "distance_nm")},
    {d("coalesce(sum(altitude - h1) FILTER (altitude > h1), 0)", "climbed")}, {d("coalesce(sum(h1 - altitude) FILTER (altitude < h1), 0)", "descended")}, count(*) FILTER (phase <> ph1) AS n_changes, {d("corr(groundspeed, g1)", "autocorr")} FROM c GROUP BY flight_id""")
def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tracks(spark, sf_dir).withColumn("phase", P.flight_phase(F.col("vertical_rate"), F.col("altitude")))
    s = s.withColumns({"turn": G.signed_turn(F.lag("track").over(by_time()), F.col("track")), "dh": series.change(F.col("altitude"), by_time()), "dt": series.change(F.col("t"), by_time()), "g1": F.lag("groundspeed").over(by_time()), "ph1": F.lag("phase").over(by_time())})
    turn, dh, zero = F.col("turn"), F.col("dh"), F.lit(0.0)
    out = s.groupBy("flight_id").agg(
        F.sum(F.abs(turn)).alias("turned"), F.count(S.only(F.abs(turn) > 25, turn)).alias("n_turns"), F.coalesce(F.sum(S.only(turn < 0, turn)), zero).alias("left_turn"), F.coalesce(F.sum(S.only(turn > 0, turn)), zero).alias("right_turn"), F.sum(F.col("groundspeed") * F.col("dt") / 3600).alias("distance_nm"),
        F.coalesce(F.sum(S.only(dh > 0, dh)), zero).alias("climbed"), F.coalesce(F.sum(S.only(dh < 0, -dh)), zero).alias("descended"), F.count(S.only(F.col("phase") != F.col("ph1"), F.lit(1))).alias("n_changes"), S.correlation(F.col("groundspeed"), F.col("g1")).alias("autocorr"),
    )
    return _rounded(out, ["flight_id"])


@query(f"""WITH {TRACKS}, n AS (SELECT *, row_number() {OVER} - 1 AS i, count(*) OVER (PARTITION BY flight_id) AS c FROM tracks)
    SELECT flight_id, {", ".join(f"count(*) FILTER (altitude >= {lo} AND altitude < {lo + 10000}) AS n_{lo}, {d(f"avg(groundspeed) FILTER (altitude >= {lo} AND altitude < {lo + 10000})", f"gs_{lo}")}" for lo in (0, 10000, 20000, 30000))}, {d("avg(groundspeed) FILTER (i >= c * 20 // 100 AND i < c * 40 // 100)", "gs_rows_20_40")} FROM n GROUP BY flight_id""")
def altitude_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tracks(spark, sf_dir).withColumns({"i": F.row_number().over(by_time()) - 1, "c": F.count(F.lit(1)).over(Window.partitionBy("flight_id"))})
    h, g = F.col("altitude"), F.col("groundspeed")
    aggs = [x for lo in (0, 10000, 20000, 30000) for x in (F.count(S.only((h >= lo) & (h < lo + 10000), F.lit(1))).alias(f"n_{lo}"), F.avg(S.only((h >= lo) & (h < lo + 10000), g)).alias(f"gs_{lo}"))]
    rows = F.expr("i >= c * 20 div 100 and i < c * 40 div 100")
    return _rounded(n.groupBy("flight_id").agg(*aggs, F.avg(S.only(rows, g)).alias("gs_rows_20_40")), ["flight_id"])


# ---------------------------------------------------------------- joins


@query(f"""WITH {FLIGHTS}, a AS (SELECT n_nationkey AS code, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT f.flight_id, f.typ, o.name AS origin_name, o.region AS origin_region, d.name AS destination_name, d.region AS destination_region FROM flights f LEFT JOIN a o ON f.origin = o.code LEFT JOIN a d ON f.destination = d.code""")
def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, g = (spark.read.parquet(f"{sf_dir}/{k}.parquet") for k in ("nation", "region"))
    a = joins.dimension(n.withColumnRenamed("n_regionkey", "r_regionkey"), g, "r_regionkey", "r_name", ["r_name"]).select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    return joins.two_ended(flights(spark, sf_dir), a, "code", {"origin": "origin", "destination": "destination"}, ["name", "region"]).select("flight_id", "typ", "origin_name", "origin_region", "destination_name", "destination_region")


@query(f"""WITH {TRACKS}, l AS (SELECT flight_id, pid, t FROM tracks WHERE pid % 2 = 0), k AS (SELECT flight_id, pid AS report, t AS valid, temp_k FROM tracks WHERE pid % 2 = 1)
    SELECT l.flight_id, l.pid, k.report, {d("k.temp_k", "temp_k")}, abs(k.valid - l.t) AS apart FROM l LEFT JOIN k ON l.flight_id = k.flight_id AND abs(k.valid - l.t) <= 7200 QUALIFY row_number() OVER (PARTITION BY l.pid ORDER BY abs(k.valid - l.t), k.report) = 1""")
def nearest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    reports = t.where("pid % 2 = 1").select("flight_id", F.col("pid").alias("report"), F.col("t").alias("valid"), "temp_k")
    out = joins.nearest_in_time(t.where("pid % 2 = 0").select("flight_id", "pid", "t"), reports, "flight_id", "t", "valid", 7200, ["pid"], "report")
    return out.select("flight_id", "pid", "report", r("temp_k"), F.abs(F.col("valid") - F.col("t")).alias("apart"))


_LEVELS = (200, 300, 500, 700, 850, 1000)


@query(f"""WITH {TRACKS}, q AS (SELECT pid, round(latitude)::BIGINT AS la, round(longitude)::BIGINT % 360 AS lo, t // 3600 % 24 AS hour, 150 + pid % 900 + 0.5 AS p FROM tracks), g AS (SELECT pid, p, level, la + lo / 10.0 + hour + level / 100.0 AS val FROM q, (VALUES {", ".join(f"({x})" for x in _LEVELS)}) v(level) WHERE (la + lo) % 7 <> 0),
    b AS (SELECT pid, p, max(level) FILTER (level <= p) AS l0, min(level) FILTER (level >= p) AS l1, arg_max(val, level) FILTER (level <= p) AS v0, arg_min(val, level) FILTER (level >= p) AS v1 FROM g GROUP BY pid, p)
    SELECT q.pid, {d("coalesce(v0 + (v1 - v0) * (ln(q.p) - ln(l0)) / nullif(ln(l1) - ln(l0), 0), v0, v1)", "val")} FROM q LEFT JOIN b USING (pid)""")
def grid_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up grid of 1 degree with six levels; cells whose indices sum to a multiple of 7 are missing."""
    t = tracks(spark, sf_dir).select("pid", "latitude", "longitude", F.expr("t div 3600 % 24").alias("hour"), (150 + F.col("pid") % 900 + 0.5).alias("p"))
    cells = spark.range(40, 51).select(F.col("id").alias("lat_i")).crossJoin(spark.range(5, 16).select(F.col("id").alias("lon_i"))).crossJoin(spark.range(24).select(F.col("id").alias("hour"))).where("(lat_i + lon_i) % 7 <> 0")
    long = cells.withColumn("level", F.explode(F.array(*[F.lit(x) for x in _LEVELS]))).withColumn("val", F.col("lat_i") + F.col("lon_i") / 10 + F.col("hour") + F.col("level") / 100)
    from .sources.tables import grid_table

    return joins.grid_nearest(t, grid_table(long), "latitude", "longitude", 1.0, ["hour"]).select("pid", r(joins.log_pressure(F.col("levels"), F.col("p")), "val"))


@query(f"""WITH c AS (SELECT c_custkey AS k, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer), s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM c WHERE k % 10 <> 0),
    z AS (SELECT k, (x - mx) / sx AS a, (y - my) / sy AS b, x * 2 + y AS v FROM c, s), r AS (SELECT m.k, n.v FROM z m, z n WHERE m.k % 10 = 0 AND n.k % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY m.k ORDER BY sqrt(pow(m.a - n.a, 2) + pow(m.b - n.b, 2)), n.k) <= 5) SELECT k, {d("avg(v)", "v")} FROM r GROUP BY k""")
def nearest_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    known = c.where("k % 10 <> 0").withColumn("v", F.col("x") * 2 + F.col("y"))
    return nearest.k_nearest_mean(c.where("k % 10 = 0"), known, "k", ["x", "y"], "v").select("k", r("v"))


@query(f"""WITH p AS (SELECT o_orderkey AS idx, o_totalprice - 100 AS fuel_kg FROM orders WHERE o_orderkey % 3 <> 0) SELECT o_orderkey AS idx, {d("greatest(coalesce(p.fuel_kg, (SELECT median(fuel_kg) FROM p)), 0)", "fuel_kg")} FROM orders LEFT JOIN p ON o_orderkey = p.idx""")
def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") - 100).alias("fuel_kg"))
    return joins.submission(o.select(F.col("o_orderkey").alias("idx"), F.lit(0.0).alias("fuel_kg")), p, "idx", "fuel_kg").select("idx", r("fuel_kg"))


# ---------------------------------------------------------------- trajectories

_SEG = f"{INTERVALS}, seg AS (SELECT idx, flight_id, s AS seg, i_start + s * ((i_end - i_start) / 20.0::DOUBLE) AS a, i_start + (s + 1) * ((i_end - i_start) / 20.0::DOUBLE) AS b FROM intervals, range(20) g(s)), l AS (SELECT g.idx, g.seg, avg(t.groundspeed) AS gs, avg(t.altitude) AS alt, count(*) AS n FROM seg g JOIN tracks t ON g.flight_id = t.flight_id AND t.t >= g.a AND t.t <= g.b GROUP BY g.idx, g.seg)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = trajectory.segments(intervals(spark, sf_dir), "i_start", "i_end")
    return joins.points_in_intervals(tracks(spark, sf_dir), seg, "flight_id", "t", "seg_start", "seg_end", bucket=86_400).groupBy("idx", "seg").agg(F.avg("groundspeed").alias("gs"), F.avg("altitude").alias("alt"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SEG} SELECT idx, {', '.join(d(f'max(CASE WHEN seg = {s} THEN gs END)', f'seg{s:02d}_gs') for s in range(20))} FROM l GROUP BY idx")
def segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trajectory.pivot_segments(_segments(spark, sf_dir), ["idx"], ["gs"]), ["idx"])


@query(f"""WITH {_SEG} SELECT idx, {d("stddev_pop(gs)", "gs_seg_std")}, {d("max(gs) - min(gs)", "gs_seg_range")}, {d("sum(gs) FILTER (seg < 10) / sum(gs)", "gs_first_half")}, {d("sum(gs) FILTER (seg >= 10) / sum(gs)", "gs_last_half")}, {d("sum(gs * (seg + 1)) / sum(gs)", "gs_centre")}, {d("regr_slope(gs, seg)", "gs_slope")} FROM l GROUP BY idx""")
def segment_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trajectory.between_segments(_segments(spark, sf_dir), "idx", "gs").drop("gs_peak"), ["idx"])


@query(f"""WITH {INTERVALS} SELECT idx, {d("(i_start - a) / nullif((b - a)::DOUBLE, 0)", "pos_start")}, {d("(i_end - a) / nullif((b - a)::DOUBLE, 0)", "pos_end")}, {d("((i_start + i_end) / 2 - a) / nullif((b - a)::DOUBLE, 0)", "pos_mid")}, i_start - a AS since_takeoff, b - i_end AS to_landing FROM intervals JOIN spans USING (flight_id)""")
def flight_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = tracks(spark, sf_dir).groupBy("flight_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    c = trajectory.position_in_flight(F.col("i_start"), F.col("i_end"), F.col("a"), F.col("b"))
    return intervals(spark, sf_dir).join(spans, "flight_id").select("idx", *rs({k: c[k] for k in ("pos_start", "pos_end", "pos_mid")}), c["since_takeoff"].alias("since_takeoff"), c["to_landing"].alias("to_landing"))


@query(f"""WITH {TRACKS}, k AS (SELECT flight_id, t // 3600 AS slot, arg_max(altitude, t) FILTER (altitude IS NOT NULL) AS altitude FROM tracks GROUP BY ALL), g AS (SELECT flight_id, unnest(range(min(slot), max(slot) + 1)) AS slot FROM k GROUP BY flight_id),
    f AS (SELECT g.*, k.altitude FROM g LEFT JOIN k USING (flight_id, slot)), i AS (SELECT *, last_value(altitude IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN altitude IS NOT NULL THEN slot END IGNORE NULLS) OVER b AS pi, first_value(altitude IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN altitude IS NOT NULL THEN slot END IGNORE NULLS) OVER a AS ni FROM f WINDOW b AS (PARTITION BY flight_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY flight_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT flight_id, slot * 3600 AS t, {d("CASE WHEN altitude IS NOT NULL THEN altitude WHEN slot - pi <= 12 THEN pv + (nv - pv) * (slot - pi) / nullif((ni - pi)::DOUBLE, 0) END", "altitude")} FROM i""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks on a grid of one hour (the readings of these tables lie hours apart)."""
    return series.resample(tracks(spark, sf_dir), "flight_id", "t", ["altitude"], step=3600, limit=12, first="us").select("flight_id", "t", r("altitude"))


_HOLES = f"""{TRACKS}, w AS (SELECT flight_id, lag(t) OVER o AS t0, t AS t1, min(t) OVER f AS fs, max(t) OVER f AS fe, {", ".join(f"lag({c}) OVER o AS a_{c}, {c} AS b_{c}" for c in ("latitude", "longitude", "altitude", "track", "mach", "CAS", "TAS", "groundspeed"))} FROM tracks WINDOW o AS (PARTITION BY flight_id ORDER BY t), f AS (PARTITION BY flight_id)),
    g AS (SELECT *, (t0 - fs) / nullif((fe - fs)::DOUBLE, 0) AS place, b_altitude - a_altitude AS dh, t1 - t0 - 1 AS n FROM w WHERE t1 - t0 > 30 AND t1 - t0 <= 3600),
    k AS (SELECT *, CASE WHEN (a_altitude + b_altitude) / 2 >= 26000 AND abs(dh) < 1000 OR abs(dh) = 300 THEN 'cruise' WHEN dh < -300 THEN 'descent' WHEN dh > 300 THEN 'climb' WHEN place < 0.3 THEN 'climb' WHEN place > 0.7 THEN 'descent' ELSE 'cruise' END AS phase,
        2 * asin(sqrt(least(1.0, pow(sin((radians(b_latitude) - radians(a_latitude)) / 2), 2) + cos(radians(a_latitude)) * cos(radians(b_latitude)) * pow(sin(radians(b_longitude - a_longitude) / 2), 2)))) AS dd FROM g),
    e AS (SELECT *, unnest(range(t0 + 1, t1)) AS t FROM k), fr AS (SELECT *, t - t0 AS i, CASE WHEN phase = 'cruise' THEN (t - t0) / (n + 1)::DOUBLE ELSE (t - t0 - 1) / greatest(n - 1, 1)::DOUBLE END AS f FROM e),
    q AS (SELECT *, a_altitude + dh * f AS alt, (a_altitude + dh * f) * 0.3048::DOUBLE AS h, sin((1 - f) * dd) AS wa, sin(f * dd) AS wb, radians(a_latitude) AS p1, radians(b_latitude) AS p2, radians(a_longitude) AS l1, radians(b_longitude) AS l2, dh / (t1 - t0) * 60.0 AS rate FROM fr),
    xyz AS (SELECT *, wa * cos(p1) * cos(l1) + wb * cos(p2) * cos(l2) AS x, wa * cos(p1) * sin(l1) + wb * cos(p2) * sin(l2) AS y, wa * sin(p1) + wb * sin(p2) AS z, abs(a_latitude - b_latitude) < 1e-4 AND abs(a_longitude - b_longitude) < 1e-4 AS near,
        CASE WHEN phase = 'cruise' THEN (coalesce(a_mach, b_mach) + coalesce(b_mach, a_mach)) / 2 * sqrt(1.4::DOUBLE * 287.05::DOUBLE * ({_ISA_T})) / 0.514444::DOUBLE ELSE (coalesce(a_CAS, b_CAS) + coalesce(b_CAS, a_CAS)) / 2 / sqrt(greatest(({_ISA_P}) / 101325.0, 0.1)) END AS speed FROM q)"""


@query(f"""WITH {_HOLES} SELECT flight_id, t, phase, {d("CASE WHEN near THEN a_latitude ELSE degrees(atan2(z, sqrt(x * x + y * y))) END", "latitude")}, {d("CASE WHEN near THEN a_longitude ELSE degrees(atan2(y, x)) END", "longitude")}, {d("alt", "altitude")},
    {d("((a_track + (((b_track - a_track + 180) % 360 + 360) % 360 - 180) * f) % 360 + 360) % 360", "track")}, {d("CASE WHEN phase = 'cruise' THEN 0 WHEN rate IS NULL THEN NULL WHEN phase = 'climb' THEN greatest(393.7, least(2362.2, rate)) ELSE greatest(-2362.2, least(-393.7, rate)) END", "vertical_rate")},
    {d("coalesce(CASE WHEN n < 10 THEN speed WHEN i <= 5 THEN a_TAS * (1 - (i - 1) / 5.0::DOUBLE) + speed * ((i - 1) / 5.0::DOUBLE) WHEN i > n - 5 THEN speed * (1 - (i - 1 - (n - 5)) / 5.0::DOUBLE) + b_TAS * ((i - 1 - (n - 5)) / 5.0::DOUBLE) ELSE speed END, speed)", "TAS")}, {d("a_groundspeed + (b_groundspeed - a_groundspeed) * f", "groundspeed")}, true AS is_reconstructed FROM xyz""")
def synthesized_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes of up to an hour filled second by second."""
    holes = trajectory.ends_of_gaps(tracks(spark, sf_dir), "flight_id", "t", ["latitude", "longitude", "altitude", "track", "mach", "CAS", "TAS", "groundspeed"], 30, 3600, "us")
    return _rounded(trajectory.synthesize(holes, "flight_id", "t"), ["flight_id", "t", "phase", "is_reconstructed"])


@query()
def smoothed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sigma-median filter, Gaussian means at holes, then the Kalman smoother."""
    t = trajectory.sigma_filter(tracks(spark, sf_dir).select("flight_id", "pid", "us", "t", "altitude", "groundspeed", "track"), "flight_id", "us", ["altitude", "groundspeed"])
    t = trajectory.smooth_at_gaps(t, "flight_id", "t", {"groundspeed": 10.0, "track": 2.0})
    return trajectory.kalman(t, "flight_id", "t", ["altitude", "groundspeed"])


# ---------------------------------------------------------------- mass and fuel


@query(f"""WITH {TRACKS}, {FLIGHTS}, s AS (SELECT t.flight_id, pid, us, tow, coalesce(lag(coalesce(flow, 0)) {OVER} * (t - lag(t) {OVER}) / 3600.0, 0) AS step, oew, mtow FROM tracks t JOIN flights USING (flight_id)), b AS (SELECT *, sum(step) OVER (PARTITION BY flight_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS burnt FROM s)
    SELECT flight_id, pid, {d("burnt", "burnt")}, {d("greatest(tow - burnt, 0.5 * tow)", "mass")}, tow >= oew AND tow <= mtow AS valid, {d("greatest(oew, least(mtow, tow))", "clipped")} FROM b""")
def mass_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).join(flights(spark, sf_dir), "flight_id").withColumns({"dt": F.coalesce(series.change(F.col("t"), by_time()), F.lit(0)), "flow": F.coalesce("flow", F.lit(0.0))})
    b = physics.with_burn(t, "flight_id", "us", "flow", "dt")
    return b.select(*ROW, r("burnt"), r(physics.clamp_mass(F.col("tow"), F.col("burnt")), "mass"), physics.valid_tow(F.col("tow"), F.col("oew"), F.col("mtow")).alias("valid"), r(physics.clip_tow(F.col("tow"), F.col("oew"), F.col("mtow")), "clipped"))


@query(f"""WITH RECURSIVE {TRACKS}, {FLIGHTS}, s AS (SELECT t.flight_id, pid, us, tow, groundspeed, (t - lag(t) {OVER})::DOUBLE AS dt, row_number() {OVER} AS n FROM tracks t JOIN flights USING (flight_id)),
    m AS (SELECT flight_id, pid, n, tow, tow AS mass, tow * 0.00001::DOUBLE * groundspeed AS flow FROM s WHERE n = 1 UNION ALL SELECT s.flight_id, s.pid, s.n, s.tow, greatest(m.mass - m.flow * s.dt / 3600, 0.5 * s.tow), greatest(m.mass - m.flow * s.dt / 3600, 0.5 * s.tow) * 0.00001::DOUBLE * s.groundspeed FROM m JOIN s ON s.flight_id = m.flight_id AND s.n = m.n + 1)
    SELECT flight_id, pid, {d("mass", "mass")}, {d("flow", "flow")} FROM m""")
def mass_with_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).join(flights(spark, sf_dir).select("flight_id", "tow"), "flight_id").withColumn("dt", series.change(F.col("t"), by_time()).cast("double"))
    out = physics.mass_recursion(t, "flight_id", "us", "tow", lambda m, p: m * 0.00001 * p["groundspeed"], ["groundspeed", "pid"], "dt")
    return out.join(t.select("flight_id", "us", "pid"), ["flight_id", "us"]).select(*ROW, r("mass"), r("flow"))


# ---------------------------------------------------------------- imputation


@query(f"""WITH {TRACKS}, {FLIGHTS}, b AS (SELECT t.pid, f.typ, t.pid % 10 AS pos, t.TAS AS v, t.groundspeed AS w FROM tracks t JOIN flights f USING (flight_id)), lim AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM b),
    g1 AS (SELECT typ, pos, sum(greatest(least(v, hi), lo) * w) / sum(w) AS m FROM b, lim WHERE v IS NOT NULL GROUP BY typ, pos HAVING count(v) >= 5), g2 AS (SELECT typ, sum(v * w) / sum(w) AS m FROM b WHERE v IS NOT NULL GROUP BY typ), g3 AS (SELECT sum(v * w) / sum(w) AS m FROM b WHERE v IS NOT NULL)
    SELECT b.pid, {d("coalesce(v, greatest(least(coalesce(g1.m, g2.m, g3.m), hi), lo))", "TAS")} FROM b LEFT JOIN g1 ON b.typ = g1.typ AND b.pos = g1.pos LEFT JOIN g2 ON b.typ = g2.typ, g3, lim""")
def hierarchical_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).join(flights(spark, sf_dir).select("flight_id", "typ"), "flight_id").withColumn("pos", F.col("pid") % 10)
    return imputation.hierarchical(t, "TAS", "groundspeed", [["typ", "pos"], ["typ"]], [5, 1]).select("pid", r("TAS"))


@query(f"""WITH {TRACKS}, {FLIGHTS}, b AS (SELECT t.pid, f.typ, t.mach FROM tracks t JOIN flights f USING (flight_id)) SELECT pid, {d("coalesce(mach, median(mach) OVER (PARTITION BY typ), (SELECT median(mach) FROM b))", "mach")} FROM b""")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).join(flights(spark, sf_dir).select("flight_id", "typ"), "flight_id")
    return imputation.group_median(t, "mach", ["typ"]).select("pid", r("mach"))


@query(f"""WITH {TRACKS}, c AS (SELECT kind, altitude, sum(groundspeed) OVER (PARTITION BY kind ORDER BY altitude) AS cum, sum(groundspeed) OVER (PARTITION BY kind) AS total FROM tracks WHERE altitude IS NOT NULL) SELECT kind, {d("min(altitude) FILTER (cum >= total / 2)", "wmedian")} FROM c GROUP BY kind""")
def weighted_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imputation.weighted_median(tracks(spark, sf_dir), ["kind"], "altitude", "groundspeed").select("kind", r("wmedian"))


# ---------------------------------------------------------------- folds and errors


@query(f"""WITH {TRACKS}, f AS (SELECT flight_id, min(t) AS t0 FROM tracks GROUP BY flight_id), n AS (SELECT flight_id, row_number() OVER (ORDER BY t0, flight_id) - 1 AS r, greatest(count(*) OVER () // 9, 1) AS size FROM f) SELECT flight_id, least(r // size, 8)::INTEGER AS fold FROM n""")
def time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.time_folds(tracks(spark, sf_dir), "flight_id", "t", 9)


@query(f"""WITH {TRACKS}, s AS (SELECT flight_id, row_number() OVER (ORDER BY count(*) DESC, flight_id) - 1 AS r FROM tracks GROUP BY flight_id) SELECT flight_id, (CASE WHEN r // 9 % 2 = 0 THEN r % 9 ELSE 8 - r % 9 END)::INTEGER AS fold FROM s""")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.group_folds(tracks(spark, sf_dir), "flight_id", 9)


_PRED = "pr AS (SELECT l_orderkey, l_linenumber, l_returnflag AS g, l_extendedprice AS y, l_extendedprice * (0.9 + (l_partkey % 21) / 100.0::DOUBLE) AS p, l_quantity * 1000 / 7 + 0.123456789::DOUBLE AS q FROM lineitem)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("y"), (F.col("l_extendedprice") * (0.9 + F.col("l_partkey") % 21 / 100)).alias("p"), (F.col("l_quantity") * 1000 / 7 + 0.123456789).alias("q"))


@query(f"""WITH {_PRED}, m AS (SELECT *, avg(y) OVER (PARTITION BY g) AS a FROM pr) SELECT g, {d("sqrt(avg(pow(p - y, 2)))", "rmse")}, {d("avg(abs(p - y))", "mae")}, {d("avg(abs(p - y) / abs(y)) * 100", "mape")}, {d("avg(p - y)", "bias")}, {d("stddev_samp(p - y)", "error_std")}, {d("1 - sum(pow(p - y, 2)) / sum(pow(y - a, 2))", "r2")}, count(*) AS n FROM m GROUP BY g""")
def error_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(folds.error_table(_predictions(spark, sf_dir), "y", "p", ["g"]), ["g"])


@query(f"""WITH {_PRED}, e AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM pr), b AS (SELECT pr.*, len(list_filter(e.q, lambda x: pr.p > x)) AS k FROM pr, e), m AS (SELECT k, avg(p - y) AS bias FROM b GROUP BY k)
    SELECT l_orderkey, l_linenumber, {d("(p - bias) / 1000", "corrected")}, {d("(p + q) / 2", "ensemble")}, {d("CASE WHEN p > 20000 THEN 0.8 * p + 0.2 * q WHEN p > 10000 THEN 0.5 * p + 0.5 * q ELSE q END", "blended")} FROM b JOIN m USING (k)""")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    return folds.quintile_bias(p, p, "p", "y").select("l_orderkey", "l_linenumber", r(F.col("corrected") / 1000, "corrected"), r(folds.ensemble(F.col("p"), F.col("q")), "ensemble"), r(folds.tail_blend(F.col("p"), F.col("q"), 20000), "blended"))


@query(f"""WITH {_PRED} SELECT 'p' AS "column", {d("corr(p, y)", "corr")}, round(covar_samp(p, y), 2) AS covar, corr(p, y) > 0.95 AS flagged FROM pr UNION ALL SELECT 'q', {d("corr(q, y)", "corr")}, round(covar_samp(q, y), 2), corr(q, y) > 0.95 FROM pr""")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.leakage(_predictions(spark, sf_dir), ["p", "q"], "y").select("column", r("corr"), F.round("covar", 2).alias("covar"), "flagged")


@query("""SELECT p_type AS value, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS code FROM (SELECT DISTINCT p_type FROM part)""")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.label_codes(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_type")


# ---------------------------------------------------------------- windows of the stream, over the stored table


@query(f"""SELECT event_type, epoch_ms(epoch_ms(time_bucket(INTERVAL 6 HOUR, ts))) AS window_start, count(*) AS n, {d("sum(value)", "total")} FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["event_type"], "value", "6 hours").select("event_type", "window_start", "n", r("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 8 HOUR AS session_end, count(*) AS n FROM k GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "user_id", "8 hours")


from . import driver_queries, feature_queries, model_queries, profile_queries, rebuild_queries, stage_queries  # noqa: E402, F401  register more queries
