"""More queries: composed features, models and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import atmosphere as A
from .functions import phases as P
from .functions import statistics as S
from .operators import imputation, joins, models, physics, series
from .plans import features
from .plans.tables import FLIGHTS, INTERVALS, TRACKS, flights, intervals, tracks
from .queries import _IN, _PHASE, OVER, ROW, _inside, _rounded, by_time, d, query, r


@query(f"""WITH {TRACKS}, c AS (SELECT *, coalesce(TAS, groundspeed, 250) AS ftas, coalesce(altitude, 30000) AS h, coalesce((altitude - lag(altitude) {OVER}) / nullif((t - lag(t) {OVER})::DOUBLE, 0) * 60, 0) AS vr FROM tracks)
    SELECT flight_id, pid, {d("ftas", "tas_filled")}, {d("h", "alt_filled")}, {d("CASE WHEN pid % 2 = 0 THEN vertical_rate ELSE vr END", "vr_filled")}, {d("greatest(0, least(400, ftas * 0.514444::DOUBLE))", "tas_ms")}, CASE WHEN TAS IS NULL THEN 'filled' ELSE 'unknown' END AS tag,
    {d("CASE WHEN altitude > 20000 THEN greatest(0.4, least(0.9, ftas * 0.514444::DOUBLE / sqrt(1.4::DOUBLE * 287.05::DOUBLE * temp_k))) ELSE mach END", "mach_filled")} FROM c""")
def fallback_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of substitutes for speeds, height and rate, final clips, and where a value came from."""
    tas = F.coalesce("TAS", "groundspeed", F.lit(250.0))
    steady = F.coalesce(series.rate(F.col("altitude"), F.col("t"), by_time()) * 60, F.lit(0.0))
    mach = A.clamp(A.tas_to_mach(tas * A.KNOT, F.col("temp_k")), 0.4, 0.9)
    return tracks(spark, sf_dir).select(
        *ROW, r(tas, "tas_filled"), r(F.coalesce("altitude", F.lit(30000.0)), "alt_filled"), r(F.when(F.col("pid") % 2 == 0, F.col("vertical_rate")).otherwise(steady), "vr_filled"),
        r(A.clamp(tas * A.KNOT, 0, 400), "tas_ms"), P.filled_tag(F.col("TAS"), tas).alias("tag"), r(F.when(F.col("altitude") > 20000, mach).otherwise(F.col("mach")), "mach_filled"),
    )


_CRUDE = "TAS / (661 * sqrt(greatest(15 - 6.5::DOUBLE * altitude * 0.3048::DOUBLE / 1000 + 273.15, 0)) / 15)"


@query(f"""WITH {TRACKS}, m AS (SELECT *, CASE WHEN altitude IS NOT NULL THEN {_CRUDE} END AS m, {_PHASE} AS phase FROM tracks) SELECT flight_id, {d("avg(coalesce(m < 0.7, false)::INT)", "slow")}, {d("avg(coalesce(m >= 0.7 AND m < 0.8, false)::INT)", "middle")}, {d("avg(coalesce(m >= 0.8, false)::INT)", "fast")},
    {d("coalesce(avg(altitude) FILTER (abs(vertical_rate) < 200), avg(altitude), 0)", "cruise_alt")}, {d("coalesce(avg(flow) FILTER (phase = 'climb'), 0)", "flow_climb")}, {d("coalesce(avg(flow) FILTER (phase = 'cruise'), 0)", "flow_cruise")}, {d("stddev_pop(flow)", "flow_rmse")} FROM m GROUP BY flight_id""")
def speed_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.crude_mach(F.col("TAS"), F.col("altitude"))
    t = tracks(spark, sf_dir).withColumns({"m": m, "phase": P.flight_phase(F.col("vertical_rate"), F.col("altitude"))})
    x, h, zero = F.col("m"), F.col("altitude"), F.lit(0.0)
    flow = lambda p: F.coalesce(F.avg(S.only(F.col("phase") == p, F.col("flow"))), zero)
    out = t.groupBy("flight_id").agg(
        S.share(x < 0.7).alias("slow"), S.share((x >= 0.7) & (x < 0.8)).alias("middle"), S.share(x >= 0.8).alias("fast"), F.coalesce(F.avg(S.only(F.abs("vertical_rate") < 200, h)), F.avg(h), zero).alias("cruise_alt"),
        flow("climb").alias("flow_climb"), flow("cruise").alias("flow_cruise"), F.stddev_pop("flow").alias("flow_rmse"),
    )
    return _rounded(out, ["flight_id"])


@query(f"""WITH {TRACKS}, f AS (SELECT flight_id, CASE WHEN count(altitude) = 0 THEN 'empty' WHEN count(*) < 50 THEN 'short' ELSE 'ok' END AS status FROM tracks GROUP BY flight_id) SELECT status, count(*) AS n FROM f GROUP BY status""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.count("altitude") == 0, "empty").when(F.count(F.lit(1)) < 50, "short").otherwise("ok")
    return tracks(spark, sf_dir).groupBy("flight_id").agg(status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {INTERVALS}, k AS (SELECT *, 'real' AS kind FROM intervals UNION ALL SELECT flight_id, idx, i_start - (i_end - i_start), i_start, 'prev' FROM intervals WHERE idx % 8 = 0 UNION ALL SELECT flight_id, idx, i_end, i_end + (i_end - i_start), 'next' FROM intervals WHERE idx % 8 = 7),
    g AS (SELECT k.flight_id, k.idx, k.kind, k.i_start, avg(t.groundspeed) AS gs FROM k LEFT JOIN tracks t ON t.flight_id = k.flight_id AND t.t BETWEEN k.i_start AND k.i_end GROUP BY ALL),
    w AS (SELECT *, lag(gs) OVER o AS before, lead(gs) OVER o AS after FROM g WINDOW o AS (PARTITION BY flight_id ORDER BY i_start)) SELECT idx, {d("gs", "gs")}, {d("gs - before", "gs_lag_diff")}, {d("gs - after", "gs_lead_diff")} FROM w WHERE kind = 'real'""")
def interval_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval means against the intervals before and after, with made-up intervals at both ends of a flight."""
    every = features.with_pseudo_intervals(intervals(spark, sf_dir), "flight_id", "i_start", "i_end")
    keys = ["flight_id", "idx", "kind", "i_start"]
    inside = joins.points_in_intervals(tracks(spark, sf_dir).drop("kind"), every, "flight_id", "t", "i_start", "i_end").groupBy(*keys).agg(F.avg("groundspeed").alias("gs"))
    w = series.by("flight_id", "i_start")
    n = series.neighbours(F.col("gs"), w, "gs")
    out = every.join(inside, keys, "left").withColumns({k: n[k] for k in ("gs_lag_diff", "gs_lead_diff")})
    return out.where("kind = 'real'").select("idx", r("gs"), r("gs_lag_diff"), r("gs_lead_diff"))


@query(f"""WITH {TRACKS}, s AS (SELECT flight_id, us, t, vertical_rate AS v, sign(vertical_rate) AS g FROM tracks), k AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY us) - row_number() OVER (PARTITION BY flight_id, g ORDER BY us) AS i FROM s), e AS (SELECT flight_id, g, count(*) AS c, avg(v) AS m FROM k GROUP BY flight_id, g, i HAVING count(*) > 2 AND abs(avg(v)) > 200)
    SELECT flight_id, count(*) FILTER (g > 0) AS climbs, count(*) FILTER (g < 0) AS descents, {d("max(abs(m))", "steepest")} FROM e GROUP BY flight_id""")
def vertical_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one sign of the vertical rate, longer than two readings and steeper than 200."""
    t = series.islands(tracks(spark, sf_dir), "flight_id", "us", F.signum("vertical_rate"))
    e = t.groupBy("flight_id", "island").agg(F.count(F.lit(1)).alias("c"), F.avg("vertical_rate").alias("m"), F.first(F.signum("vertical_rate")).alias("g")).where("c > 2 AND abs(m) > 200")
    return e.groupBy("flight_id").agg(F.count(S.only(F.col("g") > 0, F.lit(1))).alias("climbs"), F.count(S.only(F.col("g") < 0, F.lit(1))).alias("descents"), r(F.max(F.abs("m")), "steepest"))


@query(f"""WITH {TRACKS}, {FLIGHTS}, s AS (SELECT flight_id, min(t) AS dep, max(t) AS arr FROM tracks GROUP BY flight_id), k AS (SELECT pid, flight_id % 25 AS station, t AS valid, temp_k, u FROM tracks),
    o AS (SELECT f.flight_id, k.temp_k, k.u FROM flights f JOIN s USING (flight_id) LEFT JOIN k ON k.station = f.origin AND abs(k.valid - s.dep) <= 7200 QUALIFY row_number() OVER (PARTITION BY f.flight_id ORDER BY abs(k.valid - s.dep), k.valid) = 1),
    a AS (SELECT f.flight_id, k.temp_k, k.u FROM flights f JOIN s USING (flight_id) LEFT JOIN k ON k.station = f.destination AND abs(k.valid - s.arr) <= 7200 QUALIFY row_number() OVER (PARTITION BY f.flight_id ORDER BY abs(k.valid - s.arr), k.valid) = 1)
    SELECT flight_id, {d("coalesce(o.temp_k, 0)", "origin_temp_k")}, {d("coalesce(a.u, 0)", "destination_u")}, {d("coalesce(a.temp_k, 0) - coalesce(o.temp_k, 0)", "diff_temp_k")}, {d("coalesce(a.u, 0) - coalesce(o.u, 0)", "diff_u")} FROM o JOIN a USING (flight_id)""")
def station_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    spans = t.groupBy("flight_id").agg(F.min("t").alias("departure"), F.max("t").alias("arrival"))
    f = flights(spark, sf_dir).join(spans, "flight_id").select("flight_id", "origin", "destination", "departure", "arrival")
    reports = t.select(F.expr("cast(flight_id % 25 as int)").alias("station"), F.col("t").alias("valid"), (-F.col("pid")).alias("later"), "temp_k", "u")
    out = features.station_features(f, reports, ["temp_k", "u"], "flight_id", first="later")
    return out.select("flight_id", r("origin_temp_k"), r("destination_u"), r("diff_temp_k"), r("diff_u"))


_FUEL = f"{_IN}, a AS (SELECT idx, flow, t, (flow + lag(flow) OVER w) / 2 * (t - lag(t) OVER w) / 3600.0 AS s FROM p WINDOW w AS (PARTITION BY idx ORDER BY t)), kg AS (SELECT idx, idx // 8 AS flight_id, CASE WHEN count(flow) < count(*) OR count(*) < 2 THEN 0 ELSE greatest(coalesce(sum(s), 0), 0) END AS kg FROM a GROUP BY idx), y AS (SELECT kg.*, 'T' || (flight_id % 7) AS typ, kg * (1.1::DOUBLE + (idx % 5) / 100.0::DOUBLE) AS actual FROM kg)"


def _fuel(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = physics.trapezoid(_inside(spark, sf_dir), ["idx"], "t", "flow", "us").withColumn("flight_id", F.expr("idx div 8"))
    return kg.withColumns({"typ": F.concat(F.lit("T"), (F.col("flight_id") % 7).cast("string")), "actual": F.col("kg") * (1.1 + F.col("idx") % 5 / 100)})


@query(f"""WITH {_FUEL}, m AS (SELECT typ, sum(actual) / nullif(sum(kg), 0) AS k FROM y GROUP BY typ) SELECT typ, {d("k / 1", "multiplier")}, {d("sqrt(avg(pow(kg - actual, 2))) / 1000", "rmse_raw")}, {d("sqrt(avg(pow(kg * coalesce(k, 1) - actual, 2))) / 1000", "rmse_corrected")}, count(*) AS n FROM y JOIN m USING (typ) GROUP BY typ, k""")
def multiplier_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval fuel by physics, raw and with the type's multiplier, against the actual."""
    y = _fuel(spark, sf_dir)
    both = y.join(models.multipliers(y, "typ", "actual", "kg"), "typ").withColumn("fixed", physics.corrected_flow(F.col("kg"), F.col("multiplier")))
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("actual"), F.lit(2.0)))) / 1000
    return both.groupBy("typ", "multiplier").agg(r(rmse("kg"), "rmse_raw"), r(rmse("fixed"), "rmse_corrected"), F.count(F.lit(1)).alias("n")).select("typ", r("multiplier"), "rmse_raw", "rmse_corrected", "n")


@query(f"""WITH {_FUEL} SELECT idx, {d("kg / 1000", "kg_t")}, {d("sum(kg) OVER (PARTITION BY flight_id ORDER BY idx) / 1000", "cum_t")}, {d("sum(kg) OVER (PARTITION BY flight_id) / 1000", "flight_t")}, {d("actual / nullif(60000, 0) * 10000 / 1000", "scaled")}, {d("(actual - kg) / 1000", "residual")}, {d("actual / nullif(kg, 0)", "specific")} FROM y""")
def fuel_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("flight_id").orderBy("idx")
    kinds = models.targets(F.col("actual"), F.lit(60000.0), F.col("kg"))
    return _fuel(spark, sf_dir).select("idx", r(F.col("kg") / 1000, "kg_t"), r(F.sum("kg").over(w) / 1000, "cum_t"), r(F.sum("kg").over(Window.partitionBy("flight_id")) / 1000, "flight_t"), r(kinds["scaled"] / 1000, "scaled"), r(kinds["residual"] / 1000, "residual"), r(kinds["specific"], "specific"))


@query(f"""WITH {FLIGHTS}, n AS (SELECT typ, flight_id, row_number() OVER (PARTITION BY typ ORDER BY flight_id) AS k, count(*) OVER (PARTITION BY typ) AS total FROM flights) SELECT typ, total AS n, max(flight_id) AS last_of_first_two FROM n WHERE k <= 2 GROUP BY typ, total ORDER BY total DESC, typ LIMIT 5""")
def largest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top five types by flights, with the last of each one's first two flights."""
    f = flights(spark, sf_dir)
    top = f.groupBy("typ").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "typ").limit(5)
    first = f.withColumn("k", F.row_number().over(Window.partitionBy("typ").orderBy("flight_id"))).where("k <= 2").groupBy("typ").agg(F.max("flight_id").alias("last_of_first_two"))
    return top.join(first, "typ").select("typ", "n", "last_of_first_two")


@query(f"""WITH {TRACKS}, c AS (SELECT flight_id, 'T' || (flight_id % 7) AS typ, {_PHASE} AS phase, groundspeed FROM tracks) SELECT typ, phase, grouping(typ) + grouping(phase) AS level, count(*) AS n, {d("avg(groundspeed) / 7", "gs")} FROM c GROUP BY ROLLUP (typ, phase)""")
def type_phase_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tracks(spark, sf_dir).select(F.concat(F.lit("T"), (F.col("flight_id") % 7).cast("string")).alias("typ"), P.flight_phase(F.col("vertical_rate"), F.col("altitude")).alias("phase"), "groundspeed")
    out = c.rollup("typ", "phase").agg((F.grouping("typ") + F.grouping("phase")).cast("long").alias("level"), F.count(F.lit(1)).alias("n"), (F.avg("groundspeed") / 7).alias("gs"))
    return out.select("typ", "phase", "level", "n", r("gs"))


@query(f"""WITH {TRACKS}, s AS (SELECT flight_id, t - min(t) OVER (PARTITION BY flight_id) AS since, max(t) OVER (PARTITION BY flight_id) - t AS until, altitude, TAS FROM tracks) SELECT flight_id, max(since) AS duration, {d("avg(altitude) FILTER (since <= 86400)", "first_day_alt")}, {d("avg(altitude) FILTER (until <= 86400)", "last_day_alt")}, count(TAS) AS n_tas,
    {d("avg(TAS)", "tas_mean")}, {d("coalesce(stddev_samp(TAS), 0)", "tas_std")}, coalesce(stddev_samp(TAS), 0) < 1 AS low_variance FROM s GROUP BY flight_id""")
def flight_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Window.partitionBy("flight_id")
    s = tracks(spark, sf_dir).withColumns({"since": F.col("t") - F.min("t").over(whole), "until": F.max("t").over(whole) - F.col("t")})
    std = F.coalesce(F.stddev_samp("TAS"), F.lit(0.0))
    out = s.groupBy("flight_id").agg(F.max("since").alias("duration"), F.avg(S.only(F.col("since") <= 86400, F.col("altitude"))).alias("first_day_alt"), F.avg(S.only(F.col("until") <= 86400, F.col("altitude"))).alias("last_day_alt"), F.count("TAS").alias("n_tas"), F.avg("TAS").alias("tas_mean"), std.alias("tas_std"), (std < 1).alias("low_variance"))
    return _rounded(out, ["flight_id"])


@query(f"""WITH {TRACKS}, {FLIGHTS}, b AS (SELECT t.pid, t.kind, f.typ, t.mach, t.CAS FROM tracks t JOIN flights f USING (flight_id)), g AS (SELECT *, median(mach) OVER (PARTITION BY typ, kind) AS m1, median(mach) OVER (PARTITION BY typ) AS m2 FROM b)
    SELECT pid, {d("coalesce(mach, m1, m2, (SELECT median(mach) FROM b))", "mach")}, {d("coalesce(CAS, 0)", "CAS")} FROM g""")
def cascade_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by type and kind, by type, of all; constants for the rest."""
    t = tracks(spark, sf_dir).join(flights(spark, sf_dir).select("flight_id", "typ"), "flight_id")
    return imputation.cascade(t, "mach", [["typ", "kind"], ["typ"]]).fillna({"CAS": 0.0}).select("pid", r("mach"), r("CAS"))


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boosted model of fuel from interval statistics, trained on all but each type's fold, with its predictions."""
    stats = _inside(spark, sf_dir).groupBy("idx").agg(F.avg("groundspeed").alias("gs"), F.avg("altitude").alias("alt"), F.count(F.lit(1)).cast("double").alias("n"))
    y = _fuel(spark, sf_dir).join(stats, "idx")
    out, _ = models.fit_predict(y, ["gs", "alt", "n"], "actual", F.col("flight_id") % 5 != 0, maxIter=5, maxDepth=3)
    return out.select("idx", "actual", F.greatest(F.col("prediction"), F.lit(0.1)).alias("predicted"))
