"""Queries of the steps between features and models: holes, fills, joins with fallbacks, models by type, reports of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import features as X
from .functions import phases as P
from .operators import folds, imputation, joins, models, series, trajectory
from .plans.tables import FLIGHTS, INTERVALS, TRACKS, flights, intervals, tracks
from .queries import _IP, _rounded, by_time, d, query, r

_GRID = f"""{TRACKS}, k AS (SELECT flight_id, t // 3600 AS slot, arg_max(groundspeed, t) AS v FROM tracks GROUP BY ALL), s AS (SELECT flight_id, unnest(range(min(slot), max(slot) + 1)) AS slot FROM k GROUP BY flight_id),
    n AS (SELECT s.*, last_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER (PARTITION BY flight_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM s LEFT JOIN k USING (flight_id, slot)),
    gaps AS (SELECT flight_id, slot, lag(slot) OVER (PARTITION BY flight_id ORDER BY slot) AS before FROM n WHERE slot - seen <= 12)"""


@query(f"""WITH {_GRID} SELECT flight_id, before * 3600 AS t0, slot * 3600 AS t1 FROM gaps WHERE slot - before > 1""")
def residual_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes that are left after tracks are resampled to hours and twelve of them filled after a reading: they begin where the filling ends."""
    grid = series.resample(tracks(spark, sf_dir), "flight_id", "t", ["groundspeed"], step=3600, limit=12)
    holes = trajectory.ends_of_gaps(grid.where("groundspeed is not null"), "flight_id", "t", ["groundspeed"], 3600, 1 << 40)
    return holes.select("flight_id", "t0", "t1")


@query(f"""WITH {TRACKS}, {_IP} SELECT flight_id, pid, {d("CASE WHEN mach IS NOT NULL THEN mach ELSE coalesce(pv + (nv - pv) * (n - pi) / nullif((ni - pi)::DOUBLE, 0), nv, pv, 0) END", "mach")} FROM j""")
def fill_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select("flight_id", "us", "pid", "mach")
    return series.fill_all(t, "flight_id", "us", ["mach"]).select("flight_id", "pid", r("mach"))


@query(f"""WITH {TRACKS} SELECT flight_id, pid, {", ".join(d(f"CASE WHEN {c} IS NOT NULL THEN greatest({lo}, least({hi}, {c})) END", c) for c, (lo, hi) in P.CLAMPS.items())} FROM tracks""")
def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("flight_id", "pid", *[r(c, k) for k, c in P.clamp_kinematics(list(P.CLAMPS)).items()])


@query(f"""WITH {TRACKS}, m AS (SELECT flight_id, kind, avg((altitude < 500)::INT::DOUBLE) AS ground, avg((vertical_rate > 500)::INT::DOUBLE) AS climb, avg((vertical_rate < -500)::INT::DOUBLE) AS descent, avg(TAS) AS a, avg(CAS) AS b FROM tracks GROUP BY ALL)
    SELECT flight_id, kind, {d("a - b", "speed_diff")}, {d("a / nullif(b, 0)", "speed_ratio")}, {d("a * a", "a_sq")}, CASE WHEN flight_id % 5 = 0 THEN 'old' WHEN greatest(coalesce(climb, 0), coalesce(descent, 0), coalesce(ground, 0)) = 0 THEN 'unknown' WHEN coalesce(climb, 0) >= greatest(coalesce(descent, 0), coalesce(ground, 0)) THEN 'climb' WHEN coalesce(descent, 0) >= coalesce(ground, 0) THEN 'descent' ELSE 'ground' END AS mode, coalesce(a > b, false) AS faster FROM m""")
def recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that follow from filled ones, computed again after filling; the mode only where it is missing."""
    t = tracks(spark, sf_dir)
    share = lambda c: F.avg(F.expr(c).cast("int").cast("double"))
    m = t.groupBy("flight_id", "kind").agg(share("altitude < 500").alias("ground"), share("vertical_rate > 500").alias("climb"), share("vertical_rate < -500").alias("descent"), F.avg("TAS").alias("a"), F.avg("CAS").alias("b"))
    out = m.withColumns(X.recomputed({"speed": ("a", "b")}, ["a"]))
    mode = X.mode_of({k: F.col(k) for k in ("climb", "descent", "ground")}, F.when(F.col("flight_id") % 5 == 0, "old"))
    return out.select("flight_id", "kind", r("speed_diff"), r("speed_ratio"), r("a_sq"), mode.alias("mode"), X.flag(F.col("a") > F.col("b")).alias("faster"))


_ERR = """e AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS kind, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_quantity") * 1500).cast("double").alias("p"))


def _error_sql(by: str, source: str) -> str:
    e = "(p - y)"
    return f"SELECT {by}, count(*) AS n, {d(f'avg{e}', 'mean_error')}, {d(f'median({e})', 'median_error')}, {d(f'stddev_samp({e})', 'std_error')}, {d(f'avg(abs({e}))', 'mae')}, {d(f'avg((({e}) > 0)::INT)', 'over')}, {d(f'avg((({e}) < 0)::INT)', 'under')}, {d(f'avg((abs({e} / nullif(y, 0)) > 0.2)::INT)', 'large')}, {d('avg(y)', 'mean_actual')}, {d('min(y)', 'min_actual')}, {d('max(y)', 'max_actual')} FROM {source} GROUP BY {by}"


@query(f"WITH {_ERR} {_error_sql('kind', 'e')}")
def errors_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(folds.error_statistics(_errors(spark, sf_dir), "y", "p", ["kind"]), ["kind", "n"])


@query(f"""WITH {_ERR}, q AS (SELECT list_distinct([quantile_cont(y, 0.2), quantile_cont(y, 0.4), quantile_cont(y, 0.6), quantile_cont(y, 0.8)]) AS edges FROM e), b AS (SELECT e.*, len(list_filter(edges, lambda x: y > x))::INTEGER AS bin FROM e, q) {_error_sql('bin', 'b')}""")
def errors_by_quintile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(folds.error_statistics(folds.quantile_bin(_errors(spark, sf_dir), "y", "bin"), "y", "p", ["bin"]), ["bin", "n"])


@query(f"""WITH {_ERR}, m AS (SELECT kind, regr_slope(y, p) AS s, regr_intercept(y, p) AS i FROM e WHERE kind <> 'R' GROUP BY kind), v AS (SELECT e.*, coalesce(s * p + i, p) AS z FROM e LEFT JOIN m USING (kind)) SELECT kind, count(*) AS n, {d("avg(z) / 1000", "predicted")}, {d("sqrt(avg(pow(z - y, 2))) / 1000", "rmse")}, count(*) FILTER (z - 20000 < 0) AS n_negative, {d("avg(CASE WHEN z - 20000 < 0 THEN greatest(z - 20000, 1) ELSE z - 20000 END) / 1000", "floored")} FROM v GROUP BY kind""")
def type_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each type, the physics for types without one, and the floor of predictions."""
    e = _errors(spark, sf_dir)
    out = models.by_type_model(e, models.type_models(e.where("kind <> 'R'"), "kind", "y", "p"), "kind", "p")
    value, low = models.floored(F.col("predicted") - 20000)
    found = out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), (F.avg("predicted") / 1000).alias("predicted"), (F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("y"), F.lit(2.0)))) / 1000).alias("rmse"), F.count(F.when(low, 1)).alias("n_negative"), (F.avg(value) / 1000).alias("floored"))
    return _rounded(found, ["kind", "n", "n_negative"])


@query(f"""WITH {INTERVALS}, l AS (SELECT flight_id, CASE WHEN idx % 3 = 0 THEN idx + 1000000 ELSE idx END AS idx, i_start, idx * 0.5::DOUBLE AS fuel FROM intervals), a AS (SELECT flight_id, idx, min(fuel) AS x FROM l GROUP BY ALL), b AS (SELECT flight_id, i_start, min(fuel) AS x FROM l GROUP BY ALL)
    SELECT i.flight_id, i.idx, {d("coalesce(a.x, b.x)", "fuel")}, i.i_end - i.i_start AS seconds FROM intervals i LEFT JOIN a USING (flight_id, idx) LEFT JOIN b ON b.flight_id = i.flight_id AND b.i_start = i.i_start""")
def labels_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by flight and interval number, else by flight and start; then only columns that are new are joined."""
    i = intervals(spark, sf_dir)
    labels = i.select("flight_id", F.expr("CASE WHEN idx % 3 = 0 THEN idx + 1000000 ELSE idx END").alias("idx"), "i_start", (F.col("idx") * 0.5).alias("fuel"))
    out = joins.with_fallback(i.select("flight_id", "idx", "i_start"), labels, ["flight_id", "idx"], ["flight_id", "i_start"], "fuel")
    more = i.select("flight_id", "idx", "i_start", (F.col("i_end") - F.col("i_start")).alias("seconds"))
    return joins.only_new(out, more, ["flight_id", "idx"]).select("flight_id", "idx", r("fuel"), "seconds")


@query(f"""WITH {INTERVALS}, s AS (SELECT flight_id, min(i_start) AS first_start, max(i_end) AS last_end FROM intervals GROUP BY flight_id), k AS (SELECT flight_id, CASE WHEN flight_id % 3 = 0 THEN min(t) - 60 END AS listed, min(t) AS a, max(t) AS b FROM tracks GROUP BY flight_id),
    e AS (SELECT k.flight_id, coalesce(listed, CASE WHEN k.flight_id % 3 = 1 THEN first_start END, a) AS takeoff, coalesce(CASE WHEN k.flight_id % 3 = 1 THEN last_end END, b) AS landing FROM k LEFT JOIN s USING (flight_id)), p AS (SELECT i.idx, (i_start - takeoff) / nullif((landing - takeoff)::DOUBLE, 0) AS x, (i_end - takeoff) / nullif((landing - takeoff)::DOUBLE, 0) AS y FROM intervals i JOIN e USING (flight_id))
    SELECT idx, {d("x", "pos_start")}, {d("y", "pos_end")} FROM p WHERE x BETWEEN -1 AND 0.8 AND y BETWEEN -0.5 AND 0.9""")
def flight_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Take-off and landing from the flight list, else its intervals, else its track; intervals far outside are left out."""
    i = intervals(spark, sf_dir)
    s = i.groupBy("flight_id").agg(F.min("i_start").alias("first_start"), F.max("i_end").alias("last_end"))
    k = tracks(spark, sf_dir).groupBy("flight_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).join(s, "flight_id", "left")
    third = F.col("flight_id") % 3
    e = k.select("flight_id", F.coalesce(F.when(third == 0, F.col("a") - 60), F.when(third == 1, F.col("first_start")), "a").alias("takeoff"), F.coalesce(F.when(third == 1, F.col("last_end")), "b").alias("landing"))
    c = trajectory.position_in_flight(F.col("i_start"), F.col("i_end"), F.col("takeoff"), F.col("landing"))
    out = i.join(e, "flight_id").select("idx", c["pos_start"].alias("x"), c["pos_end"].alias("y"))
    return out.where("x between -1 and 0.8 and y between -0.5 and 0.9").select("idx", r("x", "pos_start"), r("y", "pos_end"))


@query(f"""WITH {FLIGHTS}, o AS (SELECT flight_id, typ, row_number() OVER (ORDER BY CASE typ WHEN 'T3' THEN 0 WHEN 'T5' THEN 1 ELSE 2 END, typ, flight_id) - 1 AS place FROM flights) SELECT flight_id, typ, place FROM o""")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some types first, then by type and flight, as the output is sorted."""
    from .operators.ranking import ranked

    first = F.when(F.col("typ") == "T3", 0).when(F.col("typ") == "T5", 1).otherwise(2)
    return ranked(flights(spark, sf_dir), [first, F.col("typ"), F.col("flight_id")], "place").select("flight_id", "typ", "place")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '|42'), o_orderkey LIMIT 200")
def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 200 rows (the sample is what the operator is)."""
    return folds.sampled(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", 200).select("o_orderkey", "o_custkey")


@query(f"""WITH {TRACKS}, a AS (SELECT 'left' AS side, avg(mach) AS mach, avg(TAS) AS TAS FROM tracks UNION ALL SELECT 'right', avg(mach), avg(TAS) FROM tracks WHERE pid % 2 = 0) SELECT side, {d("mach", "mach")}, {d("TAS", "TAS")} FROM a""")
def shared_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feature tables on the columns that both have, without those that names and types exclude."""
    t = tracks(spark, sf_dir)
    a, b = t.select("flight_id", "mach", "TAS", F.lit("x").alias("name_x"), "us"), t.where("pid % 2 = 0").select("TAS", "mach", "altitude", F.lit("x").alias("name_x"))
    both = X.pruned([x for x in a.dtypes if x[0] in joins.shared_columns(a, b)])
    every = a.select(F.lit("left").alias("side"), *both).unionByName(b.select(F.lit("right").alias("side"), *both))
    return every.groupBy("side").agg(*[r(F.avg(c), c) for c in both])


@query(f"""WITH {TRACKS}, n AS (SELECT count(*) AS n, count(mach) AS mach, count(TAS) AS TAS, count(flow) AS fuel_flow, count(altitude) AS altitude FROM tracks), u AS (SELECT "column", 1 - v / n AS share FROM n UNPIVOT (v FOR "column" IN (mach, TAS, fuel_flow, altitude)))
    SELECT "column", row_number() OVER (ORDER BY "column" NOT LIKE '%fuel%', share, "column") - 1 AS place, CASE WHEN share >= 0.25 THEN 'coarse' WHEN "column" LIKE '%fuel%' THEN 'weighted' ELSE 'plain' END AS route FROM u WHERE share > 0""")
def fill_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which order columns are filled, and how, from the profile of the table."""
    t = tracks(spark, sf_dir).withColumnRenamed("flow", "fuel_flow")
    shares = imputation.profile(t, ["mach", "TAS", "fuel_flow", "altitude"]).where("share > 0")
    fuel = F.col("column").contains("fuel")
    way = F.when(F.col("share") >= 0.25, "coarse").when(fuel, "weighted").otherwise("plain")
    # one row a column of the table
    place = F.row_number().over(Window.orderBy(~fuel, "share", "column")) - 1
    return shares.select("column", place.cast("long").alias("place"), way.alias("route"))


@query(f"""WITH {TRACKS} {" UNION ALL ".join(f"SELECT '{c}' AS feature, {d(f'avg({c})', 'mean')}, {d(f'stddev_pop({c})', 'rmse')}, count({c}) AS n FROM tracks" for c in ("altitude", "mach", "TAS", "flow"))}""")
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each feature and how far its values lie from it, as reported after imputation."""
    return imputation.feature_statistics(tracks(spark, sf_dir), ["altitude", "mach", "TAS", "flow"]).select("feature", r("mean"), r("rmse"), "n")


_REPORT = ("altitude", "mach", "TAS", "CAS", "flow", "temp_k", "one")


@query(f"""WITH {TRACKS}, a AS (SELECT *, CASE WHEN pid % 9 = 0 THEN 1.0::DOUBLE END AS one FROM tracks) {" UNION ALL ".join(f"SELECT '{c}' AS " + '"column"' + f", {d(f'avg(({c} IS NULL)::INT::DOUBLE)', 'share')}, avg(({c} IS NULL)::INT::DOUBLE) > 0.8 AS sparse, min({c}) IS NOT DISTINCT FROM max({c}) AS constant FROM a" for c in _REPORT)}""")
def column_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are mostly missing or hold one value only, as they are dropped before training."""
    t = tracks(spark, sf_dir).withColumn("one", F.expr("CASE WHEN pid % 9 = 0 THEN 1.0D END"))
    return imputation.column_report(t, list(_REPORT)).select("column", r("share"), "sparse", "constant")


@query(f"""WITH {INTERVALS}, g AS (SELECT idx, i_start // 86400 AS day, CASE WHEN idx % 3 <> 0 THEN idx * 1.5::DOUBLE END AS v, flight_id, i_start FROM intervals), f AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM g WINDOW w AS (PARTITION BY flight_id ORDER BY i_start, idx)) SELECT idx, day, {d("coalesce(v, (coalesce(a, b) + coalesce(b, a)) / 2)", "v")}, CASE WHEN v - 500 >= 0 THEN 1 ELSE 0 END AS positive FROM f""")
def neighbour_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing segments from those beside them, negative values as missing, days that the rows fall on."""
    g = intervals(spark, sf_dir).select("idx", "flight_id", F.expr("i_start div 86400").alias("day"), F.struct("i_start", "idx").alias("seg"), F.expr("CASE WHEN idx % 3 <> 0 THEN idx * 1.5D END").alias("v"))
    positive = imputation.null_negative(g.withColumn("w", F.col("v") - 500), ["w"])
    out = trajectory.fill_from_neighbours(positive, "flight_id", ["v"])
    return out.select("idx", "day", r("v"), F.col("w").isNotNull().cast("int").alias("positive"))
