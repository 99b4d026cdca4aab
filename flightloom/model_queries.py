"""Queries of models and of features that they need: early stop, models of each type, constraints, imputation in stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features as X
from .functions import phases as P
from .operators import models, physics, trees
from .plans import prediction
from .plans.tables import FLIGHTS, TRACKS, flights, tracks
from .queries import d, query, r
from .sources.staging import staged

KINDS = [f"T{k}" for k in range(7)]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what their lines add up to; a seventh lacks a feature."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").cast("double").alias("quantity"), F.count(F.lit(1)).cast("double").alias("lines"), F.avg("l_discount").cast("double").alias("discount"),
        F.max(F.col("l_partkey") % 1000).cast("double").alias("part"), F.avg("l_tax").cast("double").alias("tax"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("price"),
    )
    return lines.withColumn("quantity", F.when(F.col("o_orderkey") % 7 != 0, F.col("quantity")))


ORDER_FEATURES = ["quantity", "lines", "discount", "part", "tax"]


@query()
def take_off_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error on the held-out fifth after each tree, and the tree at which the model ends."""
    _, model = models.fit_with_stop(staged(_orders(spark, sf_dir)), ORDER_FEATURES, "price", "o_orderkey", trees=16, depth=3, rate=0.4, bins=32, patience=2)
    return model.history(spark).select("trees", "n", "mae", "rmse", (F.col("trees") == F.lit(int(model.best[0]))).alias("best"))


@query()
def feature_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of a quick model, the three best features, and the gains of a refit on those alone (0: not used)."""
    rows = staged(_orders(spark, sf_dir))
    _, quick = models.fit_with_stop(rows, ORDER_FEATURES, "price", "o_orderkey", trees=3, depth=3, rate=0.5, bins=16)
    top = models.most_gained(quick, 3)
    _, again = models.fit_with_stop(rows, top, "price", "o_orderkey", trees=3, depth=3, rate=0.5, bins=16)
    refit = again.importances(spark).select("feature", F.col("gain").alias("refit_gain"))
    return quick.importances(spark).select("feature", "gain", (F.col("gain") == 0).alias("unused")).join(refit, "feature", "left")


@query()
def type_multiplier_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two estimates of each line's price, corrected by models of its type: error before and after."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lines.select(F.col("l_orderkey").alias("entity"), F.concat("l_returnflag", "l_linestatus").alias("kind"), F.col("l_extendedprice").cast("double").alias("actual"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_partkey") % 1000).cast("double").alias("part"), F.col("l_discount").cast("double").alias("discount"))
    rows = rows.withColumns({"p": F.col("quantity") * 1500, "o": (F.col("quantity") + 5) * 1200})
    out, _ = models.type_multipliers(rows, ["quantity", "part", "discount"], "kind", "entity", "actual", {"p": "p", "o": "o"}, trees=4, depth=3, rate=0.6, bins=32)
    error = lambda c: F.sqrt(F.avg(F.pow(c - F.col("actual"), F.lit(2.0))))
    fixed = {n: physics.corrected_flow(F.col(n), F.col(f"multiplier_{n}")) for n in ("p", "o")}
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[error(F.col(n)).alias(f"raw_{n}") for n in fixed], *[error(c).alias(f"corrected_{n}") for n, c in fixed.items()])


@query()
def monotone_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a constrained model answers when only the quantity grows: it never falls."""
    rows = staged(_orders(spark, sf_dir)).withColumnRenamed("quantity", "int_ground_distance_nm")
    features = ["int_ground_distance_nm", "lines", "discount"]
    model = trees.boost(rows, features, ["price"], trees=4, depth=3, rate=0.5, bins=32, monotone=models.monotone_of(features))
    found = trees.partial_dependence(rows, model, "int_ground_distance_nm", list(range(0, 301, 5)))
    return found.withColumnRenamed("prediction_price", "price")


@query()
def imputed_in_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every missing reading filled by models: training flights with the true fuel as a predictor, then all flights without it."""
    t = tracks(spark, sf_dir).withColumnRenamed("flow", "fuel_a").withColumns({"fuel_o": F.when(F.col("pid") % 6 != 0, F.col("groundspeed") * 4), "truth": F.when(F.col("flight_id") % 4 != 0, F.col("groundspeed") * 3.5)})
    t = t.select("flight_id", "pid", "truth", "fuel_a", "fuel_o", "groundspeed", "vertical_rate", "temp_k", "altitude", "mach", "TAS", "CAS")

    def derive(df: DataFrame, changed) -> DataFrame:
        shares = {"climb": (F.col("vertical_rate") > 500).cast("double")}
        new = X.fuel_derived(F.col("fuel_a"), F.col("fuel_o"), F.lit(600.0), F.lit(60_000.0), F.lit(55_000.0), shares)
        old = [n for n in ("rate_a", "rate_climb", "agreement") if n in df.columns]
        return df.withColumns({n: F.when(changed | F.col(n).isNull(), new[n]).otherwise(F.col(n)) if n in old else new[n] for n in ("rate_a", "rate_climb", "agreement")})

    skip = ["flight_id", "pid", "groundspeed", "vertical_rate", "temp_k", "_changed"]
    out = models.impute_two_stage(t, ["fuel_a", "fuel_o"], ["groundspeed", "vertical_rate", "temp_k"], "truth", F.col("flight_id") % 4 != 0, derive, skip, trees=3, depth=3, rate=0.6, bins=16)
    return out.drop("truth")


def _fuel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuel of an order's lines: what burns is the price, its physics the quantity."""
    rows = _orders(spark, sf_dir)
    return rows.withColumns({"fuel": F.when(F.col("o_orderkey") % 4 != 0, F.col("price") / 1000), "mass": F.col("lines") * 40, "base": F.col("lines") * 38, "group": F.col("o_orderkey") % 97})


#: Few trees, so that the query is quick; the plan's own learners have more.
_QUICK = {"broad": {"depth": 2, "rate": 0.6, "bins": 16}, "deep": {"depth": 3, "rate": 0.5, "bins": 32}}


@query()
def fuel_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuel of every order by two learners in three folds, their mean, corrected and blended; what has no fuel is predicted by all folds."""
    rows, _, _ = prediction.predicted_fuel(_fuel_rows(spark, sf_dir), "group", ORDER_FEATURES, "fuel", "mass", "base", "o_orderkey", F.lit(True), k=3, threshold=180.0, learners=_QUICK, trees=4, patience=2)
    return rows.select("o_orderkey", "fold", "fuel", "broad", "deep", "ensemble", "corrected", "blended")


@query()
def fuel_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each learner in each fold."""
    _, errors, _ = prediction.predicted_fuel(_fuel_rows(spark, sf_dir), "group", ORDER_FEATURES, "fuel", "mass", "base", "o_orderkey", F.lit(True), k=3, threshold=180.0, learners=_QUICK, trees=4, patience=2)
    return errors


_FLOWN = f"""f AS (SELECT flight_id, avg(flow) AS a, avg(TAS) * 4 AS o, count(*) AS n, max(t) - min(t) AS seconds, avg(TAS) FILTER (altitude > 5000) AS cruise_tas, avg((altitude > 5000)::INT::DOUBLE) AS cruise_share, avg((vertical_rate > 500)::INT::DOUBLE) AS climb FROM tracks GROUP BY flight_id)"""


@query(f"""WITH {TRACKS}, {FLIGHTS}, {_FLOWN}, j AS (SELECT flights.*, f.* EXCLUDE (flight_id), greatest(mtow - oew, 1) AS mass, origin * 100.0::DOUBLE + destination + 1 AS dist FROM flights JOIN f USING (flight_id))
    SELECT flight_id, {", ".join(f"(typ = '{k}')::INTEGER AS typ_{k}" for k in KINDS)}, 0.0::DOUBLE AS absent, n >= 10 AS has_trajectory_data,
    {d("(a - o) * mass", "error_x_mass")}, {d("(a - o) * dist", "error_x_distance")}, {d("cruise_tas * 9", "tas_x_aspect_ratio")}, {d("dist * cruise_share / (dist + 1e-6)", "level_distance_fraction")}, {d("climb * seconds / (seconds + 1e-6)", "climb_time_fraction")}, {d("a / nullif(tow, 0) / (dist * 2 + 1e-6)", "fuel_efficiency_per_nm")},
    {d("a / nullif(seconds / 3600.0, 0)", "rate_a")}, {d("a / nullif(tow, 0)", "per_tow")}, {d("a / nullif(mass, 0)", "per_mass")}, {d("a * climb / nullif(seconds / 3600.0, 0)", "rate_climb")}, {d("a - o", "diff")}, {d("(a - o) * (a - o)", "sq_diff")}, {d("a / nullif(o, 0)", "ratio_ao")}, {d("(a - o) / nullif(o, 0) * 100", "pct")}, {d("exp(-abs(a - o) / 100)", "agreement")} FROM j""")
def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types as columns, flags, interactions and what follows from fuel, in a fixed order of columns."""
    t = tracks(spark, sf_dir)
    part = lambda c: F.avg(F.expr(c).cast("int").cast("double"))
    f = t.groupBy("flight_id").agg(F.avg("flow").alias("a"), (F.avg("TAS") * 4).alias("o"), F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).cast("double").alias("seconds"), F.avg(F.when(F.col("altitude") > 5000, F.col("TAS"))).alias("cruise_tas"), part("altitude > 5000").alias("cruise_share"), part("vertical_rate > 500").alias("climb"))
    j = flights(spark, sf_dir).join(f, "flight_id").withColumns({"mass": F.greatest(F.col("mtow") - F.col("oew"), F.lit(1.0)), "dist": F.col("origin") * 100.0 + F.col("destination") + 1})
    c = {k: F.col(k) for k in j.columns}
    fuel = X.fuel_derived(c["a"], c["o"], c["seconds"], c["tow"], c["mass"], {"climb": c["climb"]})
    more = X.operating_interactions({"error": c["a"] - c["o"], "mass": c["mass"], "distance": c["dist"], "cruise_tas": c["cruise_tas"], "aspect_ratio": F.lit(9.0), "cruise_share": c["cruise_share"], "ground_distance": c["dist"] * 2, "climb_s": c["climb"] * c["seconds"], "total_s": c["seconds"], "fuel_per_tow": fuel["per_tow"]})
    kinds = P.one_hot(c["typ"], KINDS, "typ")
    out = j.select("flight_id", *[v.alias(k) for k, v in kinds.items()], (c["n"] >= 10).alias("has_trajectory_data"), *[r(v, k) for k, v in (more | fuel).items() if k != "rate_o"])
    order = ["flight_id", *kinds, "absent", "has_trajectory_data", *more, *[k for k in fuel if k != "rate_o"]]
    return models.aligned(out, order)


@query(f"""WITH {TRACKS}, s AS (SELECT flight_id, min(CASE WHEN pid % 2 = 0 THEN t END) AS t0 FROM tracks GROUP BY flight_id) SELECT flight_id, t0 // 86400 AS day FROM s""")
def flight_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day parts of flights merged to whole ones, and the day of the first reading of a sensor that has half of them."""
    from .sources.tables import merge_days

    t = tracks(spark, sf_dir).select("flight_id", "pid", "t", F.expr("t div 86400").alias("date"))
    whole = merge_days(t, "flight_id", "pid", "date")
    return whole.groupBy("flight_id").agg(F.expr("min(CASE WHEN pid % 2 = 0 THEN t END) div 86400").alias("day"))


@query(f"""WITH {TRACKS}, {FLIGHTS}, k AS (SELECT DISTINCT typ, flight_id FROM flights), n AS (SELECT typ, flight_id, row_number() OVER (PARTITION BY typ ORDER BY md5(flight_id::VARCHAR || '|42'), flight_id) AS i FROM k) SELECT typ, count(*) AS n, sum(flight_id)::BIGINT AS total FROM n WHERE i <= 5 GROUP BY typ""")
def training_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five flights of each type, the same ones in every run (the limit is what the extract is)."""
    out = models.training_rows(flights(spark, sf_dir), "typ", "flight_id", 5)
    return out.groupBy("typ").agg(F.count(F.lit(1)).alias("n"), F.sum("flight_id").alias("total"))
