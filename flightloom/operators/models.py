"""Models of the pipeline: MLlib and boosted trees with early stop, per-type multipliers, imputation by models, targets and alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.atmosphere import ratio
from ..functions.features import is_non_negative, missing_order
from ..sources.staging import staged
from . import trees
from .folds import shuffle_split
from .imputation import bounds, profile


#: Hexadecimal digits of a hash by which `training_rows` counts entities.
HASH_DIGITS = 4


def regressor(kind: str, features: str = "features", label: str = "label", seed: int = 42, **params):
    """gbt, forest or linear of MLlib; `trees.boost` has early stop, missing values and monotone constraints."""
    from pyspark.ml import regression

    make = {"gbt": regression.GBTRegressor, "forest": regression.RandomForestRegressor, "linear": regression.LinearRegression}[kind]
    model = make(featuresCol=features, labelCol=label, **params)
    return model.setSeed(seed) if kind != "linear" else model


def assembled(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Feature vectors of the columns, NULLs as NaN-free zeros; rows without a label stay for prediction."""
    from pyspark.ml.feature import VectorAssembler

    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}).withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled)


def fit_predict(df: DataFrame, columns: list[str], label: str, train: Column, kind: str = "gbt", seed: int = 42, **params) -> tuple[DataFrame, object]:
    """Predictions for all rows from a model of the rows of `train` that have a label, and the model."""
    rows = assembled(df, columns, label)
    model = regressor(kind, seed=seed, **params).fit(rows.where(train & F.col("label").isNotNull()))
    return model.transform(rows).drop("features", "label"), model


def importances(df: DataFrame, model: object, columns: list[str], top: int = 20) -> DataFrame:
    """(feature, importance), largest first."""
    found = [(c, float(x)) for c, x in zip(columns, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(found, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def multipliers(df: DataFrame, kind: str, actual: str, physics: str, least: int = 1) -> DataFrame:
    """(kind, multiplier): total actual over total physics of a type, for types with enough rows."""
    both = df.where(F.col(actual).isNotNull() & F.col(physics).isNotNull())
    return both.groupBy(kind).agg(ratio(F.sum(actual), F.sum(physics)).alias("multiplier"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")


def type_models(df: DataFrame, kind: str, actual: str, physics: str, least: int = 3) -> DataFrame:
    """(kind, slope, intercept, n): a model of each type, actual on physics by least squares, in one aggregation; types with too few rows have none."""
    both = df.where(F.col(actual).isNotNull() & F.col(physics).isNotNull())
    out = both.groupBy(kind).agg(F.regr_slope(actual, physics).alias("slope"), F.regr_intercept(actual, physics).alias("intercept"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") >= least) & F.col("slope").isNotNull())


def by_type_model(df: DataFrame, models: DataFrame, kind: str, physics: str) -> DataFrame:
    """Adds predicted: the type's model, or the physics where it has none."""
    joined = df.join(models.select(kind, "slope", "intercept"), kind, "left")
    return joined.withColumn("predicted", F.coalesce(F.col("slope") * F.col(physics) + F.col("intercept"), F.col(physics))).drop("slope", "intercept")


def floored(value: Column, least: float = 1.0) -> tuple[Column, Column]:
    """Negative predictions raised to `least`, and whether a row was."""
    return F.when(value < 0, F.greatest(value, F.lit(least))).otherwise(value), F.coalesce(value < 0, F.lit(False))


def targets(fuel: Column, mass: Column, base: Column) -> dict[str, Column]:
    """Scaled, residual and specific targets; `restore` undoes them."""
    return {"scaled": ratio(fuel, mass) * 10000, "residual": fuel - base, "specific": ratio(fuel, base)}


def restore(kind: str, value: Column, mass: Column, base: Column) -> Column:
    return {"scaled": value * mass / 10000, "residual": value + base, "specific": value * base}[kind]


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; those that are missing are 0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


# Parts of the names of features that fuel can only grow with.
INCREASING = (
    "int_ground_distance_nm", "interval_duration_sec", "origin_dest_gcdist_nm", "total_flight_duration_sec", "ac_max_takeoff_weight_kg", "ac_MTOW_kg", "ac_MTOW_lb", "mass_above_oew",
    "int_time_since_takeoff_sec", "int_time_before_landing_sec", "climb_time_sec", "descent_time_sec", "cruise_distance_nm", "climb_distance_nm", "descent_distance_nm",
)


def monotone_of(features: list[str], increasing: tuple[str, ...] = INCREASING) -> dict[str, int]:
    """1 for the features whose name holds one of `increasing`; the others are free."""
    return {f: 1 for f in features if any(k in f for k in increasing)}


def fit_with_stop(df: DataFrame, features: list[str], target: str, entity: str, share: float = 0.2, group: str | None = None, seed: int = 42, **params) -> tuple[DataFrame, trees.Model]:
    """A boosted model that stops by its error on `share` of the entities: df with `held` and prediction_<target>, and the model."""
    marked = df.withColumn("held", shuffle_split(F.col(entity), share, seed))
    model = trees.boost(marked.where(F.col(target).isNotNull()), features, [target], group, ~F.col("held"), F.col("held"), seed=seed, **params)
    return trees.predict(marked, model), model


def top_features(df: DataFrame, features: list[str], target: str, n: int, entity: str, **params) -> list[str]:
    """The n features that a quick model gains most by (names come to the driver), for a refit on those alone."""
    _, model = fit_with_stop(df, features, target, entity, **params)
    return most_gained(model, n)


def most_gained(model: trees.Model, n: int) -> list[str]:
    """The n features that a model gained most by."""
    gain = {f: sum(g for (_, _, k), g in model.gains.items() if k == f) for f in model.features}
    return sorted(model.features, key=lambda f: (-gain[f], f))[:n]


def training_rows(df: DataFrame, kind: str, entity: str, most: int = 10_000, seed: int = 42) -> DataFrame:
    """The rows of at most `most` entities of each type, chosen by a hash of the entity: the same in every run.

    Hashes are counted by their first digits, and only entities up to the digits at
    which a type has enough are put in order."""
    hashed = F.md5(F.concat(F.col(entity).cast("string"), F.lit(f"|{seed}")).cast("binary"))
    each = df.where(F.col(kind).isNotNull()).select(kind, entity).distinct().withColumn("_h", hashed).withColumn("_d", F.substring("_h", 1, HASH_DIGITS))
    counts = each.groupBy(kind, "_d").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(kind).orderBy("_d")) - F.col("_c")
    needed = counts.withColumn("_before", before).where(F.col("_before") < most).groupBy(kind).agg(F.max("_d").alias("_last"))
    drawn = F.row_number().over(Window.partitionBy(kind).orderBy("_h", entity))
    # a row a type
    chosen = each.join(F.broadcast(needed), kind).where("_d <= _last").withColumn("_n", drawn).where(F.col("_n") <= most).select(kind, entity)
    return df.join(chosen, [kind, entity], "left_semi")


def type_multipliers(df: DataFrame, features: list[str], kind: str, entity: str, actual: str, estimates: dict[str, str], least_rows: int = 100, **params) -> tuple[DataFrame, trees.Model]:
    """Models of each type for actual over every estimate ({name: column}): df with multiplier_<name>, 1 where a type has too few rows.

    A model learns from all rows of its type, whatever their `entity`; for an extract
    of some entities, give it their `training_rows`."""
    names = list(estimates)
    ratios = df.withColumns({f"_{n}": ratio(F.col(actual), F.col(estimates[n])) for n in names})
    enough = ratios.where(F.coalesce(*[F.col(f"_{n}") for n in names]).isNotNull()).groupBy(kind).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least_rows)
    learnt = ratios.join(F.broadcast(enough.select(kind)), kind, "left_semi").select(kind, *features, *[f"_{n}" for n in names])
    model = trees.boost(learnt, features, [f"_{n}" for n in names], kind, **params)
    out = trees.predict(df, model, [f"multiplier_{n}" for n in names])
    return out.fillna(1.0, [f"multiplier_{n}" for n in names]), model


def impute_targets(df: DataFrame, targets: list[str], predictors: list[str], train: Column | None = None, batch: int = 20, write: bool = True, **params) -> DataFrame:
    """Fills NULLs of the targets by boosted models, `batch` columns a table pass, those with fuel or mass in their name first.

    A model learns from the rows of `train` that have its column; predictors may be
    missing, too.  Guesses stay inside the 1st and 99th percentile (of 100 values
    and more), and at 0 or above where the name says so; a column without any value
    is filled with 0.  The table is written after each batch, after the last one
    only if `write` (else the caller writes what it makes of it)."""
    low = {c: 0.0 for c in targets}
    order = missing_order({c: 1.0 for c in targets})
    for at in range(0, len(order), batch):
        columns = order[at : at + batch]
        model = trees.boost(df, [p for p in predictors if p not in columns], columns, None, train, **params)
        learnt = df.where(train) if train is not None else df
        limits = bounds(learnt, columns)
        few = [c for c in columns if not limits[c]]
        empty = {c for c, n in learnt.agg(*[F.count(F.col(c).cast("double")).alias(c) for c in few]).first().asDict().items() if not n} if few else set()
        missing = reduce(Column.__or__, [F.col(c).cast("double").isNull() for c in columns])
        guessed = trees.predict(df, model, [f"_g_{c}" for c in columns], missing)
        fills = {}
        for c in columns:
            guess = F.coalesce(F.col(f"_g_{c}"), F.lit(0.0)) if c not in empty else F.lit(0.0)
            if limits[c]:
                guess = F.greatest(F.lit(limits[c][0]), F.least(F.lit(limits[c][1]), guess))
            fills[c] = F.coalesce(F.col(c).cast("double"), F.greatest(guess, F.lit(low[c])) if is_non_negative(c) else guess)
        df = guessed.withColumns(fills).drop(*[f"_g_{c}" for c in columns])
        df = staged(df) if write or at + batch < len(order) else df
    return df


def impute_two_stage(df: DataFrame, base: list[str], predictors: list[str], truth: str, train: Column, derive, skip: list[str], **params) -> DataFrame:
    """Fills every NULL in two stages: the training rows with the true value as a predictor, then all rows without it.

    Each stage fills the columns `base` first, computes what derives from them anew
    by derive(df, changed) (changed: rows whose base was filled), then fills all
    other columns that have NULLs.  Columns of `skip` and the truth stay as they are."""

    def stage(rows: DataFrame, known: list[str]) -> DataFrame:
        marked = staged(rows.withColumn("_changed", F.coalesce(*[F.when(F.col(c).isNull(), True) for c in base], F.lit(False))))
        filled = derive(impute_targets(marked, base, known, write=False, **params), F.col("_changed")).drop("_changed")
        filled = staged(filled)
        open_ = [c for c in filled.columns if c not in skip and c != truth]
        missing = [r["column"] for r in profile(filled, open_).where("n_null > 0").collect()]
        return impute_targets(filled, sorted(missing), [*known, *base], **params)

    is_train = F.coalesce(train, F.lit(False))
    first = stage(df.where(is_train), [*predictors, truth])
    return stage(first.unionByName(df.where(~is_train), allowMissingColumns=True), predictors)
