"""Fuel predicted with cross-validation: models of all folds trained at once, ensembles, corrections, submission."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import folds, models, trees
from ..sources.staging import staged

#: Two learners whose mean is the ensemble: one with few large steps, one with deeper trees and smaller steps.
LEARNERS = {"broad": {"depth": 4, "rate": 0.1, "bins": 64}, "deep": {"depth": 8, "rate": 0.03, "bins": 128}}


def cross_validated(df: DataFrame, fold: str, k: int, features: list[str], target: str, learners: dict[str, dict], **params) -> tuple[DataFrame, dict[str, trees.Model]]:
    """df with oof_<learner>: each row predicted by the model that has not seen its fold; and the models, grouped by the fold they leave out.

    A row goes to the models of all folds, for training or, in its own, to tell them
    when to stop, so that one pass over the table serves all folds.  Rows without a
    fold are not learnt from and have no prediction here (see `fresh`)."""
    each = df.where(F.col(target).isNotNull() & F.col(fold).isNotNull()).withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    made, out = {}, df.withColumn("_m", F.col(fold).cast("string"))
    for name, own in learners.items():
        made[name] = trees.boost(each, features, [target], "_m", F.col(fold) != F.col("_m"), F.col(fold) == F.col("_m"), **{**params, **own})
        out = trees.predict(out, made[name], [f"oof_{name}"])
    return out.drop("_m"), made


def fresh(df: DataFrame, made: dict[str, trees.Model], key: str) -> DataFrame:
    """(key, mean_<learner>): rows that no model has seen, as the mean of the models of all folds."""
    out = df
    for name, model in made.items():
        out = trees.predict_mean(out, model, [f"mean_{name}"])
    return out.select(key, *[f"mean_{name}" for name in made])


def in_kilograms(df: DataFrame, columns: dict[str, str], kind: str, mass: str, base: str) -> DataFrame:
    """Adds {name: prediction of a target of that kind} as fuel, 0.1 at least, and `ensemble`, their mean."""
    out = df.withColumns({n: folds.non_negative(models.restore(kind, F.col(c), F.col(mass), F.col(base))) for n, c in columns.items()})
    return out.withColumn("ensemble", folds.ensemble(*[F.col(n) for n in columns]))


def predicted_fuel(df: DataFrame, entity: str, features: list[str], actual: str, mass: str, base: str, key: str, train: Column, kind: str = "scaled", k: int = 9, threshold: float = 800.0, learners: dict[str, dict] | None = None, group_folds: Callable[[DataFrame], DataFrame] | None = None, **params) -> tuple[DataFrame, DataFrame, dict[str, trees.Model]]:
    """Fuel of all rows: (rows with the learners' predictions, ensemble, corrected and blended; errors by learner and fold; models).

    Training rows are predicted out of their fold, the others by all folds' models.
    corrected takes off the mean error of the prediction's quintile in training, and
    blended leans on `base` where that is large."""
    learners = learners or LEARNERS
    # read several times by what follows
    df = staged(df)
    is_train = F.coalesce(train, F.lit(False)) & F.col(actual).isNotNull()
    known = df.where(is_train)
    dealt = (group_folds or (lambda x: folds.group_folds(x, entity, k)))(known)
    target = models.targets(F.col(actual), F.col(mass), F.col(base))[kind]
    known = staged(known.join(dealt, entity).withColumn("_y", target))
    seen, made = cross_validated(known, "fold", k, features, "_y", learners, **params)
    unseen = df.where(~is_train)
    for n, model in made.items():
        unseen = trees.predict_mean(unseen, model, [f"oof_{n}"])
    unseen = unseen.withColumn("fold", F.lit(None).cast("int"))
    rows = in_kilograms(seen.drop("_y").unionByName(unseen), {n: f"oof_{n}" for n in learners}, kind, mass, base).drop(*[f"oof_{n}" for n in learners])
    rows = staged(rows)
    rows = folds.quintile_bias(rows.where("fold is not null"), rows, "ensemble", actual)
    rows = rows.withColumn("corrected", folds.non_negative(F.col("corrected")))
    rows = rows.withColumn("blended", folds.non_negative(folds.tail_blend(F.col(base), F.col("corrected"), threshold)))
    long = rows.where("fold is not null").select("fold", actual, F.explode(F.array(*[F.struct(F.lit(n).alias("learner"), F.col(n).alias("guess")) for n in (*learners, "ensemble", "corrected", "blended")])).alias("x"))
    errors = folds.error_table(long.select("fold", actual, "x.learner", "x.guess"), actual, "guess", ["learner", "fold"])
    return rows, errors, made
