"""Cross-validation with all folds at once against one fold after the other."""

import random

from pyspark.sql import functions as F

from flightloom.operators import trees
from flightloom.plans import prediction


def rows(n=600):
    rng = random.Random(7)
    out = []
    for i in range(n):
        x, m = rng.uniform(1, 10), rng.uniform(50, 60)
        out.append((i, i // 6, x, rng.random(), m, m * x * 9 if i % 11 else None, m * x * 10 * (1 + 0.02 * rng.random()), i % 5 != 0))
    return out


SCHEMA = "id long, flight long, x double, noise double, mass double, base double, fuel double, train boolean"
QUICK = {"a": {"depth": 2, "rate": 0.8, "bins": 16}, "b": {"depth": 3, "rate": 0.6, "bins": 32}}


def test_folds_at_once(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("fold", (F.col("flight") % 3).cast("int"))
    out, made = prediction.cross_validated(df, "fold", 3, ["x", "noise"], "fuel", QUICK, trees=3, least=5)
    got = {r.id: (r.oof_a, r.oof_b) for r in out.collect()}
    for fold in range(3):
        for k, name in enumerate(QUICK):
            alone = trees.boost(df, ["x", "noise"], ["fuel"], None, F.col("fold") != fold, F.col("fold") == fold, trees=3, least=5, **QUICK[name])
            for r in trees.predict(df.where(F.col("fold") == fold), alone).collect():
                assert abs(got[r.id][k] - r.prediction_fuel) < 1e-6
    mean = {r.id: r.mean_a for r in prediction.fresh(df, made, "id").collect()}
    assert len(mean) == 600


def test_predicted_fuel(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out, errors, _ = prediction.predicted_fuel(df, "flight", ["x", "noise"], "fuel", "mass", "base", "id", F.col("train"), k=3, threshold=3000.0, learners=QUICK, trees=6, least=5)
    got = {r.id: r for r in out.collect()}
    assert len(got) == 600 and {r.fold for r in got.values()} == {0, 1, 2, None}
    for i, *_, fuel, train in rows():
        r = got[i]
        assert (r.fold is None) == (not train) and min(r.a, r.b, r.ensemble, r.corrected) >= 0.1
        assert abs(r.ensemble - (r.a + r.b) / 2) < 1e-9
        want = r.corrected if r.base is None or r.base <= 1500 else 0.8 * r.base + 0.2 * r.corrected if r.base > 3000 else 0.5 * r.base + 0.5 * r.corrected
        assert abs(r.blended - max(want, 0.1)) < 1e-9
    folds_of = {}
    for i, flight, *_ in rows():
        if got[i].fold is not None:
            assert folds_of.setdefault(flight, got[i].fold) == got[i].fold
    off = [abs(got[i].ensemble - fuel) / fuel for i, *_, fuel, train in rows() if not train]
    assert sum(off) / len(off) < 0.25
    assert {(r.learner, r.fold) for r in errors.collect()} == {(n, f) for n in ("a", "b", "ensemble", "corrected", "blended") for f in range(3)}
