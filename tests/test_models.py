"""Imputation in stages, extracts and multipliers by type."""

import random

from pyspark.sql import functions as F

from flightloom.functions import features as X
from flightloom.operators import models, quantiles


def test_two_stages_fill_everything(spark):
    rng = random.Random(4)
    gap = lambda v, share: None if rng.random() < share else v
    rows = []
    for i in range(400):
        x, z = rng.uniform(0, 10), rng.uniform(0, 10)
        rows.append((i, "train" if i % 4 else "rank", 100 * x + rng.random(), gap(100 * x, 0.4), gap(95 * x + z, 0.4), x, gap(z, 0.2), gap(z - 5 + x, 0.3), gap(3.0 * z, 0.3), None))
    df = spark.createDataFrame(rows, "id long, split string, truth double, fuel_a double, fuel_o double, x double, z double, turn double, mass double, empty double")
    df = df.withColumn("truth", F.when(F.col("split") == "train", F.col("truth")))

    def derive(d, changed):
        new = X.fuel_derived(F.col("fuel_a"), F.col("fuel_o"), F.lit(60.0), F.lit(100.0), F.lit(90.0), {})
        return d.withColumn("rate_a", new["rate_a"])

    out = models.impute_two_stage(df, ["fuel_a", "fuel_o"], ["x", "z"], "truth", F.col("split") == "train", derive, ["id", "split", "_changed"], batch=4, trees=2, depth=3, rate=0.9, bins=16, least=5)
    got = {r.id: r for r in out.collect()}
    assert len(got) == 400
    low, high = sorted(r[3] for r in rows if r[3] is not None)[3], sorted(r[3] for r in rows if r[3] is not None)[-4]
    for i, _, _, a, o, x, z, turn, mass, _ in rows:
        r = got[i]
        assert all(v is not None for k, v in r.asDict().items() if k != "truth")
        for old, new in ((a, r.fuel_a), (o, r.fuel_o), (x, r.x), (z, r.z), (turn, r.turn), (mass, r.mass)):
            assert old is None or old == new
        assert r.mass >= 0 and r.empty == 0.0 and abs(r.rate_a - r.fuel_a * 60) < 1e-6
        if a is None:
            assert low - 20 <= r.fuel_a <= high + 20
    errors = [abs(got[r[0]].fuel_a - 100 * r[5]) for r in rows if r[3] is None]
    assert sum(errors) / len(errors) < 150


def test_extract_and_multipliers(spark):
    rows = [(i, f"k{i % 3}" if i % 50 else None, i // 4, 2.0 * (i % 7 + 1) * (1 + i % 3), float(i % 7 + 1)) for i in range(1200)] + [(9000, "rare", 9000, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, kind string, entity long, actual double, guess double")
    some = models.training_rows(df, "kind", "entity", 10)
    assert {r["kind"]: r.n for r in some.groupBy("kind").agg(F.countDistinct("entity").alias("n")).collect()} == {"k0": 10, "k1": 10, "k2": 10, "rare": 1}
    out, _ = models.type_multipliers(df, ["guess"], "kind", "entity", "actual", {"g": "guess"}, trees=3, depth=2, rate=1.0)
    got = {(r["kind"], round(r.multiplier_g, 6)) for r in out.collect()}
    assert got == {("k0", 2.0), ("k1", 4.0), ("k2", 6.0), ("rare", 1.0), (None, 1.0)}
    assert models.top_features(df.withColumn("noise", F.lit(1.0)), ["noise", "guess"], "actual", 1, "entity", trees=2, depth=2) == ["guess"]
    assert models.monotone_of(["x_climb_time_sec", "gs"]) == {"x_climb_time_sec": 1}


def test_multipliers_learn_from_all_rows(spark):
    """A type with more than 10,000 entities: its mean is that of all of them."""
    df = spark.range(12_000).selectExpr("id AS entity", "'k' AS kind", "cast(id * id % 1009 AS double) AS actual", "1D AS guess")
    out, model = models.type_multipliers(df, ["guess"], "kind", "entity", "actual", {"g": "guess"}, trees=1, depth=1)
    want = sum(i * i % 1009 for i in range(12_000)) / 12_000
    assert abs(model.base[0, 0] - want) < 1e-9
    assert out.where(F.abs(F.col("multiplier_g") - want) > 1e-9).count() == 0


def test_training_rows_by_first_digits(spark, monkeypatch):
    """The same entities as the smallest hashes of each type, whatever number of digits is counted first."""
    import hashlib

    df = spark.range(3000).select((F.col("id") % 1500).alias("entity"), F.when(F.col("id") % 7 > 1, "many").otherwise("few").alias("kind"))
    pairs = {(r.kind, r.entity) for r in df.collect()}
    order = sorted(pairs, key=lambda p: (hashlib.md5(f"{p[1]}|42".encode()).hexdigest(), p[1]))
    want = {p for kind in ("many", "few") for p in [p for p in order if p[0] == kind][:40]}
    for digits in (1, 4):
        monkeypatch.setattr(models, "HASH_DIGITS", digits)
        assert {(r.kind, r.entity) for r in models.training_rows(df, "kind", "entity", 40).collect()} == want


def test_most_gained(spark):
    """The best features come from a model that is there, without a second training."""
    from types import SimpleNamespace

    gains = {("", "y", "b"): 2.0, ("x", "y", "b"): 1.0, ("", "y", "a"): 2.5}
    assert models.most_gained(SimpleNamespace(features=["a", "b", "c"], gains=gains), 2) == ["b", "a"]


def test_only_rows_with_gaps_are_guessed(spark, monkeypatch):
    """Imputation asks its models for rows that miss a value, and orders no values for medians."""
    asked, wanted = [], []
    predict, exact = models.trees.predict, quantiles.exact
    monkeypatch.setattr(models.trees, "predict", lambda *a: asked.append(predict(*a)) or asked[-1])
    monkeypatch.setattr(quantiles, "exact", lambda df, w: wanted.append(w) or exact(df, w))
    df = spark.range(400).selectExpr("id", "id % 20 / 2D AS x", "CASE WHEN id % 4 > 0 THEN id % 20 * 3D END AS y", "cast(NULL AS double) AS empty")
    out = models.impute_targets(df, ["y", "empty"], ["x"], trees=2, depth=3, rate=1.0, bins=16, least=5)
    assert out.where("y IS NULL OR empty <> 0 OR empty IS NULL").count() == 0
    one = models.impute_targets(df, ["y"], ["x"], trees=2, depth=3, rate=1.0, bins=16, least=5)
    assert one.where("y IS NULL").count() == 0
    assert asked[-1].where("(y IS NULL) <> (_g_y IS NOT NULL)").count() == 0
    assert all(q != [0.5] for w in wanted for q in w.values())
