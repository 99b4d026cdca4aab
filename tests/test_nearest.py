"""Nearest rows in several features against all distances."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightloom.operators import nearest


@pytest.mark.parametrize(("rows", "asking", "features"), [(4000, 20_000, 2), (20, 7, 2), (15, 3, 3), (40, 50, 1)])
def test_against_all_distances(spark, monkeypatch, rows, asking, features):
    monkeypatch.setattr(nearest, "BOX_ROWS", rows)
    monkeypatch.setattr(nearest, "ASKING", asking)
    rng = np.random.default_rng(rows)
    # clusters, far rows, and many equal points: those tie exactly
    places = rng.uniform(0, 3, (12, 3))
    known = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(60, 3)) * 0.01 + 8, np.tile([1.0, 2.0, 3.0], (120, 1)), places[rng.integers(0, 12, 100)]])
    asked = np.concatenate([rng.normal(size=(60, 3)), [[100.0, -50.0, 3.0]], np.tile([1.0, 2.0, 3.0], (40, 1)), places[rng.integers(0, 12, 30)]])
    names = ["x", "y", "z"][:features]
    schema = "k long, x double, y double, z double"
    base = spark.createDataFrame([(1000 + i, *map(float, p), float(i)) for i, p in enumerate(known)] + [(1, None, 1.0, 1.0, 5.0), (2, 1.0, 1.0, 1.0, None)], schema + ", v double").repartition(3)
    todo = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(asked)] + [(900, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], schema)
    if features > 2:
        todo = todo.where("k <> 900 or k is null")
    got = {r.k: r.v for r in nearest.k_nearest_mean(todo, base, "k", names, "v").collect()}
    usable = known[:, :features]
    usable_z, asked_z = ((p[:, :features] - usable.mean(axis=0)) / usable.std(axis=0) for p in (known, asked))
    ids = np.arange(len(known))
    assert len(got) == todo.count() and got[None] is None and (features > 2 or got[900] is None)
    for i, q in enumerate(asked_z):
        off = np.sqrt(((usable_z - q) ** 2).sum(axis=1))
        order = np.lexsort((ids, np.round(off, 9)))
        assert abs(got[i] - ids[order[:5]].mean()) < 1e-9


def test_few_known_rows(spark):
    todo = spark.createDataFrame([(1, 0.0), (2, 5.0)], "k long, x double")
    three = spark.createDataFrame([(10, 1.0, 3.0), (11, 2.0, 6.0), (12, 9.0, 9.0)], "k long, x double, v double")
    assert {r.k: r.v for r in nearest.k_nearest_mean(todo, three, "k", ["x"], "v", k=5).collect()} == {1: 6.0, 2: 6.0}
    assert {r.v for r in nearest.k_nearest_mean(todo, three.where("k < 0"), "k", ["x"], "v").collect()} == {None}
    same = three.withColumn("x", F.lit(4.0))
    assert {r.v for r in nearest.k_nearest_mean(todo, same, "k", ["x"], "v", k=2).collect()} == {4.5}
    assert nearest.k_nearest_mean(todo.limit(0), three, "k", ["x"], "v").count() == 0


def test_rows_equally_far_do_not_depend_on_how_rows_are_dealt(spark):
    rng = np.random.default_rng(3)
    cents = np.sort(rng.choice(2_000_000, 1200, replace=False)) * 2 - 100_000
    base = spark.createDataFrame([(1000 + i, float(c) / 100, float(i)) for i, c in enumerate(cents)], "k long, x double, v double").coalesce(1)
    # each asks from the middle between two known rows: on paper a tie, decided by the last bits of mean and deviation
    todo = spark.createDataFrame([(i, float(a + b) / 200) for i, (a, b) in enumerate(zip(cents[:200], cents[1:], strict=False))], "k long, x double")
    got = [{r.k: r.v for r in nearest.k_nearest_mean(todo, base.repartition(parts, "k"), "k", ["x"], "v", k=1).collect()} for parts in (1, 3, 7)]
    assert got[0] == got[1] == got[2]


def test_moments_are_exact(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(4551, 3180, 500), rng.normal(size=500) * 1e-9, [1e12, -1e12, 0.1]])
    rows = spark.createDataFrame([(float(v), 7.0) for v in x], "x double, y double")
    n, found = nearest._moments(rows.repartition(5), ["x", "y"])
    mean = float(sum(map(Fraction, x.tolist())) / len(x))
    assert n == len(x) and found["x"][0] == mean and found["y"] == (7.0, 0.0)
    assert abs(found["x"][1] / float(np.sqrt(math.fsum((x - mean) ** 2) / len(x))) - 1) < 1e-15
