"""Exact percentiles by shrinking brackets."""

import random

import numpy as np
import pytest

from flightloom.operators import quantiles

QS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]


@pytest.mark.parametrize("few", [3, 50, 20_000])
def test_equal_to_percentile(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(2)
    rows = [(rng.gauss(0, 1), rng.choice([1.0, 2.0, 2.0, 7.5]), rng.choice([None, rng.expovariate(1.0)]), None, -3.0) for _ in range(1500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    got = quantiles.exact(df, {c: QS for c in "abcde"})
    for k, c in enumerate("abcde"):
        values = [r[k] for r in rows if r[k] is not None]
        want = np.quantile(values, QS) if values else [None] * len(QS)
        assert all((g is None and w is None) or abs(g - w) < 1e-12 for g, w in zip(got[c], want, strict=True))
    assert quantiles.exact(df, {}) == {} and quantiles.exact(df.limit(0), {"a": [0.5]}) == {"a": [None]}


def test_wrong_guesses_are_mended(spark, monkeypatch):
    """A bracket that misses its rank leads to the part beside it."""
    df = spark.createDataFrame([(float(i % 97),) for i in range(3000)], "a double")
    for guess in ((5.0, 9.0), (90.0, 90.0), (0.0, 0.0), (96.0, 96.0)):
        b = quantiles.Bracket("a", 1500, 3000, inside=3000)
        monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a, g=guess: quantiles.F.array(*[quantiles.F.max(quantiles.F.lit(x)) for x in g]))
        quantiles._shrink(df, [b])
        monkeypatch.undo()
        monkeypatch.setattr(quantiles, "FEW", 5)
        while b.value is None and b.inside > 5:
            quantiles._shrink(df, [b])
        if b.value is None:
            quantiles._gather(df, [b])
        assert b.value == sorted(float(i % 97) for i in range(3000))[1500]


@pytest.mark.parametrize("part", [200_000, 40])
def test_percentiles_by_group(spark, monkeypatch, part):
    from pyspark.sql import functions as F

    monkeypatch.setattr(quantiles, "PART_ROWS", part)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, None]), rng.choice([None, 2.0, rng.gauss(0, 1)])) for _ in range(900)] + [("none", 1, None), ("one", 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(4)
    want = {(r.k, r.j): tuple(r)[2:] for r in df.groupBy("k", "j").agg(*[F.percentile("v", F.lit(q)).alias(f"p{i}") for i, q in enumerate(QS)]).collect()}
    got = {(r.k, r.j): tuple(r)[2:] for r in quantiles.by_group(df, ["k", "j"], "v", QS, [f"p{i}" for i in range(len(QS))]).collect()}
    assert set(got) == set(want)
    for key, values in want.items():
        assert all((a is None and b is None) or abs(a - b) < 1e-12 for a, b in zip(got[key], values, strict=True)), key
    assert quantiles.by_group(df.limit(0), ["k"], "v", [0.5], ["m"]).count() == 0


def test_one_summary_a_column(spark, monkeypatch):
    """Ranks that are looked for between the same bounds share one approximation."""
    monkeypatch.setattr(quantiles, "FEW", 50)
    asked = []
    plain = quantiles.F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: asked.append(1) or plain(*a))
    df = spark.range(3000).selectExpr("id / 7D AS a", "-id / 3D AS b")
    todo = [quantiles.Bracket(c, k, 3000, inside=3000) for c in "ab" for k in (29, 30, 2969, 2970)]
    quantiles._shrink(df, todo)
    assert len(asked) == 2
    assert all(b.value is not None or b.inside < 50 for b in todo)
