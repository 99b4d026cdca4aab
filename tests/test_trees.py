"""Boosted trees against a plain numpy version, their stop, constraints and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightloom.operators import trees


def table(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[rng.random((n, 4)) < 0.15] = np.nan
    z = np.nan_to_num(x, nan=0.7)
    kind = rng.integers(0, 3, n)
    y = np.where(kind == 0, 3 * z[:, 0], np.where(kind == 1, np.sin(2 * z[:, 1]), z[:, 2] * z[:, 0])) + 0.1 * rng.normal(size=n)
    other = z[:, 3] ** 2 + 0.1 * rng.normal(size=n)
    y[rng.random(n) < 0.05] = np.nan
    return kind, x, y, other, rng.random(n) < 0.3


def frame(spark, data):
    none = lambda v: None if np.isnan(v) else float(v)
    rows = [(i, f"k{k}", *[none(v) for v in r], none(a), none(b), bool(h)) for i, (k, r, a, b, h) in enumerate(zip(*data, strict=True))]
    return spark.createDataFrame(rows, "id long, kind string, a double, b double, c double, d double, y double, z double, held boolean").repartition(5)


def grow(x, r, n_bins, depth, least, penalty):
    """One tree on residuals, all cuts tried one by one: a function of rows."""
    if depth == 0:
        return None
    best, total = None, r.sum() ** 2 / (len(r) + penalty)
    for f in range(x.shape[1]):
        for cut in range(1, n_bins + 1):
            for missing_left in (False, True):
                left = np.where(x[:, f] == 0, missing_left, x[:, f] <= cut)
                n = left.sum()
                if n < least or len(r) - n < least:
                    continue
                gain = r[left].sum() ** 2 / (n + penalty) + r[~left].sum() ** 2 / (len(r) - n + penalty) - total
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, cut, missing_left, left)
    if best is None:
        return None
    _, f, cut, missing_left, left = best
    sides = [(r[m].sum() / (m.sum() + penalty), grow(x[m], r[m], n_bins, depth - 1, least, penalty)) for m in (left, ~left)]
    return f, cut, missing_left, sides


def value(tree, row, here=0.0):
    if tree is None:
        return here
    f, cut, missing_left, sides = tree
    left = missing_left if row[f] == 0 else row[f] <= cut
    v, below = sides[0 if left else 1]
    return value(below, row, v)


def twin(model, data, rounds, depth, rate, bins, least):
    kind, x, *targets, held = data
    out = np.full((len(kind), 2), np.nan)
    for g in range(3):
        rows = kind == g
        own = trees._binned(x[rows], np.full(rows.sum(), g), model.edges)
        use = ~held[rows]
        for t in range(2):
            y = targets[t][rows]
            known = use & ~np.isnan(y)
            guess = np.full(rows.sum(), y[known].mean())
            for _ in range(rounds):
                tree = grow(own[known], (y - guess)[known], bins, depth, least, 1.0)
                guess = guess + rate * np.array([value(tree, r) for r in own])
            out[rows, t] = guess
    return out


@pytest.mark.parametrize(("cells", "stage"), [(2_000_000, 16), (10, 2)])
def test_against_numpy(spark, monkeypatch, cells, stage):
    monkeypatch.setattr(trees, "STAGE_TREES", stage)
    data = table(500)
    df = frame(spark, data)
    if cells == 10:
        # the number is read in tasks: a table of many models has the same path
        monkeypatch.setattr(trees, "HELD_CELLS", cells)
    model = trees.boost(df, ["a", "b", "c", "d"], ["y", "z"], "kind", ~F.col("held"), None, trees=4, depth=3, rate=0.5, bins=10, least=5)
    got = {r.id: (r.prediction_y, r.prediction_z) for r in trees.predict(df, model).collect()}
    want = twin(model, data, 4, 3, 0.5, 10, 5)
    np.testing.assert_allclose([got[i] for i in range(len(want))], want, rtol=1e-9, atol=1e-9)


def test_stops_and_improves(spark, tmp_path):
    df = frame(spark, table())
    model = trees.boost(df, ["a", "b", "c", "d"], ["y"], "kind", ~F.col("held"), F.col("held"), trees=60, depth=3, rate=0.6, bins=16, least=5, patience=3, columns=0.75, rows=0.8)
    assert len(model.trees) < 60
    errors = {}
    for r in model.history(spark).collect():
        errors.setdefault(r.group, {})[r.trees] = r.mae
    for g, e in errors.items():
        k = int(model.best[model.groups.index(g)])
        assert e[k] == min(e.values()) and e[k] < 0.7 * e[0]
    kept = trees.predict(df.where("held"), model)
    for r in kept.where("y is not null").groupBy("kind").agg(F.avg(F.abs(F.col("prediction_y") - F.col("y"))).alias("mae")).collect():
        assert abs(r.mae - min(errors[r.kind].values())) < 1e-9
    used = {r.feature: r.gain for r in model.importances(spark).where("group = 'k1'").collect()}
    assert max(used, key=used.get) == "b"
    model.save(spark, str(tmp_path / "model"))
    again = trees.Model.load(spark, str(tmp_path / "model"))
    a, b = (sorted((r.id, r.prediction_y) for r in trees.predict(df, m).collect()) for m in (model, again))
    assert a == b


def test_monotone(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, (1500, 2))
    y = np.sin(3 * x[:, 0]) + x[:, 0] + x[:, 1] * rng.normal(size=1500)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    grid = spark.createDataFrame([(i, j, -2 + i * 0.05, -2.0 + j) for i in range(81) for j in range(5)], "i int, j int, a double, b double")
    for sign in (1, -1):
        model = trees.boost(df, ["a", "b"], ["y"], trees=4, depth=3, rate=0.6, bins=32, least=5, monotone={"a": sign})
        rows = {(r.i, r.j): r.prediction_y for r in trees.predict(grid, model).collect()}
        steps = [sign * (rows[i + 1, j] - rows[i, j]) for i in range(80) for j in range(5)]
        assert min(steps) >= -1e-12 and (sign < 0 or max(steps) > 0)
    free = trees.boost(df, ["a", "b"], ["y"], trees=4, depth=3, rate=0.6, bins=32, least=5)
    rows = {(r.i, r.j): r.prediction_y for r in trees.predict(grid, free).collect()}
    assert min(rows[i + 1, j] - rows[i, j] for i in range(80) for j in range(5)) < 0


def test_odd_tables(spark):
    df = frame(spark, table(60))
    none = trees.boost(df.where("id < 0"), ["a"], ["y"], "kind", trees=2)
    assert none.groups == [] and trees.predict(df, none).where("prediction_y is not null").count() == 0
    flat = trees.boost(df.withColumn("a", F.lit(1.0)), ["a"], ["y"], trees=3, least=1)
    mean = df.agg(F.avg("y")).first()[0]
    assert all(abs(r.prediction_y - mean) < 1e-9 for r in trees.predict(df.withColumn("a", F.lit(1.0)), flat).collect())
    other = trees.predict(df.withColumn("kind", F.lit("new")), trees.boost(df, ["a"], ["y"], "kind", trees=1, least=1))
    assert other.where("prediction_y is not null").count() == 0


def test_partial_dependence_and_mean(spark):
    """Counted by bins as predicted row by row; the mean of all groups' models as one after the other."""
    df = frame(spark, table())
    model = trees.boost(df, ["a", "b", "c"], ["y"], "kind", trees=3, depth=3, rate=0.5, bins=10, least=5)
    values = [-1, 0, 2, 5]
    got = {r.step: r.prediction_y for r in trees.partial_dependence(df, model, "b", values).collect()}
    for v in values:
        each = trees.predict(df.withColumn("b", F.lit(float(v))), model).agg(F.avg("prediction_y").alias("m")).first().m
        assert abs(got[v] - each) < 1e-9
    mean = {r.id: r.m for r in trees.predict_mean(df, model, ["m"]).collect()}
    alone = [{r.id: r.prediction_y for r in trees.predict(df.withColumn("kind", F.lit(g)), model).collect()} for g in model.groups]
    assert all(abs(m - sum(a[i] for a in alone) / len(alone)) < 1e-9 for i, m in mean.items())


def test_a_level_is_one_pass(spark):
    """Sums and validation errors come from one run over the rows."""
    import numpy as np

    made = spark.range(40).mapInArrow(lambda batches: batches, "id long").selectExpr("0 model", "0 node", "int(id % 2) - 1 feature", "int(id div 4) * int(id % 2) bin", "30D n", "double(id) g", "1D e")
    sums = made.repartition("model", "node", "feature").groupBy("model", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "g", "e")])
    low = np.full((1, 7), -np.inf)
    found = trees._splits(sums, 20, 1.0, np.zeros(1, dtype=np.int64), low, -low)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = {r.feature: r for r in found.collect()}
    assert set(rows) == {-1, 0} and rows[-1].nl == 600 and rows[-1].gr == 20
