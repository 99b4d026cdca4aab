"""The six-dimensional smoother against one dense system, and tracks rebuilt from end to end."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from flightloom.operators import smoother, trajectory
from flightloom.plans import rebuild


def dense(t, z):
    """States that make the squares of all errors, each over its variance, smallest."""
    n = len(t)
    rows, right = [], []

    def add(blocks, value, root):
        a = np.zeros((len(value), 6 * n))
        for i, m in blocks:
            a[:, 6 * i : 6 * i + 6] = root @ m
        rows.append(a)
        right.append(root @ value)

    start = np.array([z[np.flatnonzero(~np.isnan(z[:, k]))[0], k] for k in range(3)] + [0, 0, 0])
    add([(0, np.eye(6))], start, np.diag(smoother.START**-0.5))
    for i in range(1, n):
        f, q = smoother._step(t[i] - t[i - 1])
        add([(i - 1, -f), (i, np.eye(6))], np.zeros(6), np.linalg.inv(np.linalg.cholesky(q)))
    for i in range(n):
        for h, value, variance in smoother.readings(z[i]):
            add([(i, h[None, :])], np.array([value]), np.array([[variance**-0.5]]))
    return np.linalg.lstsq(np.vstack(rows), np.concatenate(right), rcond=None)[0].reshape(n, 6)


def flown(rng, n=25):
    t = np.cumsum(rng.uniform(0.5, 6, n))
    a = rng.uniform(0, 6)
    z = np.column_stack([200 * np.sin(a) * t + rng.normal(0, 40, n), 200 * np.cos(a) * t + rng.normal(0, 40, n), 3000 + 5 * t + rng.normal(0, 10, n), 200 + rng.normal(0, 2, n), (a + rng.normal(0, 0.03, n)) % (2 * np.pi), 5 + rng.normal(0, 1, n)])
    z[rng.random(z.shape) < 0.2] = np.nan
    return t, z


def test_equals_dense_least_squares():
    for seed in range(6):
        t, z = flown(np.random.default_rng(seed))
        np.testing.assert_allclose(smoother.smoothed(t, z, np.inf), dense(t, z), rtol=1e-5, atol=1e-3)


def test_outliers_do_not_count():
    rng = np.random.default_rng(9)
    t, z = flown(rng, 60)
    wild = z.copy()
    wild[30, :3] = [9e5, -9e5, 90000]
    assert abs(smoother.smoothed(t, wild, 3.0)[30] - smoother.smoothed(t, z, 3.0)[30])[:3].max() < 300


def track(name, n=80, hole=(30, 50), seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if hole[0] <= i < hole[1]:
            continue
        spike = 40000.0 if i == 12 else 0.0
        out.append((name, i * 1_000_000, i, 48 + i * 0.0014, 10 + i * 0.0021, 20000 + 10.0 * i + rng.gauss(0, 5) + spike, 430 + rng.gauss(0, 1), 45 + rng.gauss(0, 1), 600.0, 0.7, 420.0, 300.0))
    return out


SCHEMA = "flight_id string, us long, t long, latitude double, longitude double, altitude double, groundspeed double, track double, vertical_rate double, mach double, TAS double, CAS double"


def test_rebuilt(spark):
    rows = track("A") + track("B", hole=(0, 0), seed=1) + track("C", n=7) + track("D", hole=(20, 22), seed=2) + [("E", i * 1_000_000, i, None, 10.0, 1.0, 1.0, 1.0, 1.0, None, None, None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    kinds = spark.createDataFrame([("A", "k"), ("B", "k"), ("D", "k")], "flight_id string, kind string")
    speeds = trajectory.learn_speeds(df.join(kinds, "flight_id"), "kind")
    got = {}
    for r in rebuild.rebuild(df, fill=5, hole=5, kinds=kinds, speeds=speeds).collect():
        got.setdefault(r.flight_id, {})[r.t] = r
    assert set(got) == {"A", "B", "D"}
    for rows in got.values():
        # outliers at the very ends have no second side to be interpolated from
        assert sorted(rows) == list(range(min(rows), max(rows) + 1)) and min(rows) <= 5 and max(rows) >= 74
    # five seconds are interpolated, the hole begins after them
    made = [t for t in got["A"] if got["A"][t].is_reconstructed]
    assert set(range(36, 49)) <= set(made) <= set(range(33, 52))
    assert not any(r.is_reconstructed for r in got["B"].values()) and not any(r.is_reconstructed for r in got["D"].values())
    for name in ("A", "B", "D"):
        for t, r in got[name].items():
            assert r.smoothed and abs(r.latitude - (48 + t * 0.0014)) < 0.001 and abs(r.longitude - (10 + t * 0.0021)) < 0.001
            assert abs(r.altitude - (20000 + 10 * t)) < 150 and abs(r.groundspeed - 430) < 60


def test_kinds_without_speeds_stay_open(spark):
    df = spark.createDataFrame(track("A") + track("Z", seed=5), SCHEMA)
    kinds = spark.createDataFrame([("A", "k"), ("Z", "rare")], "flight_id string, kind string")
    speeds = trajectory.learn_speeds(df.where("flight_id = 'A'").join(kinds, "flight_id"), "kind")
    rows = rebuild.rebuild(df, fill=5, hole=5, kinds=kinds, speeds=speeds, clean=False).groupBy("flight_id").count().collect()
    assert {r.flight_id: r["count"] for r in rows} == {"A": 80, "Z": 65}


def test_one_bad_track_leaves_the_others(spark):
    good = [("g", i, 200.0 * i, 100.0 * i, 1000.0, 400.0, 60.0, 0.0) for i in range(20)]
    bad = [("b", i, float("inf") if i == 3 else 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(20)]
    df = spark.createDataFrame(good + bad, "e string, t long, x double, y double, altitude double, groundspeed double, track double, vertical_rate double")
    found = {r.e: r for r in smoother.smooth(df, "e", "t").groupBy("e").agg(F.min(F.col("smoothed").cast("int")).alias("all"), F.max(F.col("smoothed").cast("int")).alias("any"), F.count("*").alias("n")).collect()}
    assert found["g"].all == 1 and found["b"].n == 20 and math.isclose(found["g"].n, 20)


def test_spikes_are_cleaned(spark):
    df = spark.createDataFrame(track("A", hole=(0, 0)), SCHEMA)
    out = rebuild.cleaned(df, "flight_id", "us", F.col("t"))
    assert max(r.altitude for r in out.collect() if r.altitude is not None) < 22000


def test_interval_table_has_its_segments(spark):
    """The composed table holds what its parts give on their own; intervals without readings stay."""
    from flightloom import queries  # noqa: F401  the query modules are imported by it
    from flightloom.plans import driver, profiles
    from flightloom.plans.tables import intervals
    from flightloom.profile_queries import BUCKET, _readings

    data = "/root/testdata/sf0.001"
    readings, every = _readings(spark, data).drop("kind"), intervals(spark, data)
    empty = every.limit(1).withColumns({"idx": F.lit(-1).cast("long"), "i_start": F.lit(1).cast("long"), "i_end": F.lit(2).cast("long")})
    out = driver.interval_table(readings, every.unionByName(empty), bucket=BUCKET, segments=3).select("idx", "tas_mean", "seg01_altitude_mean", "between_alt_trend", "flight_n_points")
    got = {r.idx: r for r in out.collect()}
    assert len(got) == every.count() + 1 and got[-1].tas_mean is None and got[-1].flight_n_points > 0
    cut = trajectory.segments(every, "i_start", "i_end", n=3)
    from flightloom.operators import joins

    inside = joins.points_in_intervals(readings, cut, "flight_id", "t", "seg_start", "seg_end", bucket=BUCKET)
    long = profiles.segment_profile(profiles.with_motion(inside, ["idx", "seg"]), ["idx", "seg"]).where("seg = 1").select("idx", "altitude_mean").collect()
    assert long and all(got[r.idx].seg01_altitude_mean == r.altitude_mean for r in long)
