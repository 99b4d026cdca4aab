"""Edge cases of the trajectory operators on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flightloom.functions import atmosphere as A
from flightloom.functions import features as X
from flightloom.functions import geo as G
from flightloom.functions import phases as P
from flightloom.operators import folds, imputation, joins, physics, ranking, series, trajectory
from flightloom.sources import tables as T
from flightloom.streaming import events as stream


def values(spark, *columns, schema="x double", rows=((1.0,),)):
    return [tuple(r) for r in spark.createDataFrame(list(rows), schema).select(*columns).collect()]


def test_missing_values(spark):
    got = values(spark, A.clean(F.col("x")), A.ratio(F.lit(1.0), F.col("x")), A.clamp(F.col("x"), 0, 5), rows=[(float("nan"),), (float("inf"),), (0.0,), (None,), (9.0,)])
    assert [g[0] for g in got] == [None, None, 0.0, None, 9.0]
    assert got[2][1] is None and got[3] == (None, None, None) and got[4][2] == 5.0


def test_standard_atmosphere(spark):
    (t0, p0, t11, p11), = values(spark, A.isa_temperature(F.lit(0.0)), A.isa_pressure(F.lit(0.0)), A.isa_temperature(F.lit(12000.0)), A.isa_pressure(F.lit(11000.0)))
    assert (t0, p0, t11) == (288.15, 101325.0, 216.65) and abs(p11 - 22632) < 5


def test_angles(spark):
    got = values(spark, G.angle_between(F.col("a"), F.col("b")), G.signed_turn(F.col("a"), F.col("b")), G.interpolate_angle(F.col("a"), F.col("b"), F.lit(0.5)), schema="a double, b double", rows=[(350.0, 10.0), (10.0, 350.0), (0.0, 180.0)])
    assert [round(x, 9) for x in got[0]] == [20, 20, 0] and [round(x, 9) for x in got[1]] == [20, -20, 0] and got[2][0] == 180


def test_great_circle(spark):
    lat, lon = G.interpolate_position(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.5))
    (a, b, d), = values(spark, lat, lon, G.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert abs(a) < 1e-9 and abs(b - 45) < 1e-9 and abs(d - math.pi / 2 * G.R_METRES) < 1e-3


def test_phase_arms(spark):
    rows = [(400.0, 0.0, "ground"), (500.0, 500.0, "cruise"), (500.0, 501.0, "climb"), (10000.0, 301.0, "climb"), (10000.0, -300.0, "cruise"), (None, -301.0, "descent"), (20000.0, None, "cruise")]
    got = values(spark, P.flight_phase(F.col("v"), F.col("h")), F.col("want"), schema="h double, v double, want string", rows=rows)
    assert all(a == b for a, b in got)


def test_buckets_close_on_the_named_side(spark):
    got = values(spark, X.bucket(F.col("x"), [0, 0.1, 1], ["a", "b"]), X.bucket(F.col("x"), [0, 0.1, 1], ["a", "b"], right=False), rows=[(0.0,), (0.1,), (1.0,), (None,)])
    assert got == [(None, "a"), ("a", "b"), ("b", None), (None, None)]


def test_names(spark):
    assert X.is_non_negative("int_fuel_flow_mean") and not X.is_non_negative("altitude_change")
    assert values(spark, X.synonym(F.col("s"), {"a20n": "A320"}), schema="s string", rows=[("A20N",), ("b738",), (None,)]) == [("A320",), ("B738",), (None,)]
    assert T.next_version(["run_v2.csv", "run_v10.csv", "x"]) == 11 and T.next_version([]) == 1


@pytest.mark.parametrize("limit", [1, 3, None])
@pytest.mark.parametrize("inside", [False, True])
def test_interpolation_like_pandas(spark, limit, inside):
    x = pd.Series([np.nan, np.nan, 1, np.nan, np.nan, np.nan, np.nan, 6, np.nan, 8, np.nan, np.nan])
    kw = {"limit_area": "inside", "limit_direction": "forward"} if inside else {"limit_direction": "both"}
    want = x.interpolate(limit=limit, **kw)
    df = spark.createDataFrame([(1, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "e int, i int, x double")
    got = [r.x for r in series.interpolate(df, "e", "i", ["x"], limit, inside).orderBy("i").collect()]
    assert [None if np.isnan(v) else round(v, 9) for v in want] == [None if v is None else round(v, 9) for v in got]


def test_trailing_window_is_half_open(spark):
    df = spark.createDataFrame([(1, t * 1_000_000, float(t)) for t in (0, 10, 15)], "e int, us long, x double")
    got = df.select("us", series.trailing_mean(F.col("x"), "e", "us", 10).alias("m"), series.forward_mean(F.col("x"), "e", "us", 10).alias("f")).orderBy("us").collect()
    assert [r.m for r in got] == [0.0, 10.0, 12.5] and [r.f for r in got] == [0.0, 12.5, 15.0]


def test_runs_and_gaps(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in [(0, 0.0), (29, 1.0), (60, 500.0), (105, 2.0), (150, 3.0), (30000, 4.0)]], "e int, t long, vr double")
    got = series.runs(df, "e", "t", F.abs("vr") < 100, F.col("t"), 30).collect()
    assert [(r.n_runs, r.total_s) for r in got] == [(1, 29895)]
    assert [r.gap_s for r in series.gaps(df, "e", "t", 30, 28800).orderBy("gap_end").collect()] == [31, 45, 45]


def test_points_on_edges_belong_to_both(spark):
    points = spark.createDataFrame([(1, 10), (1, 20), (1, 30), (2, 10)], "e int, t long")
    spans = spark.createDataFrame([(1, 1, 10, 20), (1, 2, 20, 30), (1, 3, 100, 110)], "e int, idx int, a long, b long")
    for bucket in (None, 7):
        got = joins.points_in_intervals(points, spans, "e", "t", "a", "b", bucket).select("idx", "t").collect()
        assert sorted(tuple(r) for r in got) == [(1, 10), (1, 20), (2, 20), (2, 30)]


def test_nearest_in_time(spark):
    left = spark.createDataFrame([(1, "x", 100), (2, "x", 200), (3, "x", 10_000), (4, "y", 0)], "id int, s string, t long")
    right = spark.createDataFrame([("x", 90, 1), ("x", 110, 2), ("x", 7300, 3), ("x", 2800, 4), ("x", 17_201, 5)], "s string, valid long, r int")
    got = {r.id: r.r for r in joins.nearest_in_time(left, right, "s", "t", "valid", 7200, ["id"], "r").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: None}


def test_log_pressure_clips(spark):
    df = spark.createDataFrame([([(100, 1.0), (1000, 2.0)], p) for p in (50.0, 100.0, 316.22776601683796, 2000.0)] + [(None, 5.0)], "l array<struct<level:int,val:double>>, p double")
    assert [r[0] and round(r[0], 9) for r in df.select(joins.log_pressure(F.col("l"), F.col("p"))).collect()] == [1.0, 1.0, 1.5, 2.0, None]


def test_mass_recursion(spark):
    flows = [1000.0, 2000.0, None, 90_000.0, 500.0]
    df = spark.createDataFrame([(1, i, 60.0, 10_000.0, f) for i, f in enumerate(flows)], "e int, i int, dt double, tow double, f double")
    got = [r.mass for r in physics.mass_recursion(df, "e", "i", "tow", lambda m, p: p["f"] * m / 10_000, ["f"], "dt").orderBy("i").collect()]
    m, want = 10_000.0, []
    for i, f in enumerate(flows):
        if i:
            burn = flows[i - 1] * m / 10_000 / 60 if flows[i - 1] is not None else 0.0
            m = max(m - burn, 5000.0)
        want.append(m)
    assert np.allclose(got, want)


def test_trapezoid(spark):
    df = spark.createDataFrame([(1, 0, 3600.0), (1, 1, 3600.0), (2, 0, 5.0), (3, 0, 1.0), (3, 1, None), (4, 0, -9.0), (4, 9, -9.0)], "k int, t long, f double")
    assert {r.k: r.kg for r in physics.trapezoid(df, ["k"], "t", "f").collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_hierarchy_of_groups(spark):
    rows = [("a", 1, v, 1.0) for v in (1.0, 2.0, 3.0, 4.0, 5.0)] + [("a", 1, None, 1.0), ("a", 2, 9.0, 0.0), ("a", 2, None, 1.0), ("b", 1, None, 1.0), (None, 1, None, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p int, v double, w double")
    for median in (False, True):
        got = {r.i: r.v for r in imputation.hierarchical(df, "v", "w", [["t", "p"], ["t"]], [5, 1], median).collect()}
        assert got[5] == 3.0 and got[7] == 3.0 and got[8] == got[9] == 3.0 and got[0] == 1.0


def test_columns_by_content(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, None), (3, 1.0, 4.0)], "a int, b double, c double")
    assert imputation.constant_columns(df, ["a", "b", "c"]) == ["b", "c"] and imputation.sparse_columns(df, ["a", "b", "c"], 0.5) == ["c"]
    assert [r.c for r in imputation.medians(df, ["c"]).collect()] == [4.0] * 3


def test_last_fold_takes_the_remainder(spark):
    df = spark.createDataFrame([(f, f * 10) for f in range(11)], "f int, t long")
    assert sorted(r.fold for r in folds.time_folds(df, "f", "t", 3).collect()) == [0] * 3 + [1] * 3 + [2] * 5


def test_synthesised_speed_runs_over_from_the_ends(spark):
    """Five rows each side: the first is the reading before the hole, the last a step short of the one after it."""
    rows = [(1, t, 50.0 + t / 1000, 5.0, 30_000.0, 90.0, 0.78, 280.0, tas, 450.0) for t, tas in ((0, 100.0), (41, 300.0))]
    df = spark.createDataFrame(rows, "flight_id int, t long, latitude double, longitude double, altitude double, track double, mach double, CAS double, TAS double, groundspeed double")
    holes = trajectory.ends_of_gaps(df, "flight_id", "t", ["latitude", "longitude", "altitude", "track", "mach", "CAS", "TAS", "groundspeed"])
    got = [r.TAS for r in trajectory.synthesize(holes, "flight_id", "t").orderBy("t").collect()]
    middle = got[20]
    assert len(got) == 40 and got[0] == pytest.approx(100.0) and got[1] == pytest.approx(80 + middle / 5) and got[34] == pytest.approx(middle) and got[39] == pytest.approx(middle / 5 + 240)


def test_ranks_and_weighted_median_by_parts(spark):
    rows = [(i, (i * 7919) % 1000 / 10, float(1 + i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v double, w double")
    got = ranking.ranked(df, [F.col("v"), F.col("id")], "place", part_rows=200).orderBy("place").collect()
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [(r.place, r.id) for r in got] == [(n, r[0]) for n, r in enumerate(want)]
    total, upto = sum(r[2] for r in rows), 0.0
    for _, v, w in sorted(rows, key=lambda r: r[1]):
        upto += w
        if upto >= total / 2:
            break
    assert ranking.weighted_median(df, "v", "w", parts=50).first()["wmedian"] == v
    assert ranking.ranked(df.limit(0), [F.col("v")], "place").count() == 0


def test_continued_run_and_unreadable_table(spark, tmp_path):
    todo, path = spark.range(100), str(tmp_path / "done")
    seen = []

    def work(part):
        seen.append(part.count())
        if len(seen) == 3:
            raise RuntimeError("stopped")
        return part

    with pytest.raises(RuntimeError):
        T.continued(spark, todo, ["id"], path, work, 4)
    first = sum(seen[:2])
    out = T.continued(spark, todo, ["id"], path, work, 4)
    assert out.count() == out.distinct().count() == 100 and sum(seen[3:]) == 100 - first
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    assert T.readable(spark, str(broken), lambda: spark.range(3)).count() == 3


def test_gap_synthesis_and_smoothing(spark):
    rows = [(1, t, 50.0 + t / 1000, 5.0, 30_000.0, 90.0, 0.78, 280.0, 450.0) for t in (0, 10, 60, 70)]
    df = spark.createDataFrame(rows, "flight_id int, t long, latitude double, longitude double, altitude double, track double, mach double, CAS double, groundspeed double")
    holes = trajectory.ends_of_gaps(df, "flight_id", "t", ["latitude", "longitude", "altitude", "track", "mach", "CAS", "groundspeed"])
    got = trajectory.synthesize(holes, "flight_id", "t").orderBy("t").collect()
    assert [r.t for r in got] == list(range(11, 60)) and {r.phase for r in got} == {"cruise"} and all(r.vertical_rate == 0 and 440 < r.TAS < 460 for r in got)
    soft = trajectory.smooth_at_gaps(df, "flight_id", "t", {"groundspeed": 10.0, "track": 2.0}).collect()
    assert all(abs(r.groundspeed - 450) < 1e-9 and abs(r.track - 90) < 1e-9 for r in soft)
    noisy = spark.createDataFrame([(1, t, 100.0 + 2 * t + (500 if t == 30 else (-1) ** t)) for t in range(60)], "e int, t long, x double")
    smooth = [r.x for r in trajectory.kalman(noisy, "e", "t", ["x"]).orderBy("t").collect()]
    assert max(abs(x - 100 - 2 * t) for t, x in enumerate(smooth)) < 3
    hampel = [r.x for r in trajectory.sigma_filter(noisy, "e", "t", ["x"]).orderBy("t").collect()]
    assert hampel[30] is None and sum(x is None for x in hampel) < 6


def test_segments(spark):
    spans = spark.createDataFrame([(1, 0, 100)], "idx int, a long, b long")
    seg = trajectory.segments(spans, "a", "b", 4).orderBy("seg").collect()
    assert [(r.seg_start, r.seg_end) for r in seg] == [(0, 25), (25, 50), (50, 75), (75, 100)]
    long = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (1, 2, 4.0), (1, 3, None)], "idx int, seg int, x double")
    assert [r.x for r in trajectory.fill_from_neighbours(long, "idx", ["x"]).orderBy("seg").collect()] == [2.0, 3.0, 4.0, 4.0]
    wide = trajectory.pivot_segments(long, ["idx"], ["x"], 4).first()
    assert (wide.seg00_x, wide.seg01_x, wide.seg02_x) == (2.0, None, 4.0)


def test_sources(spark, tmp_path):
    from pyspark.sql.types import DoubleType, StructType

    a = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    a.coalesce(1).write.parquet(str(tmp_path / "d"))
    got = T.tracks(spark, str(tmp_path / "d"), StructType().add("x", DoubleType())).collect()
    assert {r.x for r in got} == {1.0, None} and all(r.flight_id.startswith("part-") for r in got)
    (tmp_path / "m.csv").write_text("station,valid,elevation\n# note\nAB,2024-01-01 00:00:00,3\n")
    assert T.reports(spark, str(tmp_path / "m.csv")).first().station == "AB"
    assert T.reports(spark, str(tmp_path / "none.csv")).count() == 0
    b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, v string")
    c = spark.createDataFrame([(2, "x", 1), (3, "y", 1)], "k int, v string, w int")
    assert {(r.k, r.v) for r in T.first_of(b, c, ["k"]).collect()} == {(1, "p"), (2, "q"), (3, "y")}
    assert T.splits({"train": b, "rank": c}).where("w is null").count() == 2 and T.not_done(c, b, ["k"]).count() == 1
    T.write(b, str(tmp_path / "o"), ["k"])
    T.write_report(b, str(tmp_path / "r"))
    T.write_report(b, str(tmp_path / "j"), "json")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    batch = spark.read.parquet(str(tmp_path / "e"))
    live = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e"))
    q = stream.tumbling(live, "ts", ["event_type"], "value", "6 hours", late="1 day").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == batch.count()
