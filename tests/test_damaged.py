"""Tables with unreadable files, and sources that only tests had not called."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from flightloom.operators import folds, models
from flightloom.sources import tables


def test_damaged_files_are_found_and_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    want = list(range(300))
    spark.range(300).repartition(4).write.parquet(path)
    spark.range(0).write.mode("append").parquet(path)
    assert tables.damaged(spark, path).count() == 0
    assert sorted(r.id for r in tables.readable(spark, path, lambda: 1 / 0).collect()) == want
    files = sorted(glob.glob(f"{path}/*.parquet"), key=os.path.getsize)
    for f, content in ((files[-1], b"PAR1 nothing"), (files[-2], b"")):
        with open(f, "wb") as out:
            out.write(content)
    for crc in glob.glob(f"{path}/.*.crc"):
        os.remove(crc)
    bad = tables.damaged(spark, path).collect()
    assert {os.path.basename(r.path) for r in bad} == {os.path.basename(f) for f in files[-2:]} and all(r.reason for r in bad)
    with pytest.raises(ZeroDivisionError):
        tables.readable(spark, path, lambda: 1 / 0)
    assert len(glob.glob(f"{path}/*.parquet")) == len(files)
    assert sorted(r.id for r in tables.readable(spark, path, lambda: spark.range(300)).collect()) == want
    assert len(glob.glob(f"{path}.damaged-*")) == 1 and not glob.glob(f"{path}.new-*")
    assert tables.readable(spark, str(tmp_path / "none"), lambda: spark.range(5)).count() == 5


def test_values_days_and_splits(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1, "d1"), (1, "b", 1, "d2"), (2, "a", 2, "d1"), (2, "a", 3, "d2")], "flight_id long, kind string, timestamp long, date string")
    df.write.parquet(str(tmp_path / "x"))
    assert sorted(r.kind for r in tables.values_of(spark, str(tmp_path / "x"), "kind").collect()) == ["a", "b"]
    assert sorted((r.flight_id, r.timestamp, r.kind) for r in tables.merge_days(df).collect()) == [(1, 1, "a"), (2, 2, "a"), (2, 3, "a")]
    rows = spark.range(5000).withColumn("held", folds.shuffle_split(F.col("id"), 0.2))
    share = rows.where("held").count() / 5000
    assert 0.17 < share < 0.23 and rows.exceptAll(spark.range(5000).withColumn("held", folds.shuffle_split(F.col("id"), 0.2))).isEmpty()
    assert models.aligned(df, ["timestamp", "new", "flight_id"]).columns == ["timestamp", "new", "flight_id"]
    assert {r.new for r in models.aligned(df, ["new"]).collect()} == {0.0}
