"""Tracks, intervals and dimensions drawn from the driver's tables, with the same definitions as SQL.

`events` stands for the surveillance readings: a user is a flight, an event one
reading whose physical values follow from its id and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> expression that Spark and DuckDB both understand (e: event_id as bigint, x: value).
READINGS = {
    "altitude": "CASE WHEN e % 13 = 0 THEN NULL ELSE x * 90 END",
    "groundspeed": "100 + x",
    "track": "CAST(e * 37 % 360 AS DOUBLE)",
    "vertical_rate": "CAST(e * 53 % 6001 - 3000 AS DOUBLE)",
    "latitude": "40 + CAST(e * 17 % 1000 AS DOUBLE) / 100",
    "longitude": "5 + CAST(e * 7 % 1000 AS DOUBLE) / 100",
    "mach": "CASE WHEN e % 5 = 0 THEN NULL ELSE CAST(30 + e % 61 AS DOUBLE) / 100 END",
    "TAS": "CASE WHEN e % 4 = 0 THEN NULL ELSE 90 + x * 1.1D END",
    "CAS": "CASE WHEN e % 3 = 0 THEN NULL ELSE 80 + x * 0.8D END",
    "temp_k": "CAST(220 + e % 70 AS DOUBLE)",
    "u": "CAST(e % 41 - 20 AS DOUBLE)",
    "v": "CAST(e % 31 - 15 AS DOUBLE)",
    "flow": "CASE WHEN e % 17 = 0 THEN NULL ELSE 500 + x * 3 END",
}

_DUCK = {k: s.replace("1.1D", "1.1::DOUBLE").replace("0.8D", "0.8::DOUBLE") for k, s in READINGS.items()}

TRACKS = f"""
    tracks AS (
        SELECT user_id AS flight_id, event_id AS pid, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS t, event_type AS kind, {", ".join(f"{s} AS {k}" for k, s in _DUCK.items())}
        FROM (SELECT *, event_id AS e, value AS x FROM events)
    )"""

INTERVALS = f"""{TRACKS},
    spans AS (SELECT flight_id, min(t) AS a, max(t) AS b FROM tracks GROUP BY ALL),
    intervals AS (
        SELECT flight_id, flight_id * 8 + i AS idx, a + (b - a) * i // 8 AS i_start, a + (b - a) * (i + 1) // 8 AS i_end
        FROM spans, range(8) r(i)
    )"""

FLIGHTS = """
    flights AS (
        SELECT user_id AS flight_id, 'T' || (user_id % 7) AS typ, (user_id % 25)::INTEGER AS origin, (user_id * 3 % 25)::INTEGER AS destination,
               60000.0::DOUBLE + user_id % 10 * 1000 AS tow, 40000.0::DOUBLE + user_id % 7 * 500 AS oew, 65000.0::DOUBLE + user_id % 7 * 300 AS mtow
        FROM (SELECT DISTINCT user_id FROM events)
    )"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
    named = events.withColumns({"e": F.col("event_id"), "x": F.col("value"), "us": F.expr(us)})
    return named.select(F.col("user_id").alias("flight_id"), F.col("event_id").alias("pid"), "us", F.expr("us div 1000000").alias("t"), F.col("event_type").alias("kind"), *[F.expr(s).alias(k) for k, s in READINGS.items()])


def intervals(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """n intervals a flight from its first to its last reading; bounds are shared."""
    spans = tracks(spark, sf_dir).groupBy("flight_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    dealt = spans.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.select("flight_id", (F.col("flight_id") * n + F.col("i")).alias("idx"), F.expr(f"a + (b - a) * i div {n}").alias("i_start"), F.expr(f"a + (b - a) * (i + 1) div {n}").alias("i_end"))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return users.select(
        F.col("user_id").alias("flight_id"), F.concat(F.lit("T"), F.expr("user_id % 7").cast("string")).alias("typ"),
        F.expr("cast(user_id % 25 as int)").alias("origin"), F.expr("cast(user_id * 3 % 25 as int)").alias("destination"),
        F.expr("60000D + user_id % 10 * 1000").alias("tow"), F.expr("40000D + user_id % 7 * 500").alias("oew"), F.expr("65000D + user_id % 7 * 300").alias("mtow"),
    )
