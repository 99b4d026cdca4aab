"""Queries with SQL give DuckDB's rows."""

import duckdb

from flightloom.llm import queries


def test_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS FROM '/root/testdata/sf0.01/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
        columns = sorted(df.columns)
        got = sorted(tuple(r) for r in df.select(*columns).collect())
        assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()) and got
