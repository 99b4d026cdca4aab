"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from flightloom import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-4)
    return a == b or str(a) == str(b)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple("" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in r))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({Q.ORACLES[name]})").fetchall()
    assert len(got) == len(want)
    keys = [i for i, c in enumerate(columns) if not any(isinstance(r[i], float) for r in got)]
    key = lambda r: tuple(str(r[i]) for i in keys)
    got, want = (ordered(sorted(rows, key=key)) for rows in (got, want))
    bad = [(a, b) for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True) if not all(map(same, a, b))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_session_and_without_llm(tmp_path):
    """The entry point needs no session to be imported, and no corpus operators."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(root, "flightloom"), copy / "flightloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), copy)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(Q.QUERIES)), str(len(Q.ORACLES))]
