"""Levels of op1's family meet at the anchors that both have, without a look at all rows of a large one."""

import numpy as np
from pyspark.sql import functions as F

from flightloom.llm import repeats as R
from flightloom.llm import suffix_array as S


def _level(rng, n, anchors):
    columns = {k: rng.integers(0, 9, n) for k in S.Level.FIELDS if k not in ("right", "left", "flags", "h")}
    wide = {"right": rng.integers(0, 4, (n, 20)).astype(np.uint8), "left": rng.integers(0, 4, (n, 10)).astype(np.uint8), "flags": np.zeros((n, 11), dtype=bool)}
    return S.Level(R.Windows(20, 10, words=False, earlier=False), columns | wide | {"h": rng.integers(-anchors, anchors, n)})


def test_shared_anchors():
    rng = np.random.default_rng(2)
    for n, m, anchors in ((50, 800, 300), (800, 50, 300), (40, 40, 3), (5, 5, 10**9)):
        a, b = _level(rng, n, anchors), _level(rng, m, anchors)
        mine, theirs = a.shared(b)
        assert (mine == np.flatnonzero(np.isin(a.h, b.h))).all() and (theirs == np.flatnonzero(np.isin(b.h, a.h))).all()


def test_units_of_an_anchor_come_together(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.md5((F.col("id") % 7).cast("string").cast("binary")), 9), F.md5(F.col("id").cast("string").cast("binary"))).alias("text"))
    plan = S.substring_dedup(docs)._jdf.queryExecution().toString()
    assert "Sort [h" in plan
