"""The k nearest rows in several features, exactly, by boxes.

Known rows are dealt into boxes by a tree of cuts (from a sample; it only decides
how even the boxes are).  Their bounds are a small table on the driver.  A row first
looks into the box nearest to it; the k-th distance found there bounds the boxes that
could hold anything nearer, and only those are looked into.  Boxes meet rows in
blocks, so one that many rows fall into is many tasks.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, frexp, isfinite, ldexp, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Known rows of a box, boxes at most, and sampled rows for each of them.
BOX_ROWS, MOST_BOXES, SAMPLED = 4_000, 8_192, 16
#: Asking rows that meet a box in one task.
ASKING = 20_000


class Cuts:
    """A tree of cuts as a heap: inner node i halves its rows at cut[i] of feature[i]."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.feature, self.cut = np.zeros(2**depth, dtype=np.int64), np.zeros(2**depth)
        self._halve(points, 1, 0)

    def _halve(self, points: np.ndarray, node: int, level: int) -> None:
        if level == self.depth:
            return
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(points.shape[1])
        f = int(np.argmax(spread))
        c = float(np.median(points[:, f])) if len(points) else 0.0
        self.feature[node], self.cut[node] = f, c
        low = points[:, f] <= c
        self._halve(points[low], 2 * node, level + 1)
        self._halve(points[~low], 2 * node + 1, level + 1)

    def box(self, points: np.ndarray) -> np.ndarray:
        at, rows = np.ones(len(points), dtype=np.int64), np.arange(len(points))
        for _ in range(self.depth):
            at = 2 * at + (points[rows, self.feature[at]] > self.cut[at])
        return at - 2**self.depth


def _exact_sums(rows: DataFrame, terms: dict[str, tuple[Column, float]], n: int) -> dict[str, Fraction]:
    """Sums of n rows of doubles ({name: (term, bound of its absolute value)}) that do not depend on how rows are dealt.

    A term is cut into two multiples of powers of two, so coarse that a double holds
    all their partial sums exactly; what is left is below 2 ** -60 of the bound."""

    def grid(top: float) -> float:
        return ldexp(1.0, max(frexp(top)[1] + n.bit_length() - 53, -1000))

    parts = []
    for name, (x, top) in terms.items():
        coarse = grid(top)
        fine = grid(coarse)
        high = F.rint(x / F.lit(coarse)) * F.lit(coarse)
        parts += [F.sum(high).alias(f"h_{name}"), F.sum(F.rint((x - high) / F.lit(fine)) * F.lit(fine)).alias(f"l_{name}")]
    sums = rows.agg(*parts).first()
    return {name: Fraction(sums[f"h_{name}"]) + Fraction(sums[f"l_{name}"]) for name in terms}


def _moments(rows: DataFrame, features: list[str]) -> tuple[int, dict[str, tuple[float, float]]]:
    """The number of rows, and each feature's mean and standard deviation, the same however rows are dealt.

    Their last bits decide between rows that are equally far on paper."""
    x = {c: F.col(c).cast("double") for c in features}
    first = rows.agg(*[F.max(F.abs(v)).alias(f"t_{c}") for c, v in x.items()], *[f(v).alias(f"{n}_{c}") for c, v in x.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(F.lit(1)).alias("n")).first()
    n, tops = first["n"], {c: first[f"t_{c}"] for c in features}
    if not n:
        return 0, {}
    found = {c: (first[f"m_{c}"], first[f"s_{c}"]) for c in features}
    # where squares leave the range of doubles, or values are not finite, the plain ones stay
    plain = [c for c in features if isfinite(tops[c]) and tops[c] < 1e150]
    if plain:
        mean = {c: float(s / n) for c, s in _exact_sums(rows, {c: (x[c], tops[c]) for c in plain}, n).items()}
        off = {c: x[c] - F.lit(mean[c]) for c in plain}
        squares = _exact_sums(rows, {c: (off[c] * off[c], (tops[c] + abs(mean[c])) ** 2) for c in plain}, n)
        found |= {c: (mean[c], float(squares[c] / n) ** 0.5) for c in plain}
    return n, found


def _to_boxes(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for f in range(points.shape[1]):
        x = points[:, [f]]
        gap = np.maximum(np.maximum(low[:, f] - x, x - high[:, f]), 0.0)
        out += gap * gap
    return np.sqrt(out)


def _meet(asked: DataFrame, known: DataFrame, k: int, d: int) -> DataFrame:
    """(key, id, value, distance): the k nearest of each asking row in each box it is sent to.

    asked: key, p (array), box; known: box, id, value, p."""
    crowd = asked.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("parts"))
    parts = F.broadcast(crowd)
    left = asked.join(parts, "box").select("box", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), F.col("key"), "p")
    right = known.join(parts, "box").select("box", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "value", "p")
    schema = f"key {asked.schema['key'].dataType.simpleString()}, id {known.schema['id'].dataType.simpleString()}, value double, distance double"

    def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: [] for c in ("key", "id", "value", "distance")})
        if not len(mine) or not len(theirs):
            return empty
        b = theirs.sort_values("id", kind="stable")
        x, y = np.stack(mine["p"].to_numpy()), np.stack(b["p"].to_numpy())
        out = []
        block = max(1, 2_000_000 // len(y))
        for at in range(0, len(x), block):
            off = np.zeros((len(x[at : at + block]), len(y)))
            for f in range(d):
                off += (x[at : at + block, [f]] - y[:, f]) ** 2
            off = np.sqrt(off)
            kth = np.partition(off, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
            row, column = np.nonzero(off <= kth[:, None])
            # columns are in order of ids: of equal distances the smaller id
            order = np.lexsort((column, off[row, column], row))
            row, column = row[order], column[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, column = row[first], column[first]
            out.append(pd.DataFrame({"key": mine["key"].to_numpy()[at + row], "id": b["id"].to_numpy()[column], "value": b["value"].to_numpy()[column], "distance": off[row, column]}))
        return pd.concat(out)

    return left.groupBy("box", "part").cogroup(right.groupBy("box", "part")).applyInPandas(run, schema)


def k_nearest_mean(missing: DataFrame, known: DataFrame, key: str, features: list[str], value: str, k: int = 5) -> DataFrame:
    """Adds to `missing` the mean value of the k known rows nearest in standardised features (of equal distances the smaller key).

    Known rows need a value and all features; a row of `missing` without one of them
    gets NULL, and all known rows count where there are fewer than k.  Keys of
    `missing` are taken for unique: of rows with one key the first in features counts."""
    d = len(features)
    usable = known.where(F.col(value).isNotNull())
    for c in features:
        usable = usable.where(F.col(c).isNotNull())
    n_known, moments = _moments(usable, features)
    if not n_known:
        return missing.withColumn(value, F.lit(None).cast("double"))
    z = F.array(*[(F.col(c).cast("double") - F.lit(moments[c][0])) / F.lit(moments[c][1] or 1.0) for c in features])
    points = usable.select(F.col(key).alias("id"), F.col(value).cast("double").alias("value"), z.alias("p"))
    # of equal points only k can be among the nearest
    points = points.withColumn("_n", F.row_number().over(Window.partitionBy("p").orderBy("id"))).where(F.col("_n") <= k).drop("_n")
    depth = min(int(log2(MOST_BOXES)), max(0, ceil(log2(n_known / BOX_ROWS))))
    share = min(1.0, 2.0**depth * SAMPLED / n_known)
    sample = np.array([r.p for r in points.select("p").sample(share, seed=1).limit(2 * MOST_BOXES * SAMPLED).collect()]).reshape(-1, d) if depth else np.zeros((0, d))
    cuts = Cuts(sample, depth)

    @F.pandas_udf("int")
    def box_of(p: pd.Series) -> pd.Series:
        return pd.Series(cuts.box(np.stack(p.to_numpy()))) if len(p) else pd.Series([], dtype="int32")

    points = staged(points.withColumn("box", box_of("p")))
    bounds = points.groupBy("box").agg(F.array(*[F.min(F.col("p")[f]) for f in range(d)]).alias("low"), F.array(*[F.max(F.col("p")[f]) for f in range(d)]).alias("high")).collect()
    boxes = np.array([r.box for r in bounds])
    low, high = (np.array([r[n] for r in bounds]).reshape(-1, d) for n in ("low", "high"))

    @F.pandas_udf("int")
    def nearest_box(p: pd.Series) -> pd.Series:
        x = np.stack(p.to_numpy()) if len(p) else np.zeros((0, d))
        found = [boxes[np.argmin(_to_boxes(x[at : at + 512], low, high), axis=1)] for at in range(0, len(x), 512)]
        return pd.Series(np.concatenate(found) if found else [], dtype="int32")

    @F.pandas_udf("array<int>")
    def other_boxes(p: pd.Series, box: pd.Series, far: pd.Series) -> pd.Series:
        out = []
        for x, b, r in zip(p, box, far, strict=True):
            # rounding may put a box a hair further than what it holds
            near = _to_boxes(np.asarray(x)[None, :], low, high)[0] <= r * (1 + 1e-12) + 1e-12
            out.append(boxes[near & (boxes != b)].tolist())
        return pd.Series(out)

    asked = missing.select(F.col(key).alias("key"), z.alias("p")).where("key is not null and forall(p, x -> x is not null)").groupBy("key").agg(F.min("p").alias("p"))
    asked = staged(asked.withColumn("box", nearest_box("p")))
    first = staged(_meet(asked, points, k, d))
    far = first.groupBy("key").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(float("inf")).alias("far"))
    more = asked.join(far, "key").withColumn("box", F.explode(other_boxes("p", "box", "far"))).select("key", "p", "box")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("distance", "id"))
    best = first.unionByName(_meet(staged(more), points, k, d)).withColumn("_r", rank).where(F.col("_r") <= k)
    return missing.join(best.groupBy(F.col("key").alias(key)).agg(F.avg("value").alias(value)), key, "left")
