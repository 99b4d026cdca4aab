"""Exact percentiles of whole columns, without a task that holds all distinct values.

An interpolated percentile needs one or two values by rank.  Approximate
percentiles bracket each wanted rank, one pass counts what lies below and inside
each bracket, and the brackets shrink until few values are left in them; those
alone are sorted.  The approximation decides how fast that goes, not the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Values of a bracket that one aggregation buffer may hold.
FEW = 20_000
#: Accuracy of the approximate percentiles.
ACCURACY = 10_000


@dataclass
class Bracket:
    """The value of number `rank` (from 0) of a column, known to lie between low and high (both outside; None: no bound)."""

    column: str
    rank: int
    count: int
    low: float | None = None
    high: float | None = None
    before: int = 0
    inside: int = 0
    value: float | None = None

    def rows(self) -> Column:
        v = F.col(self.column)
        out = v.isNotNull()
        if self.low is not None:
            out = out & (v > F.lit(self.low))
        if self.high is not None:
            out = out & (v < F.lit(self.high))
        return out


def exact(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """The percentiles (0 to 1, interpolated as `percentile` does) of each column, None where it has no value.

    NULLs do not count, NaN counts as the largest value.  Two passes for each
    shrinking of the brackets, by some thousand times each."""
    columns = [c for c, qs in wanted.items() if qs]
    if not columns:
        return {c: [] for c in wanted}
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    brackets: dict[tuple[str, int], Bracket] = {}
    for c in columns:
        for q in wanted[c]:
            at = q * (counts[c] - 1)
            for k in {floor(at), min(floor(at) + 1, counts[c] - 1)} if counts[c] else ():
                brackets[c, k] = Bracket(c, k, counts[c], inside=counts[c])
    while any(b.value is None and b.inside > FEW for b in brackets.values()):
        _shrink(df, [b for b in brackets.values() if b.value is None and b.inside > FEW])
    _gather(df, [b for b in brackets.values() if b.value is None])

    def value(c: str, q: float) -> float | None:
        if not counts[c]:
            return None
        at = q * (counts[c] - 1)
        low, high = brackets[c, floor(at)].value, brackets[c, min(floor(at) + 1, counts[c] - 1)].value
        return low if low == high else low * (floor(at) + 1 - at) + high * (at - floor(at))

    return {c: [value(c, q) for q in wanted[c]] for c in wanted}


def _shrink(df: DataFrame, todo: list[Bracket]) -> None:
    slack = 2.0 / ACCURACY
    # ranks between the same bounds share one summary of what lies there
    cuts: dict[tuple[str, float | None, float | None], list[float]] = {}
    places = []
    for b in todo:
        at = (b.rank - b.before) / max(1, b.inside - 1)
        own = cuts.setdefault((b.column, b.low, b.high), [])
        places.append(((b.column, b.low, b.high), len(own)))
        own += [max(0.0, at - slack), min(1.0, at + slack)]
    rows = {(b.column, b.low, b.high): b.rows() for b in todo}
    summaries = df.agg(*[F.percentile_approx(F.when(rows[g], F.col(g[0])), F.array(*[F.lit(x) for x in own]), ACCURACY) for g, own in cuts.items()]).first()
    held = dict(zip(cuts, summaries, strict=True))
    found = [held[g][i : i + 2] for g, i in places]
    counted = []
    for k, b in enumerate(todo):
        v, (low, high) = F.col(b.column), found[k]
        counted += [F.count(F.when(v.isNotNull() & x, 1)).alias(f"{n}{k}") for n, x in (("lt", v < F.lit(low)), ("at", v == F.lit(low)), ("to", v < F.lit(high)), ("top", v == F.lit(high)))]
    n = df.agg(*counted).first()
    for k, b in enumerate(todo):
        low, high = found[k]
        below, upto = n[f"lt{k}"], n[f"to{k}"]
        first, last = below + n[f"at{k}"], upto + n[f"top{k}"]
        if b.rank < below:
            b.high, b.inside = low, below - b.before
        elif b.rank < first:
            b.value = low
        elif b.rank < upto:
            b.low, b.high, b.before, b.inside = low, high, first, upto - first
        elif b.rank < last:
            b.value = high
        else:
            b.inside = b.inside - (last - b.before)
            b.low, b.before = high, last


def _gather(df: DataFrame, todo: list[Bracket]) -> None:
    """Sorts what is left in each bracket, FEW values at most."""
    if not todo:
        return
    row = df.agg(*[F.sort_array(F.collect_list(F.when(b.rows(), F.col(b.column))))[b.rank - b.before].alias(f"v{k}") for k, b in enumerate(todo)]).first()
    for k, b in enumerate(todo):
        b.value = row[f"v{k}"]


#: Distinct values that one task may sort.
PART_ROWS = 200_000


def by_group(df: DataFrame, keys: list[str], column: str, qs: list[float], names: list[str]) -> DataFrame:
    """(keys, names): exact percentiles of each group (NULL is a key of its own), interpolated as `percentile` does; NULL for groups without a value.

    Values are counted first, so that ties cost nothing; the counts are dealt out by
    ranges of group and value, and a group of any size lies in as many tasks as it
    needs.  What lies before a part of a group is a small table."""
    weights = df.groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count(column).alias("_n"))
    parts = -(-weights.count() // PART_ROWS)
    if parts > 1:
        weights = staged(weights.repartitionByRange(parts, *keys, "_v").withColumn("_part", F.spark_partition_id()))
    else:
        weights = weights.withColumn("_part", F.lit(0))
    sums = weights.groupBy(*keys, "_part").agg(F.sum("_n").alias("_here"))
    group = Window.partitionBy(*keys)
    # a row for each task that a group lies in
    sums = sums.withColumns({"_before": F.sum("_here").over(group.orderBy("_part")) - F.col("_here"), "_all": F.sum("_here").over(group)})
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    ranked = weights.where("_n > 0").withColumn("_inside", inside)
    same = [ranked[k].eqNullSafe(sums[k]) for k in keys] + [ranked["_part"] == sums["_part"]]
    upto = ranked.join(sums, same).select(*[ranked[k].alias(k) for k in keys], "_v", (F.col("_before") + F.col("_inside")).alias("_upto"), "_all")
    columns = []
    for k, q in enumerate(qs):
        at = (F.col("_all") - 1) * F.lit(float(q))
        low = F.floor(at)
        first, second = (F.min(F.when(F.col("_upto") > x, F.col("_v"))) for x in (low, F.least(low + 1, F.col("_all") - 1)))
        share = F.max(at - low)
        columns.append(F.when(first == second, first).otherwise(first * (1 - share) + second * share).alias(names[k]))
    found = upto.groupBy(*keys).agg(*columns)
    every = df.select(*keys).distinct()
    return every.join(found, [every[k].eqNullSafe(found[k]) for k in keys], "left").select(*[every[k] for k in keys], *names)
