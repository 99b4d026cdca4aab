"""Mixing sources to target weights with Pfair scheduling.

A source's documents are dealt into blocks of equal size in a fixed random
order.  Block k (from 0) of a source of weight w has release time floor(k / w)
and deadline ceil((k + 1) / w) in slots of one block; earliest deadline first
fills each slot from the released blocks.  Every source is then at every time
within less than one block of its target share.

Weights are exact fractions.  The slots are cut into rounds, so that no task
and not the driver walks through all of them: how many blocks each source has
had when a round begins follows from the weights alone (those that are due, and
of the others the ones with the earliest deadlines that can have been placed),
so each round is scheduled on its own, and blocks find their slots by a join.  A
round is as long as the smallest source takes for one block, at least.
A source that has no block left leaves, the weights of the others are made to
sum to 1 anew and the next epoch begins, until every document has a slot; only
the sources' counts decide where epochs begin.  Numbering the documents of a
source needs no sort of a whole source: hash buckets are counted, their counts
are added up, and rows are numbered inside their bucket.

The largest sources are scheduled by name.  All others are one scheduled source,
REST, inside which document k of a source of n documents and weight w comes at
the time (k + phase) / w, the phase a hash of the source's name: each has its
share of REST until its documents end, and the others share what it leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import ceil, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import staged, table

#: Documents of a block, and slots that are scheduled at once.
BLOCK_DOCS, ROUND = 16, 1000

#: Documents that a hash bucket is meant to hold.
BUCKET_DOCS = 20_000

#: Name under which weights have all sources that they do not name.
REST = None


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Positive weights as whole numbers in exactly the same proportions."""
    exact = {k: Fraction(v) for k, v in sorted(weights.items()) if v > 0}
    scale = lcm(*[x.denominator for x in exact.values()])
    return {k: int(x * scale) for k, x in exact.items()}


class Epoch:
    """The schedule while the same sources have blocks: weights (whole numbers), blocks that each has left, slots until one may end."""

    def __init__(self, weights: dict[str, int], left: dict[str, int]):
        self.names = sorted(weights)
        self.weight, self.left = [weights[s] for s in self.names], [left[s] for s in self.names]
        self.total = sum(self.weight)
        self.length = min(n * self.total // w for n, w in zip(self.left, self.weight, strict=True))
        #: Slots in which every source has a block.
        self.turn = -(-self.total // min(self.weight))

    def release(self, i: int, k: int) -> int:
        return k * self.total // self.weight[i]

    def deadline(self, i: int, k: int) -> int:
        return -(-(k + 1) * self.total // self.weight[i])

    def given(self, slot: int) -> list[int]:
        """Blocks of each source in the slots before `slot`: those due by then, then by deadline those that fit between the due ones.

        Only the last turn is looked at: before it, each source has a due block after any slot, and so nothing is in the way."""
        done = [w * slot // self.total for w in self.weight]
        low = max(0, slot - self.turn)
        # free[t]: blocks that can still be added to the slots from low + t on
        released = [0] * (slot - low + 1)
        for i, n in enumerate(done):
            for k in range(max(0, -(-low * self.weight[i] // self.total)), n):
                released[max(0, self.release(i, k) - low)] += 1
        free, later = [0] * (slot - low), 0
        for t in range(slot - low - 1, -1, -1):
            later += released[t]
            free[t] = slot - low - t - later
        spare = slot - sum(done)
        waiting = sorted((self.deadline(i, n), n + 1 < self.left[i], i) for i, n in enumerate(done) if n < self.left[i] and self.release(i, n) < slot)
        passed = []
        for _, _, i in waiting:
            if not spare:
                break
            at = max(0, self.release(i, done[i]) - low)
            if min(free[: at + 1], default=0) > 0:
                for t in range(at + 1):
                    free[t] -= 1
                done[i] += 1
                spare -= 1
            else:
                passed.append(i)
        for i in passed[:spare]:
            done[i] += 1
        return done

    def plan(self, first: int, last: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(source, block, release, deadline, slot) of the slots from first to last - 1, by earliest deadline, then name."""
        till = self.given(last)
        coming = [(self.release(i, k), i, k) for i, k in enumerate(self.given(first)) if k < till[i]]
        heapq.heapify(coming)
        ready: list[tuple[int, int, int, int]] = []
        for slot in range(first, last):
            while coming and (coming[0][0] <= slot or not ready):
                release, i, k = heapq.heappop(coming)
                heapq.heappush(ready, (self.deadline(i, k), i, k, release))
                if k + 1 < till[i]:
                    heapq.heappush(coming, (self.release(i, k + 1), i, k + 1))
            deadline, i, k, release = heapq.heappop(ready)
            yield i, k, release, deadline, slot


def numbered(docs: DataFrame, id_col: str, source_col: str, seed: int = 0) -> DataFrame:
    """Adds place (long): a number from 0 without gaps inside each source, in a random order that the id fixes."""
    spark = docs.sparkSession
    buckets = max(1, ceil(docs.count() / BUCKET_DOCS))
    mixed = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    keyed = docs.withColumn("_source", F.coalesce(F.col(source_col).cast("string"), F.lit(""))).withColumn("_order", mixed).withColumn("_bucket", F.pmod(F.shiftright("_order", 13), F.lit(buckets)))
    counts = staged(spark, keyed.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("n")
    starts = counts.select("_source", "_bucket", before.alias("_before"), F.sum("n").over(Window.partitionBy("_source")).alias("_total"))
    inside = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_order", F.col(id_col)))
    ranked = keyed.withColumn("_inside", inside)
    return ranked.join(starts, ["_source", "_bucket"]).withColumn("place", F.col("_before") + F.col("_inside") - 1).drop("_bucket", "_order", "_before", "_inside")


def dealt_together(docs: DataFrame, id_col: str, source_col: str, seed: int = 0, power: float = 1.0) -> DataFrame:
    """As numbered(), but place numbers the documents of all sources together, a source of n documents with the weight n ** power."""
    weight = F.pow(F.col("_total").cast("double"), F.lit(float(power)))
    phase = (F.pmod(F.xxhash64(F.lit(seed), F.col("_source")), F.lit(1 << 20)) + 0.5) / (1 << 20)
    timed = numbered(docs, id_col, source_col, seed).withColumn("_time", (F.col("place") + phase) / weight)
    # at no time are more documents due than at the start, when all sources have some
    first = timed.where("place = 0").agg(F.max(F.col("_total") / weight).alias("last"), F.sum(weight).alias("rate")).first()
    width = max(BUCKET_DOCS / first["rate"], first["last"] / 1_000_000) if first["rate"] else 1.0
    timed = timed.drop("_total").withColumn("_part", F.floor(F.col("_time") / width))
    counts = staged(docs.sparkSession, timed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")))
    starts = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_time", "_source", "place"))
    ranked = timed.withColumn("_inside", inside).join(F.broadcast(starts), "_part")
    return ranked.withColumn("place", F.col("_before") + F.col("_inside") - 1).drop("_part", "_time", "_before", "_inside")


def natural_weights(docs: DataFrame, source_col: str = "source", power: float = 1.0, most: int = 500, least: int = 1) -> dict[str | None, float]:
    """Target weights (documents of the source) ** power of sources of `least` documents or more; null sources are called ''.

    The `most` largest have their own weights, all others the sum of theirs, under REST.
    Powers below 1 lift small sources."""
    named = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    counts = staged(docs.sparkSession, named)
    rows = counts.orderBy(F.desc("n"), "s").limit(most).collect()
    out = {r["s"]: float(r["n"]) ** power for r in rows}
    if len(rows) == most:
        rest = counts.where(~F.col("s").isin(list(out))).agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(float(power)))).alias("w")).first()["w"]
        if rest:
            out[REST] = rest
    return out


#: Columns that mix() adds.
NEW = ("block", "release", "deadline", "slot", "position", "in_mix")


def mix(docs: DataFrame, weights: dict[str | None, float], id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS, round_slots: int = ROUND, seed: int = 0, rest_power: float = 1.0) -> DataFrame:
    """Schedules documents: columns of `docs` and block, release, deadline, slot, position (longs), in_mix (boolean).

    Every document of a source with positive weight has a slot; others have
    none.  in_mix says that the slot lies before the release of the first block
    that a source cannot fill: up to there every source is within one block of
    its target.  After it the same holds for the sources that still have blocks,
    with their weights made to sum to 1 again from the slot on at which a source
    ended.  The last block of a source may be smaller than the others.

    A weight under REST is that of all sources without one together.  They count
    as one source, whose blocks hold documents of several; inside it they have
    weights (documents of the source) ** rest_power.

    position orders the whole mix: slot * block_docs + place inside the block.
    A null source counts as source ''.  Null ids sort first; rows with the same
    id, or repeated, are documents of their own.  An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    names = [s for s in weights if s is not REST]
    rest = weights.get(REST, 0) > 0
    label = _label(F.col(source_col), names, rest)
    counts = {r["s"]: r["n"] for r in docs.groupBy(label.alias("s")).agg(F.count(F.lit(1)).alias("n")).where("s is not null").collect()}
    plans, end = epochs(whole({"rest" if s is REST else "=" + s: w for s, w in weights.items()}), counts, block_docs)
    slots = _slots(spark, plans, round_slots)
    row = F.struct(*[F.col(c) for c in docs.columns if c.lower() not in NEW]).alias("_row")
    keyed = docs.select(row, F.col(id_col).alias("_id"), F.col(source_col).alias("_named"), label.alias("_label"))
    if rest:
        apart = numbered(keyed.where("_label != 'rest'"), "_id", "_named", seed).drop("_total")
        placed = apart.unionByName(dealt_together(keyed.where("_label = 'rest'"), "_id", "_named", seed, rest_power))
    else:
        placed = numbered(keyed, "_id", "_named", seed)
    placed = placed.withColumn("block", F.expr(f"place div {block_docs}"))
    placed = placed.join(slots, (F.col("_label") == F.col("_of")) & (F.col("block") == F.col("_block")), "left")
    placed = placed.withColumn("position", F.col("slot") * block_docs + F.col("place") % block_docs)
    return placed.withColumn("in_mix", F.coalesce(F.col("slot") < end, F.lit(False))).select("_row.*", *NEW)


def _label(source: Column, names: list[str], rest: bool) -> Column:
    """What a source is scheduled as: '=' and its name, 'rest' for sources not named, null where these have no weight."""
    named = F.coalesce(source.cast("string"), F.lit(""))
    return F.when(named.isin(names), F.concat(F.lit("="), named)).otherwise(F.lit("rest" if rest else None).cast("string"))


def epochs(weights: dict[str, int], counts: dict[str, int], block_docs: int = BLOCK_DOCS) -> tuple[list[tuple[Epoch, dict[str, int], int]], int]:
    """Epochs from one source's end to the next, until all blocks of sources with positive weight are placed.

    Returns (epoch, blocks that each source has had before, first slot), and the
    release of the first block that a source cannot fill."""
    total = sum(weights.values())
    end = min((counts.get(s, 0) // block_docs * total // w for s, w in weights.items()), default=0)
    left = {s: -(-counts[s] // block_docs) for s in weights if counts.get(s, 0) > 0}
    done, begin, out = dict.fromkeys(left, 0), 0, []
    while left:
        epoch = Epoch({s: weights[s] for s in left}, left)
        out.append((epoch, {s: done[s] for s in left}, begin))
        for s, n in zip(epoch.names, epoch.given(epoch.length), strict=True):
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        begin += epoch.length
    return out, end


def _slots(spark: SparkSession, plans: list[tuple[Epoch, dict[str, int], int]], round_slots: int) -> DataFrame:
    """(_of, _block, release, deadline, slot): one row a block; rounds, of a turn at least, are scheduled independently in tasks."""
    sizes = [max(round_slots, epoch.turn) for epoch, _, _ in plans]
    lengths = spark.createDataFrame([(n, (epoch.length - 1) // size) for n, ((epoch, _, _), size) in enumerate(zip(plans, sizes, strict=True))], "epoch int, last long")
    rounds = lengths.select("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("round"))
    dealt = rounds.repartition(max(1, min(ceil(sum(epoch.length for epoch, _, _ in plans) / (20 * round_slots)), 10_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                epoch, done, begin = plans[n]
                rows = epoch.plan(r * sizes[n], min((r + 1) * sizes[n], epoch.length))
                while some := list(islice(rows, 10_000)):
                    names = [epoch.names[i] for i, *_ in some]
                    times = [pa.array([row[k] + begin for row in some], pa.int64()) for k in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([done[s] + row[1] for s, row in zip(names, some, strict=True)], pa.int64()), *times], names=["_of", "_block", "release", "deadline", "slot"])

    return dealt.mapInArrow(run, "_of string, _block long, release long, deadline long, slot long")


#: Targets of the query: shares lean towards small sources.
QUERY_POWER = 0.7


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, natural_weights(docs, power=QUERY_POWER), rest_power=QUERY_POWER)
