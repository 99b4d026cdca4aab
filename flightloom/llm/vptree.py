"""Nearest neighbours by inner product with a vantage-point tree in each shard.

Vectors are dealt into shards of bounded size by a hash of their id.  A vector x
gets one more component, sqrt(M^2 - |x|^2) with M the shard's longest length; the
largest inner products with a query are then the smallest Euclidean distances,
for which the triangle inequality holds.  A subtree is skipped when `factor`
times its lower bound lies beyond the worst of the k best so far: factor 1 is
exact, larger ones skip more.  Queries stream through each shard's tree in
blocks, and the shards' best are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small_batches, table

#: Vectors of a shard, of a leaf, queries that go down a tree together.
SHARD_ROWS, LEAF, BLOCK = 8192, 128, 512

#: How much pruning is relaxed; measured recall is in the README.
FACTOR = 1.0


class VPTree:
    """A vantage-point tree over distinct vectors; each node keeps the range of distances of both halves."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.vectors = vectors
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.top = norms.max(initial=0.0)
        self.points = np.hstack([vectors, np.sqrt(np.maximum(self.top - norms, 0))[:, None]])
        rng = np.random.default_rng(seed)
        #: Nodes: (vantage point, ((nearest, farthest, child), ...)) or an array of leaf rows.
        self.nodes: list = []
        stack = [(np.arange(len(vectors)), None)]
        while stack:
            rows, parent = stack.pop()
            if parent is not None:
                self.nodes[parent[0]][1][parent[1]][2] = len(self.nodes)
            far = None
            if len(rows) > LEAF:
                point = self.points[rows[rng.integers(len(rows))]]
                far = np.linalg.norm(self.points[rows] - point, axis=1)
                inside = far <= np.median(far)
            if far is None or inside.all():
                self.nodes.append(rows)
                continue
            self.nodes.append((point, [[far[s].min(), far[s].max(), -1] for s in (inside, ~inside)]))
            here = len(self.nodes) - 1
            stack += [(rows[~inside], (here, 1)), (rows[inside], (here, 0))]

    def search(self, queries: np.ndarray, k: int, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of every vector whose score is no less than the query's k-th best, short of rounding: all ties are there."""
        best = np.full((len(queries), k), -np.inf)
        asked, found, scored = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        if not len(self.vectors) or not len(queries):
            return asked[0], found[0]
        wide = np.hstack([queries, np.zeros((len(queries), 1))])
        length = np.einsum("ij,ij->i", queries, queries)
        slack = 1e-9 * (1 + np.sqrt(length * self.top))
        done = np.zeros((len(queries), len(self.nodes)), dtype=bool)

        def reach(active: np.ndarray) -> np.ndarray:
            """Distance of the k-th best; the slack covers rounding."""
            worst = best[active].min(axis=1)
            return np.sqrt(np.maximum(length[active] + self.top - 2 * worst + 2 * slack[active], 0)) * (1 + 1e-9) + 1e-9

        def leaf(node: int, active: np.ndarray) -> None:
            active = active[~done[active, node]]
            if not len(active):
                return
            done[active, node] = True
            own = self.nodes[node]
            for lo in range(0, len(own), 4096):
                part = own[lo : lo + 4096]
                scores = queries[active] @ self.vectors[part].T
                at, where = np.nonzero(scores >= (best[active].min(axis=1) - slack[active])[:, None])
                asked.append(active[at])
                found.append(part[where])
                scored.append(scores[at, where])
                both = np.hstack([best[active], scores])
                best[active] = -np.partition(-both, k - 1, axis=1)[:, :k]

        def walk(first_only: bool) -> None:
            stack = [(0, np.arange(len(queries)))]
            while stack:
                node, active = stack.pop()
                if isinstance(self.nodes[node], np.ndarray):
                    leaf(node, active)
                    continue
                point, halves = self.nodes[node]
                far = np.linalg.norm(wide[active] - point, axis=1)
                bound = [np.maximum(np.maximum(far - high, low - far), 0) for low, high, _ in halves]
                if first_only:
                    near = bound[0] <= bound[1]
                    go = [near, ~near]
                else:
                    limit = reach(active)
                    go = [factor * b <= limit for b in bound]
                for (_, _, child), some in zip(halves, go, strict=True):
                    if some.any():
                        stack.append((child, active[some]))

        walk(first_only=True)
        walk(first_only=False)
        asked, found, scored = (np.concatenate(x) for x in (asked, found, scored))
        near = scored >= (best.min(axis=1) - slack)[asked]
        return asked[near], found[near]


class Shard:
    """A tree over a shard's distinct vectors, each with its ids in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, which = np.unique(vectors, axis=0, return_index=True, return_inverse=True) if len(ids) else (None, np.zeros(0, int), np.zeros(0, int))
        grouped = np.argsort(which.ravel(), kind="stable")
        self.ids = ids[grouped]
        self.start = np.searchsorted(which.ravel()[grouped], np.arange(len(first) + 1))
        self.tree = VPTree(vectors[first].astype(np.float64))

    def nearest(self, names: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's name, id, score) of each query's k nearest, ties to the smaller id; the query's own id is left out."""
        asked, rows = self.tree.search(queries, k + 1, factor)
        # the measure itself, summed the same way for every vector
        score = np.concatenate([np.zeros(0), *[(self.tree.vectors[rows[lo : lo + 8192]] * queries[asked[lo : lo + 8192]]).sum(axis=1) for lo in range(0, len(rows), 8192)]])
        # a vector's first ids suffice: equal vectors have equal scores
        count = np.minimum(self.start[rows + 1] - self.start[rows], k + 1)
        which = np.repeat(np.arange(len(rows)), count)
        ids = self.ids[self.start[rows][which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
        asked, score = asked[which], score[which]
        other = ids != names[asked]
        asked, score, ids = asked[other], score[other], ids[other]
        order = np.lexsort((ids, -score, asked))
        asked, score, ids = asked[order], score[order], ids[order]
        rank = np.arange(len(asked)) - np.searchsorted(asked, asked)
        return names[asked[rank < k]], ids[rank < k], score[rank < k]


def usable(c: Column) -> Column:
    """Not null, not empty, only finite components, not all zero."""
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def nearest_neighbours(base: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest in `base` by inner product, ties to the smaller id.

    A row with the query's own id is no candidate.  Rows with a null id, and
    null, empty, zero or non-finite vectors take no part on either side; vectors
    meet only vectors of as many components.  Of rows repeated in full each is a
    candidate; of query rows with the same id one counts, that with the smallest
    vector.  An empty table gives an empty result; other columns are not
    looked at.
    """
    spark = base.sparkSession
    small_batches(spark)

    def picked(df: DataFrame, kind: int) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return df.select(F.lit(kind).alias("kind"), F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))

    stored = picked(base, 0)
    shards = max(1, ceil(stored.count() / shard_rows))
    dealt = stored.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    each = picked(queries, 1).groupBy("kind", "id").agg(F.min("v").alias("v"))
    asked = each.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = dealt.unionByName(asked).withColumn("dim", F.size("v")).repartition(shards, "shard", "dim").sortWithinPartitions("shard", "dim", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, shard, held_ids, held = None, None, [], []
        for batch in batches:
            kind, ids, where, dim = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "id", "shard", "dim"))
            flat, offset = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(dim))
            place = where.astype(np.int64) * (1 << 32) + dim
            cuts = np.flatnonzero(np.diff(place * 2 + kind)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if lo == hi:
                    continue
                rows = flat[offset[lo] : offset[hi]].reshape(hi - lo, dim[lo])
                if place[lo] != here:
                    here, shard, held_ids, held = place[lo], None, [], []
                if kind[lo] == 0:
                    held_ids.append(ids[lo:hi])
                    held.append(rows)
                    continue
                if shard is None:
                    shard = Shard(np.concatenate(held_ids), np.concatenate(held)) if held else Shard(np.zeros(0, np.int64), np.zeros((0, dim[lo])))
                for at in range(0, hi - lo, BLOCK):
                    got = shard.nearest(ids[lo:hi][at : at + BLOCK], rows[at : at + BLOCK], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))
