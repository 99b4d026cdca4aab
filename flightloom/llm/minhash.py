"""MinHash near-duplicate detection with min-max signatures.

A document's set holds the hashes of its distinct word shingles.  Each of the
permutations gives two values of the signature, the smallest and the largest
hash, so that a signature of 2p values costs p hash evaluations a shingle.
Signatures are banded; documents that share a band are candidates, a
signature estimate drops the hopeless ones, and the rest are confirmed on their
full sets.  Components of the confirmed links are the classes.

How large groups are kept apart from quadratic work:

* documents with equal sets become one class first, through an aggregation;
* in a bucket everything is compared with one pivot (a star, linear).  The pivot
  is the member with the most neighbours over all its buckets: in a group of
  edited copies that is the text which they are copies of;
* members that are still in another component than their bucket's pivot
  afterwards, and only they, are compared with the other members inside tasks of
  bounded size: first on sketches, to find out whose texts are needed at all,
  then on full sets.  A pair is looked at in the first of its common buckets
  only, a task gives out a link only where it joins two components, and pairs
  themselves are never rows of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import components, small_batches, staged, table

#: Values of a band, and bands: with 4 x 25 a pair of similarity 0.8 is missed once in 500,000.
ROWS, BANDS = 4, 25

#: Members, and shingles of members, of a bucket that meet in one task.
CHUNK_MEMBERS, CHUNK_SHINGLES = 20_000, 2_000_000

#: Candidates are dropped whose estimate lies so many standard errors below the threshold.
MARGIN = 6.0

#: Ids of documents to verify or to remove are broadcast up to this many (8 MB), beyond that joined by shuffle.
BROADCAST_IDS = 1_000_000

_U = np.uint64


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingle hashes of one document's words (fewer than k words: the whole sequence as one)."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out = (out + hashes[j : n - k + 1 + j]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return np.unique(K.mix64(out + _U(k)))


def shingle_sets(chunk: K.Chunk, k: int) -> list[np.ndarray]:
    hashes, _, _, first = K.words(chunk, folded=True)
    return [_shingles(hashes[first[i] : first[i + 1]], k) for i in range(chunk.n)]


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = K.mix64(np.arange(1, n + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)
    return a, K.mix64(np.arange(1, n + 1, dtype=np.uint64) * _U(0xE7037ED1A0B428DB))


def min_max(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """Signatures of non-empty sets: a row of 2 x permutations 32-bit values each, minimum and maximum by turns."""
    at = np.zeros(len(sets), dtype=np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
    every = np.concatenate(sets)
    a, b = _multipliers(permutations)
    out = np.empty((len(sets), 2 * permutations), dtype=np.uint32)
    for j in range(permutations):
        values = ((every * a[j] + b[j]) >> _U(32)).astype(np.uint32)
        out[:, 2 * j] = np.minimum.reduceat(values, at)
        out[:, 2 * j + 1] = np.maximum.reduceat(values, at)
    return out


def _band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """32 bits of hash for each band of each signature."""
    parts = values.reshape(len(values), -1, rows).astype(np.uint64)
    out = np.zeros(parts.shape[:2], dtype=np.uint64)
    for j in range(rows):
        out = K.mix64(out + parts[:, :, j] * _U(0x9E3779B97F4A7C15) + _U(j + 1))
    return (out >> _U(32)).astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(id, n_shingles, c1, c2, sig, low, keys): c1 and c2 are a 128-bit fingerprint of the set; an empty set has no signature.

    low holds the lowest byte of each value, enough for estimates, keys 32 bits of each band."""
    permutations = rows * bands // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                sets = shingle_sets(chunk, shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list[bytes | None] = [None] * chunk.n
                low: list[bytes | None] = [None] * chunk.n
                keys: list[bytes | None] = [None] * chunk.n
                if full:
                    values = min_max([sets[i] for i in full], permutations)
                    for i, row, key in zip(full, values, _band_keys(values, rows), strict=True):
                        sig[i], low[i], keys[i] = row.tobytes(), row.astype(np.uint8).tobytes(), key.tobytes()
                c1 = np.array([np.add.reduce(s) for s in sets], dtype=np.uint64)
                c2 = np.array([np.add.reduce(K.mix64(s ^ _U(0x5851F42D4C957F2D))) for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), K.signed(c1), K.signed(c2), pa.array(sig, pa.binary()), pa.array(low, pa.binary()), pa.array(keys, pa.binary())],
                    names=["id", "n_shingles", "c1", "c2", "sig", "low", "keys"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, n_shingles long, c1 long, c2 long, sig binary, low binary, keys binary")


def _estimated(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in a share of at least `least` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array((left == right).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    sided = pairs.join(sigs.select(F.col("v").alias("a"), F.col("low").alias("sa")), "a").join(sigs.select(F.col("v").alias("b"), F.col("low").alias("sb")), "b")
    return sided.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, on the full sets of both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column(0), batch.column(1), np.zeros(batch.num_rows, dtype=bool)
            at = 0
            known: tuple[int | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
            pivots = a.to_pylist()
            while at < batch.num_rows:
                some = min(256, batch.num_rows - at)
                right = [s for c in K.chunks(batch.column(3).slice(at, some)) for s in shingle_sets(c, shingle)]
                for i, other in enumerate(right, at):
                    if pivots[i] != known[0]:
                        known = (pivots[i], shingle_sets(K.Chunk([batch.column(2)[i].as_buffer().to_pybytes() if batch.column(2)[i].is_valid else b""], 0), shingle)[0])
                    n, m = len(known[1]), len(other)
                    if n and m and 100 * min(n, m) >= percent * max(n, m):
                        both = np.intersect1d(known[1], other, assume_unique=True).size
                        keep[i] = 100 * both >= percent * (n + m - both)
                at += some
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, chunk: int = CHUNK_MEMBERS
) -> DataFrame:
    """One row for each row of `docs`: id, n_shingles, component_id, kept.

    Links join documents whose shingle sets A, B have 100 |A n B| >= percent |A u B|.
    component_id is the smallest id that links reach, kept says whether that is
    the document itself.

    Null or empty texts, and texts without words, have an empty set and no
    links.  Equal texts share a component.  Rows with the same id count as one
    document with all their texts' links.  A null id takes no part in links:
    component_id is null and kept is true.  An empty table gives an empty result.
    Other columns of `docs` are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sigs = staged(spark, signatures(docs, id_col, text_col, shingle, rows, bands))
    linked = sigs.where("id is not null and sig is not null")
    classes = staged(spark, linked.groupBy("c1", "c2", "n_shingles").agg(F.min_by(F.struct("sig", "low", "keys"), "id").alias("s"), F.min("id").alias("v")).select("c1", "c2", "n_shingles", "v", "s.sig", "s.low", "s.keys"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    labels = _link_classes(spark, classes, texts, shingle, percent, rows, bands, chunk)
    found = classes.select("c1", "c2", "n_shingles", "v").join(labels, "v", "left").select("c1", "c2", "n_shingles", F.coalesce("comp", "v").alias("comp"))
    # rows of one id with several texts belong together whatever their texts
    twice = linked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    out = sigs.drop("sig", "low", "keys").join(found, ["c1", "c2", "n_shingles"], "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("comp"))
    if not twice.isEmpty():
        same = out.join(twice, "id", "left_semi").select(F.col("id").alias("a"), F.col("comp").alias("b"))
        joined = components(spark, same).select(F.col("v").alias("comp"), F.col("comp").alias("to"))
        out = out.join(joined, "comp", "left").select("id", "n_shingles", F.coalesce("to", "comp").alias("comp"))
    return out.select("id", "n_shingles", F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))


def _link_classes(spark: SparkSession, classes: DataFrame, texts: DataFrame, shingle: int, percent: int, rows: int, bands: int, chunk: int) -> DataFrame:
    """(v, comp) for each class that has a link."""
    width = 4 * rows
    band = [F.xxhash64(F.lit(i), F.expr(f"substring(sig, {i * width + 1}, {width})")) for i in range(bands)]
    listed = classes.select("v", F.col("n_shingles").alias("n"), F.posexplode(F.array(*band)).alias("band", "bucket"))
    sizes = listed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = staged(spark, listed.join(sizes, "bucket"))
    degrees = shared.groupBy("v").agg(F.sum("size").alias("degree"))
    pivots = shared.join(degrees, "v").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("v")).alias("minus"), F.col("n").alias("m"))).alias("p"))
    pivots = staged(spark, pivots.select("bucket", (-F.col("p.minus")).alias("pivot"), F.col("p.m").alias("m")))
    buckets = staged(spark, shared.join(pivots, "bucket"))
    least = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / (rows * bands)) ** 0.5
    alike = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    star = buckets.where(f"v <> pivot and {alike}").select(F.least("v", "pivot").alias("a"), F.greatest("v", "pivot").alias("b")).distinct()
    found = _verified(spark, staged(spark, _estimated(star, classes, least)), texts, shingle, percent)
    labels = components(spark, found)

    def placed(df: DataFrame, key: str, to: str) -> DataFrame:
        return df.join(labels.select(F.col("v").alias(key), F.col("comp").alias("_c")), key, "left").withColumn(to, F.coalesce("_c", key)).drop("_c")

    apart = placed(placed(buckets, "v", "comp"), "pivot", "main").where("comp <> main").select("bucket", "v", F.lit(True).alias("rest"))
    apart = staged(spark, apart)
    if apart.isEmpty():
        return labels
    members = placed(buckets.join(apart.select("bucket").distinct(), "bucket", "left_semi").join(apart, ["bucket", "v"], "left"), "v", "comp")
    members = staged(spark, members.select("bucket", "band", "v", "n", "comp", F.coalesce("rest", F.lit(False)).alias("rest")))
    sketched = members.join(classes.select("v", "low", "keys"), "v").withColumn("text", F.lit(None).cast("string"))
    close = staged(spark, _in_buckets(sketched, percent, least, chunk, None).distinct())
    if close.isEmpty():
        return labels
    needed = _texts_of(spark, texts, close.select(F.col("v").alias("id")).distinct())
    held = members.join(close, ["bucket", "v"], "left_semi").join(classes.select("v", "low", "keys"), "v").join(needed.select(F.col("id").alias("v"), "text"), "v")
    more = staged(spark, _in_buckets(held, percent, least, chunk, shingle).distinct())
    return labels if more.isEmpty() else components(spark, found.unionByName(more))


def _in_buckets(members: DataFrame, percent: int, least: float, chunk: int, shingle: int | None) -> DataFrame:
    """Compares the rest of each bucket with its other members.

    Without `shingle`: (bucket, v) of members of a pair that the sketches let
    pass.  With it: links (a, b) between components, confirmed on the texts' sets.
    Buckets larger than a chunk are cut both ways, rest against members, so
    that a task holds two chunks at most."""
    totals = members.groupBy("bucket").agg(*[f for name, when in (("m", F.lit(True)), ("x", F.col("rest"))) for f in (F.count(F.when(when, 1)).alias(f"c{name}"), F.sum(F.when(when, F.col("n"))).alias(f"n{name}"))])
    parts = lambda k: F.greatest(F.ceil(F.col(f"c{k}") / chunk), F.ceil(F.coalesce(f"n{k}", F.lit(0)) / CHUNK_SHINGLES), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("v"), F.lit(1 << 20)).cast("int")
    cut = members.join(totals.select("bucket", parts("m").alias("pm"), parts("x").alias("px")), "bucket")
    # a member comes once for each part of the rest; a row of the rest is a member and comes for each other part, too
    plain = cut.withColumns({"mi": F.pmod(own, F.col("pm")), "xi": F.explode(F.sequence(F.lit(0), F.col("px") - 1))})
    asked = cut.where("rest").withColumns({"xi": F.pmod(own, F.col("px")), "mi": F.explode(F.sequence(F.lit(0), F.col("pm") - 1))})
    names = ["bucket", "mi", "xi", "side", "band", "v", "n", "comp", "low", "keys", "text"]
    both = plain.withColumn("side", F.lit(0)).select(*names).unionByName(asked.withColumn("side", F.lit(1)).select(*names))
    both = both.repartition("bucket", "mi", "xi").sortWithinPartitions("bucket", "mi", "xi", "side", "v")

    def close(band: int, v: np.ndarray, n: np.ndarray, comp: np.ndarray, low: np.ndarray, keys: np.ndarray, others: np.ndarray, x: int) -> np.ndarray:
        fits = others[(comp[others] != comp[x]) & (100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x]))]
        if band and len(fits):
            fits = fits[~(keys[fits, :band] == keys[x, :band]).any(axis=1)]
        return fits[(low[fits] == low[x]).mean(axis=1) >= least] if len(fits) else fits

    def compared(bucket: int, group: list[tuple]) -> pa.RecordBatch:
        side, v, n, comp = (np.array([g[k] for g in group], dtype=np.int64) for k in (0, 2, 3, 4))
        low, keys = np.frombuffer(b"".join(g[5] for g in group), dtype=np.uint8).reshape(len(group), -1), np.frombuffer(b"".join(g[6] for g in group), dtype=np.uint32).reshape(len(group), -1)
        band, others = group[0][1], np.flatnonzero(side == 0)
        if shingle is None:
            seen = np.zeros(len(group), dtype=bool)
            for x in np.flatnonzero(side == 1):
                fits = close(band, v, n, comp, low, keys, others, x)
                seen[fits] = True
                seen[x] |= len(fits) > 0
            mine = np.unique(v[seen])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), bucket)), pa.array(mine)], names=["bucket", "v"])
        links, sets, postings = [], None, None
        for x in np.flatnonzero(side == 1):
            fits = close(band, v, n, comp, low, keys, others, x)
            if not len(fits):
                continue
            if sets is None:
                sets = [shingle_sets(K.Chunk([g[7].encode()], 0), shingle)[0] for g in group]
                every, row = np.concatenate([sets[i] for i in others]), np.repeat(others, [len(sets[i]) for i in others])
                order = np.argsort(every, kind="stable")
                postings = every[order], row[order]
            lo, hi = np.searchsorted(postings[0], sets[x]), np.searchsorted(postings[0], sets[x], side="right")
            hits = np.concatenate([postings[1][a:b] for a, b in zip(lo, hi, strict=True)]) if len(lo) else np.zeros(0, dtype=np.int64)
            both = np.bincount(hits, minlength=len(group))[fits]
            for y in fits[100 * both >= percent * (len(sets[x]) + n[fits] - both)]:
                if comp[y] != comp[x]:
                    links.append((min(v[x], v[y]), max(v[x], v[y])))
                    comp[comp == comp[y]] = comp[x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    if group:
                        yield compared(at[0], group)
                    at, group = row[:3], []
                group.append(row[3:])
        if group:
            yield compared(at[0], group)

    return both.mapInArrow(run, "bucket long, v long" if shingle is None else "a long, b long")


def few(ids: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """F.broadcast if there are at most BROADCAST_IDS rows, else a function that leaves the join to Spark."""
    return F.broadcast if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else lambda df: df


def _texts_of(spark: SparkSession, texts: DataFrame, ids: DataFrame) -> DataFrame:
    return texts.join(few(ids)(ids), "id", "left_semi")


def _verified(spark: SparkSession, pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    return staged(spark, _confirmed(pairs, _texts_of(spark, texts, ids), shingle, percent))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return out.withColumnRenamed("id", "doc_id")
