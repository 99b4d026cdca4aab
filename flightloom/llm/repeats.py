"""Repeated windows of symbols (bytes or words) over a whole corpus, without listing all suffixes.

All windows of a text are cut into units that share an anchor (see
``kernels.anchored_windows``), about one unit for every 90 bytes or 22 words.
Equal windows always have equal anchors, so suffixes are compared only at
anchors: a sparse suffix array or tree.  Three steps find every repeated window:

1. Units that repeat as a whole are settled by two aggregations over 64-bit
   hashes (anchor and unit, 128 bits together), with map-side combining.
2. What is left, units whose anchor repeats while the unit does not, is sent
   with its symbols to the anchor's partition and compared exactly there, by the
   resolver that the operator passes in (suffix-array levels, suffix trees).
3. Anchors with more than `hot` such units are too large for one task.  Their
   windows are fingerprinted one by one with 128 bits and settled by an
   aggregation with map-side combining and a join that splits skewed keys.

The texts are shuffled once, by document; both joins to them read that exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import staged

_U = np.uint64

#: Stands for a null id: after every other id.
NO_ID = (1 << 63) - 1

#: Units of one anchor that a task compares itself.
HOT_UNITS = 50_000


@dataclass(frozen=True)
class Windows:
    """What is looked for: windows of `size` symbols, words or bytes, with anchors of `gram` symbols."""

    size: int
    gram: int
    words: bool
    #: True: a window counts if a smaller document has it; False: if it stands anywhere else.
    earlier: bool

    @property
    def width(self) -> int:
        return 8 if self.words else 1

    @property
    def most_lead(self) -> int:
        return self.size - self.gram


def symbols(chunk: K.Chunk, spec: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values to hash, symbols as stored, first symbol of each document, end symbol of each document)."""
    if spec.words:
        hashes, _, _, first = K.words(chunk, folded=False)
        return hashes, hashes, first[:-1], first[1:]
    return K.BYTE_VALUES[chunk.data], chunk.data, chunk.start, chunk.end


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, rk, text): doc is the id (null: NO_ID), rk a hash of the text that tells rows of one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("rk"), text.alias("text"))


def _units(texts: DataFrame, spec: Windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(2)):
                values, _, start, end = symbols(chunk, spec)
                doc, first, anchor, count, h, uh = K.anchored_windows(K.RollingHash(values), len(values), start, end, spec.size, spec.gram)
                rows = pa.array(doc + chunk.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first - start[doc], pa.int64()), pa.array((anchor - first).astype(np.int32)), pa.array(count.astype(np.int32)), K.signed(h), K.signed(uh)],
                    names=["doc", "rk", "first", "lead", "cnt", "h", "uh"],
                )

    return texts.mapInArrow(run, "doc long, rk long, first long, lead int, cnt int, h long, uh long")


def _with_symbols(joined: DataFrame, spec: Windows) -> DataFrame:
    """Texts with their asked-for units (column `asked`) to one row a unit, with the unit's symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(3)
            for chunk in K.chunks(batch.column(2)):
                _, stored, start, _ = symbols(chunk, spec)
                mine = asked.slice(chunk.first, chunk.n)
                flat, lengths = mine.flatten(), pa.compute.list_value_length(mine).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(chunk.n), lengths)
                first, lead, cnt = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("first", "lead", "cnt"))
                at = first + start[row]
                size = (cnt - 1 + spec.size) * spec.width
                bounds = np.zeros(len(at) + 1, dtype=np.int64)
                np.cumsum(size, out=bounds[1:])
                raw = np.ascontiguousarray(stored).view(np.uint8)
                for lo in range(0, len(at), 20_000):
                    hi = min(lo + 20_000, len(at))
                    inside = np.arange(bounds[lo], bounds[hi]) - np.repeat(bounds[lo:hi] - at[lo:hi] * spec.width, size[lo:hi])
                    offsets = pa.array((bounds[lo : hi + 1] - bounds[lo]).astype(np.int32))
                    unit = pa.Array.from_buffers(pa.binary(), hi - lo, [None, offsets.buffers()[1], pa.py_buffer(raw[inside])])
                    rows = pa.array(row[lo:hi] + chunk.first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), flat.field("h").slice(lo, hi - lo), flat.field("hot").slice(lo, hi - lo), pa.array(first[lo:hi]), pa.array(lead[lo:hi].astype(np.int32)), pa.array(cnt[lo:hi].astype(np.int32)), unit],
                        names=["doc", "rk", "h", "hot", "first", "lead", "cnt", "unit"],
                    )

    return joined.mapInArrow(run, "doc long, rk long, h long, hot boolean, first long, lead int, cnt int, unit binary")


def _fingerprints(units: DataFrame, spec: Windows) -> DataFrame:
    """One row for each window of hot anchors: (doc, rk, s, w1, w2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                u = Units.of(part, spec)
                values = K.mix64(u.flat ^ _U(0x2545F4914F6CDD1D)) if spec.words else K.BYTE_VALUES[u.flat]
                rolls = [K.RollingHash(values), K.RollingHash(K.mix64(values))]
                row = np.repeat(np.arange(part.num_rows), u.cnt)
                step = np.arange(len(row)) - np.repeat(np.cumsum(u.cnt) - u.cnt, u.cnt)
                at = u.bounds[row] + step
                w1, w2 = (roll(at, at + spec.size) for roll in rolls)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(u.first[row] + step), K.signed(w1), K.signed(w2)], names=["doc", "rk", "s", "w1", "w2"])

    return units.mapInArrow(run, "doc long, rk long, s long, w1 long, w2 long")


class Units:
    """Units of a batch with their symbols as padded contexts: right of the anchor's start, and left of it, reversed."""

    def __init__(self, spec: Windows, doc: np.ndarray, rk: np.ndarray, h: np.ndarray, first: np.ndarray, lead: np.ndarray, cnt: np.ndarray, flat: np.ndarray, bounds: np.ndarray):
        self.spec, self.doc, self.rk, self.h, self.first, self.lead, self.cnt, self.flat, self.bounds = spec, doc, rk, h, first, lead, cnt, flat, bounds

    @classmethod
    def of(cls, batch: pa.RecordBatch, spec: Windows) -> Units:
        unit = batch.column("unit")
        got = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "rk", "h", "first", "lead", "cnt")]
        raw = np.frombuffer(b"".join(unit.to_pylist()), dtype=np.uint64 if spec.words else np.uint8)
        size = got[5].astype(np.int64) - 1 + spec.size
        return cls(spec, *got, raw, np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64))

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """(right, left): one row a unit, padded with zeros to the same width."""
        flat = np.concatenate([self.flat, np.zeros(self.spec.size, dtype=self.flat.dtype)])
        anchor = (self.bounds + self.lead)[:, None]
        end = (self.bounds + self.cnt - 1 + self.spec.size)[:, None]
        step = np.arange(self.spec.size)[None, :]
        at = np.minimum(anchor + step, len(flat) - 1)
        right = np.where(anchor + step < end, flat[at], 0)
        step = np.arange(self.spec.most_lead)[None, :]
        at = np.maximum(anchor - 1 - step, 0)
        left = np.where(step < self.lead[:, None], flat[at], 0)
        return right.astype(flat.dtype), left.astype(flat.dtype)


def suffix_order(contexts: np.ndarray) -> np.ndarray:
    """Rows in the order of their symbols: a suffix array of padded contexts (stable, so sorted runs merge in linear time)."""
    if contexts.shape[1] == 0:
        return np.arange(len(contexts))
    rows = np.ascontiguousarray(contexts.astype(contexts.dtype.newbyteorder(">")))
    return np.argsort(rows.view(f"S{rows.shape[1] * rows.dtype.itemsize}").ravel(), kind="stable")


def common_prefixes(ordered: np.ndarray) -> np.ndarray:
    """Symbols that each row shares with the row before it (the first row: -1)."""
    out = np.full(len(ordered), -1, dtype=np.int64)
    if len(ordered) > 1:
        for lo in range(1, len(ordered), 8192):
            hi = min(lo + 8192, len(ordered))
            differ = ordered[lo:hi] != ordered[lo - 1 : hi - 1]
            out[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), ordered.shape[1])
    return out


def flag_windows(spec: Windows, right: np.ndarray, left: np.ndarray, lead: np.ndarray, cnt: np.ndarray, doc: np.ndarray, flags: np.ndarray, order: np.ndarray | None = None) -> None:
    """Marks in flags[unit, l] the windows that begin l symbols before the unit's anchor and stand elsewhere too.

    Two windows are equal if they have the same l, the anchors' right contexts
    share size - l symbols and the left ones l: with the units sorted either way,
    ranges between small common prefixes (the internal nodes of the suffix tree
    at that depth) are the classes of equal contexts, and a pair of such classes
    is a class of equal windows."""
    if len(lead) < 2:
        return
    by_right = suffix_order(right) if order is None else order
    by_left = suffix_order(left)
    shared_right, shared_left = common_prefixes(right[by_right]), common_prefixes(left[by_left])
    in_right, in_left = np.empty(len(lead), dtype=np.int64), np.empty(len(lead), dtype=np.int64)
    for l in range(int(lead.max()) + 1):
        rows = np.flatnonzero((lead >= l) & (lead - cnt + 1 <= l))
        if len(rows) < 2:
            continue
        in_right[by_right] = np.cumsum(shared_right < spec.size - l)
        in_left[by_left] = np.cumsum(shared_left < l)
        key = in_right[rows] * (len(lead) + 1) + in_left[rows]
        if spec.earlier:
            _, which = np.unique(key, return_inverse=True)
            least = np.full(int(which.max()) + 1, NO_ID, dtype=np.int64)
            np.minimum.at(least, which, doc[rows])
            flags[rows, l] |= least[which] < doc[rows]
        else:
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            flags[rows, l] |= count[which] > 1


def spans_of(spec: Windows, doc: np.ndarray, rk: np.ndarray, first: np.ndarray, lead: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    """Flagged windows as spans of symbols (doc, rk, s, e)."""
    edge = np.diff(flags.astype(np.int8), axis=1, prepend=0, append=0)
    unit, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    anchor = first[unit] + lead[unit]
    return pa.RecordBatch.from_arrays([pa.array(doc[unit]), pa.array(rk[unit]), pa.array((anchor - high + 1).astype(np.int64)), pa.array((anchor - low + spec.size).astype(np.int64))], names=["doc", "rk", "s", "e"])


SPANS = "doc long, rk long, s long, e long"


def repeated_spans(texts: DataFrame, spec: Windows, resolver: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], hot: int = HOT_UNITS, ordered: bool = False) -> DataFrame:
    """Spans (doc, rk, s, e) of symbols that repeated windows cover; spans of one text may overlap."""
    spark = texts.sparkSession
    units = staged(spark, _units(texts, spec).withColumn("loc", F.monotonically_increasing_id()))
    # the aggregates are tables of their own, so that the joins to them are dealt anew where a key is hot
    anchors = units.groupBy("h").agg(F.min("uh").alias("lo"), F.max("uh").alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1")
    anchors = staged(spark, anchors.select("h", (F.col("lo") != F.col("hi")).alias("differ")))
    again = staged(spark, units.join(anchors, "h"))
    whole = again.groupBy("h", "uh").agg(F.count(F.lit(1)).alias("n"), F.min("loc").alias("one"), F.min("doc").alias("least")).where("n > 1")
    placed = again.join(staged(spark, whole), ["h", "uh"], "left")
    alone = F.col("n").isNull()
    settled = ~alone & ((F.col("doc") > F.col("least")) if spec.earlier else F.lit(True))
    open_ = F.col("differ") & (alone | ((F.col("doc") == F.col("least")) if spec.earlier else (F.col("loc") == F.col("one"))))
    placed = staged(spark, placed.select("doc", "rk", "h", "first", "lead", "cnt", settled.alias("settled"), open_.alias("open")).where("settled or open"))
    asked = placed.where("open").select("doc", "rk", "h", "first", "lead", "cnt")
    hots = asked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", (F.col("n") > hot).alias("hot"))
    asked = asked.join(hots, "h").groupBy("doc", "rk").agg(F.collect_list(F.struct("h", "first", "lead", "cnt", "hot")).alias("asked"))
    found = _with_symbols(texts.join(asked, ["doc", "rk"]).select("doc", "rk", "text", "asked"), spec)
    cold = found.where("not hot").drop("hot").repartition("h")
    cold = (cold.sortWithinPartitions("h") if ordered else cold).mapInArrow(resolver, SPANS)
    out = placed.where("settled").select("doc", "rk", F.col("first").alias("s"), (F.col("first") + F.col("cnt") - 1 + spec.size).alias("e")).unionByName(cold)
    if not hots.where("hot").isEmpty():
        prints = staged(spark, _fingerprints(found.where("hot").drop("hot"), spec))
        seen = prints.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"))
        seen = prints.join(seen, ["w1", "w2"]).where("doc > least" if spec.earlier else "n > 1")
        out = out.unionByName(seen.select("doc", "rk", "s", (F.col("s") + spec.size).alias("e")))
    return out


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n symbols the spans cover."""
    change = np.zeros(n + 1, dtype=np.int64)
    if spans:
        at = np.array(spans, dtype=np.int64)
        np.add.at(change, at[:, 0], 1)
        np.add.at(change, at[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, text, spans) for every row of texts; texts are read through the same exchange as before."""
    listed = spans.groupBy("doc", "rk").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return texts.join(listed, ["doc", "rk"], "left").select("doc", "text", "spans")
