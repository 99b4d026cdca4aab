"""Substring deduplication with a logarithmic family of suffix arrays.

Bytes that belong to a 200-byte string which also starts anywhere else are
removed.  Candidates come from ``repeats``; in each partition of anchors the
batches that arrive are the family's new members: a batch gets a suffix array,
is merge-scanned against every level for long matches, and becomes level 0;
two levels of equal rank merge into the next, so that n batches lie in at most
log2(n) + 1 levels and each unit is merged as often at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .shared import small_batches, table

WINDOW, GRAM = 200, 16


class Level:
    """A suffix array over anchored units: rows in the order of their right contexts."""

    FIELDS = ("doc", "rk", "h", "first", "lead", "cnt", "right", "left", "flags")

    def __init__(self, spec: R.Windows, columns: dict[str, np.ndarray], rank: int = 0, ordered: bool = False):
        order = slice(None) if ordered else R.suffix_order(columns["right"])
        self.spec, self.rank = spec, rank
        for k in self.FIELDS:
            setattr(self, k, columns[k][order])
        self.by_h = np.argsort(self.h, kind="stable")
        self.sorted_h = self.h[self.by_h]

    @classmethod
    def of(cls, batch: pa.RecordBatch, spec: R.Windows) -> Level:
        u = R.Units.of(batch, spec)
        right, left = u.contexts()
        got = {k: getattr(u, k) for k in ("doc", "rk", "h", "first", "lead", "cnt")}
        return cls(spec, got | {"right": right, "left": left, "flags": np.zeros((len(right), spec.most_lead + 1), dtype=bool)})

    def scan(self, other: Level | None = None) -> None:
        """Marks windows that both have (or that this one has twice); only anchors in both are looked at."""
        if other is None:
            mine, theirs = np.arange(len(self.h)), None
        else:
            mine, theirs = self.shared(other)
            if not len(mine):
                return
        sides = [(self, mine)] + ([(other, theirs)] if other is not None else [])
        both = {k: np.concatenate([getattr(level, k)[rows] for level, rows in sides]) for k in ("right", "left", "lead", "cnt", "doc", "flags")}
        R.flag_windows(self.spec, both["right"], both["left"], both["lead"], both["cnt"], both["doc"], both["flags"])
        at = 0
        for level, rows in sides:
            level.flags[rows] |= both["flags"][at : at + len(rows)]
            at += len(rows)

    def shared(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """Rows here and there whose anchors both have, found from this level's side: a large other one is not gone through."""
        anchors = np.unique(self.h)
        low, high = (np.searchsorted(other.sorted_h, anchors, side) for side in ("left", "right"))
        both = high > low
        mine = np.flatnonzero(np.isin(self.h, anchors[both]))
        low, size = low[both], (high - low)[both]
        theirs = other.by_h[np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)]
        return mine, np.sort(theirs)

    def merged(self, other: Level) -> Level:
        return Level(self.spec, {k: np.concatenate([getattr(self, k), getattr(other, k)]) for k in self.FIELDS}, self.rank + 1)


class Family:
    """Levels of a logarithmic index: add() batches, then spans()."""

    def __init__(self, spec: R.Windows):
        self.spec, self.levels = spec, []

    def add(self, batch: pa.RecordBatch) -> None:
        new = Level.of(batch, self.spec)
        new.scan()
        for level in self.levels:
            new.scan(level)
        while self.levels and self.levels[-1].rank == new.rank:
            new = self.levels.pop().merged(new)
        self.levels.append(new)

    def spans(self) -> Iterator[pa.RecordBatch]:
        for level in self.levels:
            yield R.spans_of(self.spec, level.doc, level.rk, level.first, level.lead, level.flags)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = R.HOT_UNITS) -> DataFrame:
    """(id, text, n_bytes, n_removed, spans): the kept text, and the removed byte runs [s, e) of the input.

    One row for each row of `docs`.  A null text counts as empty; texts shorter
    than the window keep all bytes.  Rows with the same id, or with a null id,
    are documents of their own: a repeated row repeats its bytes.  `text` is
    binary, as a cut may fall inside a character.  An empty table gives an empty
    result; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    spec = R.Windows(window, gram, words=False, earlier=False)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(spec)
        for batch in batches:
            if batch.num_rows:
                family.add(batch)
        yield from family.spans()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            for chunk in K.chunks(batch.column(1)):
                kept, removed, runs = [], [], []
                for i, text in enumerate(chunk.texts):
                    gone = R.covered([(x["s"], x["e"]) for x in spans[chunk.first + i] or ()], len(text))
                    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                    runs.append([{"s": int(s), "e": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                    removed.append(int(gone.sum()))
                    kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if removed[-1] else text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n), pa.array(kept, pa.binary()), pa.array([len(t) for t in chunk.texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
                    names=["doc", "text", "n_bytes", "n_removed", "spans"],
                )

    texts = R.keyed(docs, id_col, text_col)
    # units of one anchor come together, so that a batch has few anchors in common with the levels before it
    found = R.with_spans(texts, R.repeated_spans(texts, spec, resolve, hot, ordered=True))
    out = found.mapInArrow(cut, "doc long, text binary, n_bytes long, n_removed long, spans array<struct<s: long, e: long>>")
    return out.withColumn("id", F.when(F.col("doc") != R.NO_ID, F.col("doc"))).select("id", "text", "n_bytes", "n_removed", "spans")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
