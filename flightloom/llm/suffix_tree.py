"""Substring deduplication over words with prefix-partitioned suffix trees.

A word is removed if a window of 50 words covers it that also starts in a
document with a smaller id.  Candidates come from ``repeats``.  Suffixes are
split by prefix: first by the anchor's words, and groups larger than a task may
hold by the whole window (the longest prefix that matters, see ``repeats``, step
3).  A task reads its suffixes in the order of the anchors and takes as many
whole prefixes at a time as fit; the group's suffix tree is kept as its sorted
suffixes with their common prefix lengths, and the internal nodes of sufficient
depth, on both sides of the anchor together, are the repeated windows.
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

WINDOW, GRAM = 50, 8

#: Units (of about 70 words) whose trees are built at once.
GROUP_UNITS = 8_000


def _tree_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by prefix `h`, regrouped so that no prefix is cut and groups hold about `most` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= most:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            last = held[-1].column("h")[-1].as_py()
            cut = int(np.searchsorted(h != last, True)) if (h != last).any() else len(h)
            held.append(batch.slice(0, cut))
            if cut == len(h):
                size += cut
                continue
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def resolver(spec: R.Windows, most: int = GROUP_UNITS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _tree_groups(batches, most):
            units = R.Units.of(group, spec)
            right, left = units.contexts()
            flags = np.zeros((len(right), spec.most_lead + 1), dtype=bool)
            R.flag_windows(spec, right, left, units.lead, units.cnt, units.doc, flags)
            yield R.spans_of(spec, units.doc, units.rk, units.first, units.lead, flags)

    return run


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = R.HOT_UNITS) -> DataFrame:
    """(id, text, n_words, n_removed): the kept words joined by one space.

    One row for each row of `docs`.  Words are `[^\\x20\\x09-\\x0D]+`, unchanged.
    A null text has no words.  A null id counts as larger than every id, so such
    a row loses what any row with an id has, and takes from none.  Rows with the
    same id never take from each other.  An empty table gives an empty result;
    other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    spec = R.Windows(window, gram, words=True, earlier=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            for chunk in K.chunks(batch.column(1)):
                _, begin, stop, first = K.words(chunk, folded=False)
                kept, counts, removed = [], [], []
                data = chunk.data.tobytes()
                for i in range(chunk.n):
                    lo, hi = first[i], first[i + 1]
                    gone = R.covered([(x["s"], x["e"]) for x in spans[chunk.first + i] or ()], hi - lo)
                    stay = np.flatnonzero(~gone) + lo
                    kept.append(b" ".join([data[s:e] for s, e in zip(begin[stay].tolist(), stop[stay].tolist(), strict=True)]))
                    counts.append(hi - lo)
                    removed.append(int(gone.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=["doc", "text", "n_words", "n_removed"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return resolver(spec)(batches)

    texts = R.keyed(docs, id_col, text_col)
    found = R.with_spans(texts, R.repeated_spans(texts, spec, resolve, hot, ordered=True))
    out = found.mapInArrow(cut, "doc long, text string, n_words long, n_removed long")
    return out.withColumn("id", F.when(F.col("doc") != R.NO_ID, F.col("doc"))).select("id", "text", "n_words", "n_removed")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passage_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
