"""How filters interact: what each of an order of filters removes, over every order, from packed bitmaps.

Each batch of a partition becomes a bitmap index: a numpy bitset for every filter,
every label and every part, rows of a part standing together.  For each subset of
the filters that can go before another, AND-NOT leaves the rows that are still
there, and popcounts say what the next filter removes.  Partition counts are
summed; the orders are joined to the sums, so no row is visited once an order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exact_dedup import as_it_is, with_groups
from .shared import fresh, table

FILTERS = "ABCDE"

#: Bits of a row: the filters in order, then good and toxic.
GOOD, TOXIC = len(FILTERS), len(FILTERS) + 1


def _once(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def text_failures(text: Column) -> list[Column]:
    """Whether a text (not null) fails A: under 200 words, B: under half of its words distinct, C: over 3 % capitals, D: holds one of #$%&*|."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    ab = _once(words, lambda w: F.struct((F.size(w) < 200).alias("a"), (100 * F.size(F.array_distinct(w)).cast("long") < 50 * F.size(w).cast("long")).alias("b")))
    length = F.length(text).cast("long")
    small = F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")).cast("long")
    return [ab["a"], ab["b"], 100 * (length - small) > 3 * length, text.rlike(r"[#$%&*|]")]


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits) of each document: bit f for the f-th filter, then good, then toxic."""
    row = fresh(docs, "row")
    part = F.coalesce(docs["lang"].cast("string"), F.lit(""))
    packed = docs.select("doc_id", "text", F.struct(part.alias("part")).alias(row))

    def failing(body: Column) -> Column:
        return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(text_failures(body))), F.lit(0))

    first = with_groups(packed, "doc_id", "text", as_it_is, F.min, keep=[row], also={"bits": failing})
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.when(F.col("keep_id") < F.col("id"), 1 << FILTERS.index("E")).otherwise(0)
    good, toxic = (F.when(F.col(c) == 1, 1 << k).otherwise(0) for c, k in (("good", GOOD), ("toxic", TOXIC)))
    return first.join(marks, "id", "left").select(F.col(f"{row}.part").alias("part"), (F.col("bits") + copy + good + toxic).cast("int").alias("bits"))


def _packed(flags: np.ndarray) -> np.ndarray:
    """A bitset of 64-bit words."""
    bits = np.packbits(flags)
    return np.concatenate([bits, np.zeros(-len(bits) % 8, dtype=np.uint8)]).view(np.uint64)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, bits) to (part, before, filter, there, removed, good, toxic, failing, only): for each part, subset of filters before and filter that is not in it."""
    n = len(FILTERS)
    steps = [(before, f) for before in range(1 << n) for f in range(n) if not before >> f & 1]
    sums: dict[str, np.ndarray] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for name, table_ in sums.items():
            heads = [pa.array([name] * len(steps), pa.string()), pa.array([s[0] for s in steps], pa.int32()), pa.array([s[1] for s in steps], pa.int32())]
            yield pa.record_batch([*heads, *[pa.array(x, pa.int64()) for x in table_.T]], names=["part", "before", "filter", "there", "removed", "good", "toxic", "failing", "only"])
        sums.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        code, bits = code[order], batch.column(1).to_numpy(zero_copy_only=False)[order]
        filters = [_packed(bits >> f & 1) for f in range(n)]
        good, toxic = _packed(bits >> GOOD & 1), _packed(bits >> TOXIC & 1)
        edges = np.searchsorted(code, np.arange(len(names) + 1))
        for k, name in enumerate(names):
            # the part's bitset is empty but for these words
            lo, hi = edges[k] // 64, -(-edges[k + 1] // 64)
            mine = _packed(code[lo * 64 : hi * 64] == k)
            fails, ok, bad = [x[lo:hi] & mine for x in filters], good[lo:hi], toxic[lo:hi]
            left = [mine] * (1 << n)
            for before in range(1, 1 << n):
                f = before.bit_length() - 1
                left[before] = left[before ^ (1 << f)] & ~fails[f]
            found = np.empty((len(steps), 6), dtype=np.int64)
            for at, (before, f) in enumerate(steps):
                gone = left[before] & fails[f]
                others = (1 << n) - 1 ^ (1 << f)
                found[at] = [int(np.bitwise_count(x).sum()) for x in (left[before], gone, gone & ok, gone & bad, fails[f], left[others] & fails[f])]
            sums[name] = sums.get(name, 0) + found
        if len(sums) > 1000:
            yield from sent()
    yield from sent()


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): for each lang all orders of the filters.

    Filter E fails rows whose text a smaller id has anywhere in the table, in this
    part or another, removed or not; a row without id is no copy and makes none.
    Null texts are empty (they fail A; B and C need more than 0), null languages
    are the part ''.  Rows that repeat count as often as they are there (the same
    id is not a smaller one); a document with several labels is good if one of
    them is, toxic likewise; nulls in labels count as 0.  Texts of any length are
    read whole.  An empty table gives an empty result; other columns are not
    looked at, whatever their names."""
    spark = docs.sparkSession
    counts = flagged(docs, labels).mapInArrow(_counted, "part string, before int, filter int, there long, removed long, good long, toxic long, failing long, only long")
    sums = counts.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ("there", "removed", "good", "toxic", "failing", "only")])
    n = len(FILTERS)
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    sums = sums.withColumn("shapley", F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "filter")))
    orders = [("".join(o), k + 1, sum(1 << FILTERS.index(x) for x in o[:k]), FILTERS.index(o[k])) for o in permutations(FILTERS) for k in range(n)]
    steps = spark.createDataFrame(orders, "filter_order string, step int, before int, filter int")
    return sums.join(F.broadcast(steps), ["before", "filter"]).select(
        "part", "filter_order", "step", (F.col("there") - F.col("removed")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        F.col("only").alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.col("shapley").cast("long").alias("shapley"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
    WITH docs AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
            coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS e
        FROM documents
    ),
    marks AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
    flags AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
            len(words) < 200,
            100 * len(list_distinct(words)) < 50 * len(words),
            100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
            regexp_matches(text, '[#$%&*|]'), e] AS fails
        FROM docs LEFT JOIN marks USING (doc_id)
    ),
    cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
    letters(f, i) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
    orders AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
    ),
    steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, o FROM orders),
    states AS (
        SELECT part, filter_order, step, o[step] AS f, n, good, toxic, fails[o[step]] AS failing,
            len(list_filter(o[1:step - 1], lambda i: fails[i])) = 0 AS there, len(list_filter(fails, lambda x: x)) AS many
        FROM cells, steps
    ),
    done AS (
        SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (there AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (there AND failing), 0) AS removed,
            coalesce(sum(n) FILTER (failing AND NOT there), 0) AS redundant, coalesce(sum(n) FILTER (failing AND many = 1), 0) AS unique_fails,
            coalesce(sum(good) FILTER (there AND failing), 0) AS good_lost, coalesce(sum(toxic) FILTER (there AND failing), 0) AS toxic_lost
        FROM states GROUP BY part, filter_order, step, f
    )
    SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
        good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
    FROM done
"""
