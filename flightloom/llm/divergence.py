"""Where the sources of a language differ: smoothed term shares of each source against the language and against each other.

Tasks count terms of whole texts in dictionaries of bounded size; what they send
is summed by (lang, source, term), which no hot source or term can crowd.

* Terms of a group that stand out: its terms lie in buckets of similar counts; a
  bucket's largest share in the group less its least share in the language bounds
  every difference in it.  Buckets are looked at from the best bound on, first as
  many as hold k terms, then all whose bound is not strictly below the k-th value
  found; what is left unseen cannot reach the first k, ties included.
* Pairs of sources: only terms that occur in one of both change the sum; postings
  of a block of terms become a small matrix in a task, and a term nobody in the
  block has adds the same amount, which is multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .minhash import few
from .shared import small_batches, staged, table

#: A term is kept in a language that has it in so many documents.
LEAST_DOCS = 30
#: Ranks of the term part.
TOP = 50
#: Added to each count.
PRIOR = 5
#: Shares are counted in parts of this.
SCALE = 1_000_000_000

#: Distinct (group, term) entries that a task holds before it sends them on.
HELD = 200_000
#: Sources of a block of the pair part, and postings of a block of terms.
BLOCK = 128
POSTINGS = 20_000

#: Bytes of terms: letters (upper case as lower case) and all bytes past ASCII; others separate.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), summed as far as HELD entries reach."""
    held: dict[tuple, list[dict]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(part), dtype=np.int64))) for x in (lang, source)]
                yield pa.record_batch([*same, pa.array(part, pa.binary()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for lang, source, text in zip(langs, sources, texts, strict=True):
            words = text.as_buffer().to_pybytes().translate(_TERM_BYTES).split()
            n, docs = held.setdefault((lang, source), ({}, {}))
            size -= len(n)
            for w in words:
                n[w] = n.get(w, 0) + 1
            for w in set(words):
                docs[w] = docs.get(w, 0) + 1
            size += len(n)
            if size > HELD:
                yield from sent()
                held.clear()
                size = 0
    yield from sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it; nulls are ''."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly; a product may pass 64 bits, so it is a decimal."""
    wide = (count + PRIOR).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + PRIOR * terms).cast("decimal(29,0)")).cast("long") + 1


def _bucket(count: Column) -> Column:
    """Counts up to 16 on their own, then eight buckets for each doubling."""
    return F.when(count <= 16, count).otherwise(F.floor(F.log2(count.cast("double")) * 8)).cast("int")


def _first(scored: DataFrame, k: int) -> DataFrame:
    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return scored.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= k)


def standing_out(spark: SparkSession, scored: DataFrame, k: int) -> DataFrame:
    """The k largest p - q > 0 of each group: lang, source, item, value, rank.

    `scored` is a written table (lang, source, item, bucket, p, q)."""
    found = scored.where("p > q")
    bounds = scored.groupBy("lang", "source", "bucket").agg(F.count(F.when(F.col("p") > F.col("q"), 1)).alias("terms"), (F.max("p") - F.min("q")).alias("bound")).where("bound > 0")
    best_first = Window.partitionBy("lang", "source").orderBy(F.col("bound").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = staged(spark, bounds.withColumn("before", F.coalesce(F.sum("terms").over(best_first), F.lit(0))))

    def seen(buckets: DataFrame) -> DataFrame:
        picked = found.join(few(buckets)(buckets.select("lang", "source", "bucket")), ["lang", "source", "bucket"], "left_semi")
        return _first(picked.select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value")), k)

    start = staged(spark, seen(bounds.where(F.col("before") < k)))
    kth = start.groupBy("lang", "source").agg(F.when(F.count(F.lit(1)) == k, F.min("value")).otherwise(0).alias("kth"))
    rest = staged(spark, bounds.where(F.col("before") >= k).join(kth, ["lang", "source"]).where("bound >= kth"))
    both = start.drop("rank").unionByName(seen(rest).drop("rank"))
    return _first(both, k)


def _apart(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of the terms of one block: for each two sources of two blocks, the sum of |p - q| over what both would add with no occurrence.

    Rows without item name the sources of the blocks, those without terms too."""
    source, sources = pd.factorize(rows["source"], sort=True)
    block, first = np.zeros(len(sources), dtype=np.int64), np.zeros(len(sources), dtype=np.int64)
    block[source], first[source] = rows["block"].to_numpy(), rows["p0"].to_numpy()
    term, terms = pd.factorize(rows["item"])
    share = np.tile(first, (len(terms), 1))
    share[term[term >= 0], source[term >= 0]] = rows["p"].to_numpy()[term >= 0]
    one, other = np.flatnonzero(block == key[2]), np.flatnonzero(block == key[3])
    values = np.zeros((len(one), len(other)), dtype=np.int64)
    for k, s in enumerate(one):
        values[k] = np.abs(share[:, other] - share[:, [s]]).sum(axis=0) - len(terms) * np.abs(first[other] - first[s])
    i, j = np.nonzero(values)
    names = np.asarray(sources, dtype=object)
    return pd.DataFrame({"lang": key[0], "source": names[one[i]], "item": names[other[j]], "part": values[i, j]})


def source_pairs(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language the sum of |p - q| over all its kept terms.

    posted: (lang, source, item, p, p0) of the terms that occur, groups: (lang,
    source, p0, terms) of all groups; p0 is the share of a term that does not.
    Sources are dealt into blocks of about BLOCK, terms into blocks so that two
    blocks of sources meet with about POSTINGS rows."""
    size = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    size = size.join(posted.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang").select("lang", "blocks", F.ceil(2 * F.col("n") / (F.col("blocks") * POSTINGS)).cast("int").alias("parts"))
    sent = few(size)(size)
    block = F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("block")
    dealt = posted.join(sent, "lang").select("lang", "source", "item", "p", "p0", "blocks", block, F.pmod(F.xxhash64(F.lit("terms"), "item"), "parts").cast("int").alias("terms"))
    named = groups.join(sent, "lang").select("lang", "source", F.lit(None).cast("string").alias("item"), F.col("p0").alias("p"), "p0", "blocks", block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("terms"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    there = F.transform(others, lambda b: F.struct(F.col("block").alias("one"), b.alias("other")))
    back = F.transform(F.filter(others, lambda b: b != F.col("block")), lambda b: F.struct(b.alias("one"), F.col("block").alias("other")))
    units = dealt.unionByName(named).withColumn("met", F.explode(F.concat(there, back))).select("lang", "source", "item", "p", "p0", "block", "terms", "met.one", "met.other")
    sums = units.groupBy("lang", "terms", "one", "other").applyInPandas(_apart, "lang string, source string, item string, part long").groupBy("lang", "source", "item").agg(F.sum("part").alias("part"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    every = groups.join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    return every.select("lang", "source", "item", (F.coalesce("part", F.lit(0)) + F.coalesce(F.col("terms") * F.abs(F.col("p0") - F.col("q0")), F.lit(0))).cast("long").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language: see the module and `op12_divergence_audit`.

    Null and empty texts have no terms, null languages and sources are ''; texts of
    any length are read whole; every row counts, repeated ones as often as they
    are there, and ids are not looked at.  A language whose terms are all rare has
    pairs of value 0 and no terms; a source alone in its language has no pairs.
    Ties of values go by the item's bytes.  An empty table gives an empty result;
    other columns are not looked at, whatever their names."""
    spark = docs.sparkSession
    counts = staged(spark, term_counts(docs))
    kept = staged(spark, counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
    posted = staged(spark, counts.join(kept, ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), "n", "in_lang"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total"))
    totals = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = staged(spark, groups.withColumn("p0", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))))
    scored = posted.join(few(groups)(groups), ["lang", "source"]).select(
        "lang", "source", "item", "p0", _bucket(F.col("n")).alias("bucket"),
        _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    scored = staged(spark, scored)
    pairs = source_pairs(scored, groups.select("lang", "source", "p0", "terms"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    shape = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return ranked.withColumn("part", F.lit("pair")).select(*shape).unionByName(standing_out(spark, scored, k).withColumn("part", F.lit("term")).select(*shape))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ),
    words AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
    langs AS (SELECT lang, count(*) AS v, sum(c) AS total FROM kept GROUP BY lang),
    n AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
    dense AS (
        SELECT g.lang, g.source, k.term, k.c, coalesce(n.n, 0) AS n, l.v, l.total
        FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
    ),
    shares AS (
        SELECT lang, source, term, n,
            1 + ({SCALE} * (n::HUGEINT + {PRIOR})) // (sum(n) OVER (PARTITION BY lang, source) + {PRIOR} * v) AS p,
            1 + ({SCALE} * (c::HUGEINT + {PRIOR})) // (total + {PRIOR} * v) AS q
        FROM dense
    ),
    apart AS (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ),
    every AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
    FROM every QUALIFY part = 'pair' OR rank <= {TOP}
"""
