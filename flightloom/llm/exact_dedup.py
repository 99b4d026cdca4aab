"""Exact duplicates: rows meet by a 128-bit hash of the text, and are told apart by the text's bytes.

The first aggregation groups by hash and whole text, so two texts are one group
only if their bytes are equal; it combines before the shuffle, so a text that a
third of all rows share is sent once from each task.  What goes on is one narrow
row for each hash.  Hashes that several texts share (none, unless made on purpose)
are joined by text, all others by hash alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import few
from .shared import fresh, staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """The text with A-Z as a-z and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def as_it_is(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def with_groups(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column], stays: Callable[[Column], Column], digest: Callable[[Column], Column] = hash128, keep: list[str] | None = None, also: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The columns `keep`, then id, keep_id, group_size and the columns `also` (functions of the normalised text), a row for each row.

    keep_id is `stays` (F.min or F.max) of the ids of the group's rows; null ids
    do not count."""
    rows = docs.select(F.struct(*[docs[c] for c in keep or []]).alias("kept") if keep else F.lit(None).alias("kept"), docs[id_col].alias("id"), normalise(docs[text_col].cast("string")).alias("body"))
    rows = rows.withColumn("h", digest(F.col("body")))
    texts = rows.groupBy("h", "body").agg(F.count(F.lit(1)).alias("n"), stays("id").alias("keep_id"))
    hashes = texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), stays("keep_id").alias("keep_id"))
    several = staged(docs.sparkSession, hashes.where("n > 1"))
    sent = few(several)

    def result(found: DataFrame) -> DataFrame:
        own = F.when(F.col("n") > 1, F.col("keep_id")).otherwise(F.col("id"))
        made = [f(F.col("body")).alias(name) for name, f in (also or {}).items()]
        return found.select(*(["kept.*"] if keep else []), "id", own.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), *made)

    whole = rows.join(sent(several), "h", "left")
    out = result(whole.where("texts is null or texts = 1"))
    collided = several.where("texts > 1").select("h")
    if collided.isEmpty():
        return out
    apart = rows.join(few(collided)(collided), "h", "left_semi")
    groups = staged(docs.sparkSession, apart.groupBy("h", "body").agg(F.count(F.lit(1)).alias("n"), stays("id").alias("keep_id")))
    return out.unionByName(result(apart.join(groups, ["h", "body"])))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = folded, digest: Callable[[Column], Column] = hash128, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep`, then id, keep_id, group_size, kept, text_sha256: a row for each row of docs, dropped ones too.

    Texts are equal when `normalise` makes them equal, byte for byte (by default
    A-Z count as a-z); a null text is an empty one, and empty texts are copies of
    each other.  Of equal texts the row with the largest id stays: kept is
    id = keep_id.  Rows with the same id and text are one document given several
    times: each counts in group_size, and all of them are kept if their id is.  A
    row without id is kept only where no equal text has an id (keep_id is then
    null).  Texts of any length are compared whole.  An empty table gives an empty
    result; other columns are not looked at, whatever their names."""
    made = with_groups(docs, id_col, text_col, normalise, F.max, digest, keep, {"text_sha256": lambda body: F.sha2(body, 256)})
    front = list(keep or [])
    return made.select(*front, "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = folded) -> DataFrame:
    """The rows of docs that `mark_copies` keeps, with all their columns."""
    row = fresh(docs, "row")
    packed = docs.select("*", F.struct(*[docs[c] for c in docs.columns]).alias(row))
    return mark_copies(packed, id_col, text_col, normalise, keep=[row]).where("kept").select(f"{row}.*")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE = f"""
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, (count(*) OVER w)::BIGINT AS group_size,
        doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY body)
"""
