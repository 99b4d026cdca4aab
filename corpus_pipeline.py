"""A corpus in five stages: language ID, near-duplicates, pseudonyms, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's docs.  All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm import language_id, minhash, mixing, pii, sentencepiece_bpe
from flightloom.llm.shared import shared_folder, staged

#: Documents are rejected whose language is `und` or less likely than this.
LEAST_SCORE = 0.35

#: Key of the pseudonyms where the session's setting pii.KEY_SETTING names none; a real run sets a secret.
EXAMPLE_KEY = "key of the example pipeline"

#: Targets of the mix are (documents of the source) ** POWER.
POWER = 0.7

#: Encodings that a Python worker keeps: a quarter of the usual, as executors hold what the stages before have left.
KEPT_CUTS = 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is clear. Rows pass as they are; `lang` stays the table's.

    Null and empty texts, and texts without a letter, go; rows with a null id or
    repeated rows are each judged by their text; texts of any length are read
    whole.  Without any labelled row all documents with a letter stay.  An empty
    table gives an empty one; other columns pass, whatever their names."""
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    out = language_id.predict(packed, model, keep=["row"])
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of texts with a similarity of 0.8 or more over five-word shingles.

    Rows with a null id stay; of rows with the same id one stays.  Null and empty
    texts are no copies of each other and stay.  An empty table gives an empty
    one; other columns pass, whatever their names."""
    found = minhash.near_duplicates(docs).where("id is not null").groupBy(F.col("id").alias("doc_id")).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    special = staged(spark, found.where("not kept or n > 1"))
    few = minhash.few(special)
    out = docs.join(few(special), "doc_id", "left_anti")
    repeated = special.where("kept")
    if repeated.isEmpty():
        return out
    return out.unionByName(docs.join(few(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows the new text.

    All rows stay, those with null ids and repeated ones too; a null text stays
    null, an empty one empty, a text of any length is read whole.  An empty table
    gives an empty one; other columns pass, whatever their names."""
    out = pii.pseudonymise(docs, spark.conf.get(pii.KEY_SETTING, EXAMPLE_KEY))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders all documents by their place in the mix.

    Every source is within one block of its target share among the sources that
    have not ended, so small sources end early and large ones go on alone; none
    of their documents is left out.  Null sources count as one source; rows with
    a null id, or with the same one, stand together at the place of their first
    one.  An empty table gives an empty one; other columns pass."""
    mixed = mixing.mix(docs.select("doc_id", "source"), mixing.natural_weights(docs, power=POWER), rest_power=POWER)
    placed = mixed.groupBy("doc_id").agg(F.min("position").alias("_at"))
    joined = docs.join(placed, docs["doc_id"].eqNullSafe(placed["doc_id"]))
    return joined.repartitionByRange(placed["_at"].asc_nulls_last()).sortWithinPartitions(placed["_at"].asc_nulls_last()).select(docs["*"])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts with an end id, and a check that they decode to the text: doc_id, source, n_tokens, ids, round_trip.

    One row for each row, null ids and repeated rows too; a null or empty text has
    the end id only; texts of any length are encoded whole.  An empty table gives
    an empty one; other columns are left out."""
    import public_tokenizers

    coded = sentencepiece_bpe.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "source", "text"], most_kept=KEPT_CUTS)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii_pseudonyms", pseudonymise),
    ("pfair_mixing", mix_sources),
    ("sentencepiece", tokenise),
]

#: SQL can express none of training, MinHash and merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
