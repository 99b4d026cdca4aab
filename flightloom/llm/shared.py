"""Helpers that the operators of this subpackage share: tables, staging, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of an Arrow batch: a batch of texts then holds a few MB, whatever the partition's size.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Limits the rows that Spark hands to Python at once; texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a local folder is
    set.  A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): rows (v, comp), comp the smallest v reachable.

    Every round hooks each component to its smallest neighbour, shortens chains
    by following the hook, and keeps only links between different components, so
    that the links shrink quickly; each round is written to the shared folder."""
    edges = staged(spark, links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = staged(spark, edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().select("v", F.col("v").alias("comp")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least")).select("u", F.least("u", "least").alias("to"))
        for _ in range(2):
            far = hook.select(F.col("u").alias("to"), F.col("to").alias("far"))
            hook = hook.join(far, "to", "left").select("u", F.coalesce("far", "to").alias("to"))
        hook = staged(spark, hook)
        to = hook.select(F.col("u").alias("comp"), "to")
        labels = staged(spark, labels.join(to, "comp", "left").select("v", F.coalesce("to", "comp").alias("comp")))
        ends = edges.join(hook.select(F.col("u").alias("a"), F.col("to").alias("x")), "a").join(hook.select(F.col("u").alias("b"), F.col("to").alias("y")), "b")
        edges = staged(spark, ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels
