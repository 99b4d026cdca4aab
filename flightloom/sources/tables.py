"""Reading and writing: directories of tracks, CSV, station reports, and incremental tables."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.atmosphere import clean
from ..operators.series import dedupe_first

REPORT_SCHEMA = "station string, valid string, elevation double, tmpf double, dwpf double, relh double, drct double, sknt double, p01i double, alti double, vsby double, feel double"


def tracks(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A directory of parquet files, one per flight; the file's name without its ending is flight_id where the files have none.

    NaN and infinite doubles become NULL."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    if "flight_id" not in df.columns:
        df = df.withColumn("flight_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", ""))
    return df.withColumns({f.name: clean(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)})


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; malformed lines are dropped."""
    return spark.read.schema(schema).option("header", "true").option("mode", "DROPMALFORMED").csv(path)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Station reports with `#` comments and UTC times; an empty table where the path has none."""
    reader = spark.read.schema(REPORT_SCHEMA).option("header", "true").option("comment", "#")
    try:
        df = reader.csv(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], REPORT_SCHEMA)
    return df.withColumn("valid", F.try_to_timestamp("valid"))


def first_of(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first table, and those of the second whose keys the first lacks."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def splits(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of all splits, tagged by the column dataset; missing columns are NULL."""
    out = None
    for name, df in tables.items():
        tagged = df.withColumn("dataset", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def grid_table(levels: DataFrame) -> DataFrame:
    """A long grid (lat_i, lon_i, hour, level, val) to one row a cell with its levels in order."""
    return levels.groupBy("lat_i", "lon_i", "hour").agg(F.array_sort(F.collect_list(F.struct("level", "val"))).alias("levels"))


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What an earlier run has not written yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def values_of(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The distinct values of one column; only that column is read."""
    return spark.read.parquet(path).select(column).distinct()


def continued(spark: SparkSession, todo: DataFrame, keys: list[str], path: str, work, batches: int) -> DataFrame:
    """work(part) for the rows of `todo` that `path` does not have yet, batch by batch, each written when it is done; a broken run goes on where it ended.

    Parquet files appear only when a batch has been committed, so there are no half-written ones to recover from."""
    for k in range(batches):
        part = todo.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == k)
        try:
            part = not_done(part, spark.read.parquet(path), keys)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        write(work(part), path, mode="append")
    return spark.read.parquet(path)


def _footer_is_bad(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) to (path, reason) of files whose footer cannot be read."""
    for b in batches:
        bad = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                pq.read_metadata(io.BytesIO(content))
            except (pa.ArrowException, OSError) as e:
                bad.append((path, str(e).split("\n")[0]))
        yield pa.record_batch([pa.array([x[k] for x in bad], pa.string()) for k in (0, 1)], names=["path", "reason"])


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of each parquet file of a table whose footer cannot be read.

    Spark reads all footers and skips bad ones; only files that gave no row, bad or
    without rows, are looked at on their own, in tasks.  Files of no bytes, which
    Spark passes over without a word, are found in the folder's list."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    rows = spark.read.schema(T.StructType([])).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(path)
    good = rows.groupBy(F.col("_metadata.file_path").alias("path")).count()
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    suspect = listed.join(good.select(plain("path").alias("good")), plain(listed["path"]) == F.col("good"), "left_anti")
    bad = suspect.select("path", "content").mapInArrow(_footer_is_bad, "path string, reason string")
    return bad.unionByName(spark.createDataFrame(_empty_files(spark, path), "path string, reason string"))


def _empty_files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    each, out = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while each.hasNext():
        status = each.next()
        name = status.getPath().getName()
        if status.getLen() == 0 and name.endswith(".parquet") and not name.startswith(("_", ".")):
            out.append((status.getPath().toString(), "no bytes"))
    return out


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    places = [jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    if not places[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(*places):
        raise OSError(f"cannot rename {source} to {target}")


def readable(spark: SparkSession, path: str, again: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`; one that is not there, or has a damaged file, is computed by again() and put in its place.

    The new table is written beside the old one and swapped in by renaming, the
    damaged one stays as `path.damaged-...`; if again() fails, or any other error
    comes up (a lost executor, say), the old table is as it was."""
    path = path.rstrip("/")
    try:
        bad = damaged(spark, path).limit(1).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        write(again(), path)
        return spark.read.parquet(path)
    if bad or not _has_files(spark, path):
        fresh, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "damaged"))
        write(again(), fresh)
        _rename(spark, path, old)
        _rename(spark, fresh, path)
    return spark.read.parquet(path)


def _has_files(spark: SparkSession, path: str) -> bool:
    return not spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path").isEmpty()


def merge_days(parts: DataFrame, flight: str = "flight_id", t: str = "timestamp", order: str = "date") -> DataFrame:
    """Day parts of flights to whole flights: of equal times the earlier part's row stays, for every flight."""
    return dedupe_first(parts, [flight, t], order)


def write(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    (df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)).parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result in one file with a header, or as JSON lines."""
    one = df.coalesce(1).write.mode("overwrite")
    one.option("header", "true").csv(path) if kind == "csv" else one.json(path)


def next_version(names: list[str]) -> int:
    """One more than the largest vN among names."""
    import re

    return max((int(m) for n in names for m in re.findall(r"v(\d+)", n)), default=0) + 1
