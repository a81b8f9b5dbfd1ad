"""Files that must be what they were: hashes of whole files, pins, and an index from keys to the files that hold them.

Bytes are read and hashed in tasks. What reaches the driver is a row for each file that is asked for.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.quality import require_empty


def _local(path: Column) -> Column:
    """A file's name within its folder; how its store is addressed does not matter."""
    return F.element_at(F.split(path, "/"), -1)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """file, sha256 and n_bytes of every file below path that fits the pattern."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(_local(F.col("path")).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def manifest(spark: SparkSession, path: str, cutoff: str, pattern: str = "*.parquet") -> DataFrame:
    """file, sha256, n_bytes and cutoff: what a data set is as of a time."""
    return file_hashes(spark, path, pattern).withColumn("cutoff", F.lit(cutoff))


def differences(spark: SparkSession, path: str, stored: DataFrame, pattern: str = "*.parquet") -> DataFrame:
    """file and fault (CHANGED, MISSING or NEW) of every file that is not what a manifest says."""
    now, then = file_hashes(spark, path, pattern).select("file", F.col("sha256").alias("_now")), stored.select("file", F.col("sha256").alias("_then"))
    fault = F.when(F.col("_now").isNull(), "MISSING").when(F.col("_then").isNull(), "NEW").when(F.col("_now") != F.col("_then"), "CHANGED")
    return then.join(now, "file", "full").select("file", fault.alias("fault")).where("fault IS NOT NULL")


def pinned_scan(spark: SparkSession, path: str, sha256: str, n_rows: int, where: dict[str, object], columns: Iterable[str]) -> DataFrame:
    """The columns of a file with source_sha256, once its bytes, its row count and the only values of the columns in `where` are the pinned ones.

    Anything else is an error. A season or a status file that somebody replaced is never read by mistake.
    """
    one = file_hashes(spark, path, "*").select("sha256").collect()
    if [r.sha256 for r in one] != [sha256]:
        raise ValueError(f"{path} does not have the pinned bytes")
    rows = spark.read.parquet(path)
    same = [F.coalesce(F.bool_and(F.col(c).eqNullSafe(F.lit(v))), F.lit(True)).alias(f"_{i}") for i, (c, v) in enumerate(where.items())]
    count, *ok = rows.agg(F.count("*"), *same).first()
    if count != n_rows or not all(ok):
        raise ValueError(f"{path} has {count} rows, not {n_rows}, or other values than the pinned {where}")
    return rows.select(*columns, F.lit(sha256).alias("source_sha256"))


def key_index(table: DataFrame, key: str) -> DataFrame:
    """key and file, once for each pair: which files of a table of Parquet files hold which keys. A null key is in no file."""
    return table.where(F.col(key).isNotNull()).select(key, F.col("_metadata.file_path").alias("file")).distinct()


def write_index(index: DataFrame, path: str, key: str) -> None:
    """Stores an index sorted by key, so that a lookup reads few of its row groups."""
    index.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def live_index(index: DataFrame, files: DataFrame) -> DataFrame:
    """index without files that are no longer there (compacted away). files: a column file."""
    return index.join(files.select("file"), "file", "left_semi")


def indexed_scan(spark: SparkSession, index: DataFrame, key: str, values: Iterable, schema) -> DataFrame:
    """The rows of the given keys, from the files that the index names for them and no others. values: a bounded list."""
    wanted = list(values)
    files = [r.file for r in index.where(F.col(key).isin(wanted)).select("file").distinct().collect()]  # the files to list
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.where(F.col(key).isin(wanted))


def require_manifest(spark: SparkSession, path: str, stored: DataFrame, pattern: str = "*.parquet") -> None:
    require_empty(differences(spark, path, stored, pattern), f"files of {path} that differ from their manifest")
