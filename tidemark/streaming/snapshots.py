"""Snapshots as a stream: files in, the latest row of each key and versions out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.tables import append_versions, exists, present


def stream(spark: SparkSession, path: str, schema, clock: str, key: list[str], late: str = "1 day", files: int = 16) -> DataFrame:
    """New Parquet files under path as a stream; rows that repeat a key within the lateness are dropped, and state older than that is let go."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withWatermark(clock, late).dropDuplicatesWithinWatermark(key)


def windowed(rows: DataFrame, clock: str, group: list[str], value: str, width: str) -> DataFrame:
    """Count and sum by tumbling window and group; rows must carry a watermark."""
    out = rows.groupBy(F.window(clock, width).alias("window"), *group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *group, "n", "total")


def run_available(rows: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Works off all that is there and stops; a lost run goes on from the checkpoint."""
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def keep_versions(rows: DataFrame, store: str, checkpoint: str, key: list[str], content: list[str], seen: str) -> None:
    """Appends to store what is new or differs from the last version of its key, batch by batch; stored versions never change.

    Each batch writes the folder of its own number, so a batch that is run again replaces itself. Of the store, only
    the keys of the batch are looked at: they restrict it before its versions are compared.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if exists(spark, store):
            stored = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(store).where(~F.col("_metadata.file_path").contains(f"/batch={number}/"))
        else:
            stored = spark.createDataFrame([], batch.schema)
        one = batch.groupBy(*key).agg(F.max_by(F.struct("*"), seen).alias("r")).select("r.*")
        append_versions(present(stored, one, key), one, key, content, seen).write.mode("overwrite").parquet(f"{store}/batch={number}")

    rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def flushed(closed: DataFrame, history: DataFrame, clock: str, group: list[str], value: str, width: str) -> DataFrame:
    """The windows that a stream closed, and those still open behind its watermark, which the history after the last closed one gives."""
    last = closed.agg(F.max("window_start")).first()[0]
    open_ = history if last is None else history.where(F.col(clock) >= F.lit(last) + F.expr(f"INTERVAL {width}"))
    return closed.unionByName(windowed(open_, clock, group, value, width))
