"""Line dedup by overlapping three-line windows.

Every window of three consecutive lines is hashed; windows that occur again anywhere are found by one grouped
aggregate, which keeps the first place of each. Later places cover three lines; covered lines are merged and
removed. Only hashes and places are shuffled to find repeats. The repeated windows are written to a table before
they are joined back, so that a window in very many documents meets a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import documents, stage

LINES = 3


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """uid, doc_id, pos, and two hashes of each window of `size` lines."""
    hashed = docs.select("uid", "doc_id", F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") >= size)
    second = lambda i: F.hash(*[F.element_at("h", i + j) for j in range(size)])
    each = F.transform(F.sequence(F.lit(1), F.size("h") - (size - 1)), lambda i: F.struct(F.xxhash64(*[F.element_at("h", i + j) for j in range(size)]).alias("a"), second(i).alias("b")))
    return hashed.select("uid", "doc_id", F.posexplode(each).alias("pos", "w")).select("uid", "doc_id", "pos", F.col("w.a").alias("a"), F.col("w.b").alias("b"))


def line_dedup(docs: DataFrame, size: int = LINES) -> DataFrame:
    """doc_id, n_lines, n_removed and the kept text of every row of docs (doc_id, text).

    Lines are split at line feeds. The first place of a window is that of the smallest (doc_id, position), null
    ids first; every other place is removed, overlapping places of one document included. A text with fewer than
    `size` lines has no window and stays whole. A null text is an empty one (one empty line). Rows that repeat
    both id and text are one document: they are cut alike. Other columns are ignored. A text of any length is read
    whole by one task; an empty table gives an empty result.
    """
    docs = documents(docs)
    windows = _windows(docs, size)
    place = F.struct("doc_id", "pos", "uid")
    repeated = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    repeated = stage(repeated.select("a", "b", F.col("first.uid").alias("first_uid"), F.col("first.pos").alias("first_pos")), "lines")
    later = windows.join(repeated, ["a", "b"]).where((F.col("uid") != F.col("first_uid")) | (F.col("pos") != F.col("first_pos")))
    gone = later.groupBy("uid").agg(F.collect_set("pos").alias("gone"))
    cut = docs.join(gone, "uid", "left").withColumn("lines", F.split("text", "\n", -1))
    covered = F.array_distinct(F.flatten(F.transform("gone", lambda p: F.array(*[p + j for j in range(size)]))))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered), lambda i: F.get("lines", i)), "\n"))
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long")
    return cut.select("doc_id", F.size("lines").cast("long").alias("n_lines"), removed.alias("n_removed"), kept.alias("text"))
