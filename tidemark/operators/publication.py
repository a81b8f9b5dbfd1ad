"""Published documents: one JSON text a run, with a stated order and rounding, and what a reader demands of one.

Rows of a run are bounded by the quotes of one game. A document is made in the task that holds its rows and is the
same whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.sources.tables import exists

#: Version of the documents, the picks, and decimals of each number of a row.
SCHEMA_VERSION = "public-ready/v1"
PICKS = ("OVER", "UNDER", "YES")
DECIMALS = {"line": 1, "model_probability": 4, "edge": 4, "projection": 1}
ROW = ["opportunity_id", "player", "team", "prop", "pick", "line", "model_probability", "fair_odds", "book", "book_odds", "edge", "projection", "updated_at"]
REQUIRED = ("player", "team", "prop", "pick", "model_probability", "fair_odds", "book", "book_odds", "edge", "updated_at")
KINDS = {"line": "double", "model_probability": "double", "edge": "double", "projection": "double", "fair_odds": "bigint", "book_odds": "bigint"}
DOCUMENT = f"schema_version string, run string, game string, generated_at string, expires_at string, rows array<struct<{', '.join(f'{c}:{KINDS.get(c, 'string')}' for c in ROW)}>>"
#: Fixed value: how times are written.
CLOCK = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def picks(quotes: DataFrame) -> DataFrame:
    """Of the sides of each quote (run, player, prop, book, line) the one of larger edge, the later name of equals."""
    key = ["run", "player", "prop", "book", "line"]
    others = [c for c in quotes.columns if c not in key]
    best = quotes.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct("edge", "pick")).alias("_r"))
    return best.select(*key, "_r.*").select(*quotes.columns)


def excluded(quotes: DataFrame, as_of: Column, most_age: str) -> DataFrame:
    """quotes with reason: why one is not published (FUTURE_RECEIPT, STALE or MISSING_FIELDS), null if it is. updated_at: a time."""
    bare = F.lit(False)
    for c in REQUIRED:
        bare |= F.col(c).isNull() | (F.col(c).cast("string") == "")
    bare |= F.col("line").isNull() & F.col("pick").isin("OVER", "UNDER")
    age = F.expr(f"INTERVAL {most_age}")
    return quotes.withColumn("reason", F.when(F.col("updated_at") > as_of, "FUTURE_RECEIPT").when(F.col("updated_at") < as_of - age, "STALE").when(bare, "MISSING_FIELDS"))


def documents(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """run and document, one row for each of runs (run, game, generated_at, expires_at: times), also for one without rows.

    Rows come by falling edge, then player, prop, book and opportunity_id; numbers are rounded, times are written in UTC.
    """
    value = lambda c: F.round(c, DECIMALS[c]) if c in DECIMALS else F.date_format(c, CLOCK) if c == "updated_at" else F.col(c)
    made = rows.select("run", *[value(c).cast(KINDS.get(c, "string")).alias(c) for c in ROW])
    order = [-F.col("edge"), *map(F.col, ("player", "prop", "book", "opportunity_id"))]
    each = F.struct(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)]).alias("_o"), F.struct(*ROW).alias("r"))
    listed = made.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["r"]).alias("rows"))
    kind = DOCUMENT.rpartition("rows ")[2]
    fields = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("run").cast("string").alias("run"), F.col("game").cast("string").alias("game"), F.date_format("generated_at", CLOCK).alias("generated_at"), F.date_format("expires_at", CLOCK).alias("expires_at"), F.coalesce("rows", F.array().cast(kind)).alias("rows")]
    return runs.join(listed, "run", "left").select("run", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


def _writes(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the writes below path: a folder for each write, not for each run."""
    if not exists(spark, path):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return [int(n.removeprefix("write=")) for n in names if n.startswith("write=")]


def write_documents(made: DataFrame, path: str) -> None:
    """A line of text for each document, in a new folder for each write. A run that is written again replaces itself only: readers take its last line. One writer at a time is assumed."""
    n = max(_writes(made.sparkSession, path), default=0) + 1
    made.select(F.col("document").alias("value")).write.text(f"{path}/write={n}")


def faults(now: Column, most_age: str) -> Column:
    """Why a document (as columns) must not be used; null if it may."""
    time = lambda c: F.try_to_timestamp(c, F.lit(CLOCK)).cast("timestamp_ntz")
    generated, expires = time(F.col("generated_at")), time(F.col("expires_at"))
    bad = lambda r: (
        F.exists(F.array(*[r[c] for c in ("opportunity_id", "player", "team", "prop", "book")]), lambda x: x.isNull() | (x == "")) | ~F.coalesce(r["pick"].isin(*PICKS), F.lit(False)) | r["edge"].isNull()
        | ~F.coalesce(r["model_probability"].between(0.0, 1.0), F.lit(False)) | (r["line"].isNull() & r["pick"].isin("OVER", "UNDER")) | r["fair_odds"].isNull() | r["book_odds"].isNull() | ~F.coalesce(time(r["updated_at"]) <= generated, F.lit(False))
    )
    ids = F.transform("rows", lambda r: r["opportunity_id"])
    return (
        F.when(~F.coalesce(F.col("schema_version") == SCHEMA_VERSION, F.lit(False)), "SCHEMA").when(generated.isNull() | expires.isNull() | F.col("rows").isNull() | F.col("game").isNull(), "FIELDS")
        .when(now >= expires, "EXPIRED").when(generated < now - F.expr(f"INTERVAL {most_age}"), "STALE").when(generated > now + F.expr("INTERVAL 5 MINUTES"), "FUTURE")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "REPEATED").when(F.exists("rows", bad), "ROW")
    )


def read_documents(spark: SparkSession, path: str, now: Column, most_age: str) -> DataFrame:
    """The fields of every document below path, with fault. A text that is no such document has the fault SCHEMA."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.col("_metadata.file_path"), "write=([0-9]+)/", 1), F.lit("")), F.lit("9999999999")).cast("long"), F.lit(0))
    read = lines.select(F.from_json("value", DOCUMENT).alias("d"), number.alias("_write"))
    if len(_writes(spark, path)) > 1:
        last = read.groupBy(F.col("d.run").alias("_run")).agg(F.max("_write").alias("_last")).where("_run IS NOT NULL")
        read = read.join(last, F.col("d.run") == F.col("_run"), "left").where("_run IS NULL OR _write = _last")
    return read.select("d.*").withColumn("fault", faults(now, most_age))


def current(read: DataFrame) -> DataFrame:
    """Of the documents without fault the latest of each game, ties to the larger run."""
    place = F.row_number().over(Window.partitionBy("game").orderBy(F.desc("generated_at"), F.desc("run")))
    return read.where("fault IS NULL").withColumn("_n", place).where("_n = 1").drop("_n", "fault")
