"""Tables as Parquet folders: scans, views, and the ways of adding to them.

Writes that depend on what is stored (keyed, versioned, first-wins) read the stored table, write the new state beside
it and append a pointer to it; the pointer with the largest number counts and none is ever overwritten, so a lost job
leaves the old state readable. One writer at a time is assumed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

POINTER = "_current"


def scan(spark: SparkSession, path: str, where: Column | str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """A Parquet table; filter and columns reach the reader."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def union_wide(*parts: DataFrame) -> DataFrame:
    """All rows of the parts, columns by name; types are widened, absent columns are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def register_views(spark: SparkSession, root: str, names: Iterable[str]) -> None:
    for name in names:
        spark.read.parquet(f"{root}/{name}.parquet").createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """SQL over registered views, with named parameters."""
    return spark.sql(sql, args=args or None)


def absent(batch: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of batch whose key is not stored."""
    return _null_safe(batch, stored, key, "left_anti")


def present(batch: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of batch whose key is stored."""
    return _null_safe(batch, stored, key, "left_semi")


def _null_safe(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    keys = right.select(*[F.col(k).alias(f"_key_{k}") for k in key]).distinct()
    on = F.lit(True)
    for k in key:
        on &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(keys, on, how)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the checkpoint folder that driver and executors share; set here only where nobody has, on a local master."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def keep_one(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; the order must decide ties."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(stored: DataFrame, batch: DataFrame, key: list[str], keep: str = "last", order: list[str] | None = None) -> DataFrame:
    """Stored and batch with one row for each key: of the batch if keep is 'last', else of the store. The store has a key once.

    Of a key that batch repeats the row counts that is last (or first) by `order` (if given) and then by all columns, so
    a task that runs again gives the same row. Columns that have no order, such as maps, must not be needed for it.
    """
    rest = [c for c, kind in batch.dtypes if c not in {*key, *(order or [])} and "map<" not in kind]
    by = [F.col(c).desc_nulls_last() if keep == "last" else F.col(c).asc_nulls_first() for c in [*(order or []), *rest]]
    batch = keep_one(batch, key, by or [F.lit(0)])
    if keep == "last":
        return union_wide(absent(stored, batch, key), batch)
    return union_wide(stored, absent(batch, stored, key))


def content_hash(columns: Iterable[str]) -> Column:
    """SHA-256 of the columns in name order, null told apart from the empty text."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def append_versions(stored: DataFrame, batch: DataFrame, key: list[str], content: list[str], seen: str) -> DataFrame:
    """Rows of batch that are new or differ from the latest stored version of their key; stored versions never change.

    seen: the column that orders versions. A row of batch without a key in the store is new.
    """
    latest = stored.groupBy(*key).agg(F.max_by(content_hash(content), seen).alias("_last"))
    keys = latest.select(*[F.col(k).alias(f"_key_{k}") for k in key], "_last")
    on = F.lit(True)
    for k in key:
        on &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    fresh = batch.withColumn("_hash", content_hash(content)).join(keys, on, "left")
    return fresh.where("_last IS NULL OR _last <> _hash").select(*batch.columns)


def append_outcomes(stored: DataFrame, batch: DataFrame, key: list[str], content: list[str], seen: str = "first_seen_at", available: str = "available_at", estimated: str | None = None) -> DataFrame:
    """Rows of batch that become new versions of their keys (null equal to null), in the columns of batch.

    A key that is new comes as it is. One whose content differs from the latest stored version is a correction: nobody could
    know it before it was seen, so `available` is at least `seen`, and its time is no estimate. What repeats the latest
    version, or another row of batch, is left out. Two contents of a key in one batch, a correction seen no later than what
    it corrects, or a row without `seen` are errors. stored has the columns key, content and seen.
    """
    digest = content_hash(content)
    rest = [c for c, kind in batch.dtypes if c not in {*key, *content} and "map<" not in kind]
    rows = keep_one(batch.withColumn("_hash", digest), [*key, "_hash"], [F.col(c).asc_nulls_last() for c in rest] or [F.lit(0)])
    twice = batch.groupBy(*key).agg(F.min(digest).alias("_a"), F.max(digest).alias("_b")).where("_a <> _b").select(*key).limit(1).collect()
    if twice:
        raise ValueError(f"two contents of a key in one batch: {twice[0].asDict()}")
    latest = stored.groupBy(*key).agg(F.max_by(digest, F.struct(F.col(seen), digest)).alias("_last"), F.max(seen).alias("_at"))
    keys = latest.select(*[F.col(k).alias(f"_key_{k}") for k in key], "_last", "_at")
    on = F.lit(True)
    for k in key:
        on &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    fresh = rows.join(keys, on, "left").where("_last IS NULL OR _last <> _hash")
    correction = F.col("_last").isNotNull()
    error = lambda text: F.raise_error(F.lit(text)).cast(dict(batch.dtypes)[seen])
    at = F.when(F.col(seen).isNull(), error("a row does not say when it was seen")).when(correction & (F.col(seen) <= F.col("_at")), error("a correction was seen no later than what it corrects")).otherwise(F.col(seen))
    out = fresh.withColumn(seen, at).withColumn(available, F.when(correction, F.greatest(F.col(available), F.col(seen))).otherwise(F.col(available)))
    if estimated:
        out = out.withColumn(estimated, F.when(correction, False).otherwise(F.col(estimated)))
    return out.select(*batch.columns)


def replace(df: DataFrame, root: str, sort_by: list[str] | None = None) -> str:
    """Writes df as the new state of the table at root and points to it; what was there stays on disk."""
    state = f"{root}/state-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.option("compression", "zstd").parquet(state)
    return _point(df.sparkSession, root, state)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("n long, state string").json(f"{root}/{POINTER}")


def _point(spark: SparkSession, root: str, state: str) -> str:
    last = _pointers(spark, root).agg(F.max("n")).first()[0] if exists(spark, f"{root}/{POINTER}") else None
    spark.createDataFrame([((last or 0) + 1, state)], "n long, state string").coalesce(1).write.mode("append").json(f"{root}/{POINTER}")
    return state


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table's state that was pointed to last."""
    return spark.read.parquet(_pointers(spark, root).agg(F.max_by("state", "n")).first()[0])


def compact(spark: SparkSession, root: str, rows_per_file: int = 1_000_000) -> str:
    """The same rows in larger files; sizes follow Spark's writer, no task collects the table."""
    state = f"{root}/state-{uuid.uuid4().hex}"
    current(spark, root).hint("rebalance").write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(state)
    return _point(spark, root, state)


PARTS = "_parts"
#: A table of parts is compacted when so many of them are small; a part of so many rows is none of these.
SMALL_PARTS, SMALL_ROWS = 32, 1_000_000


def _live(spark: SparkSession, root: str) -> tuple[int, list[tuple[str, int]]]:
    """Number of the last list of parts, and the parts (folder, rows) in it."""
    if not exists(spark, f"{root}/{PARTS}"):
        return 0, []
    row = spark.read.schema("n long, parts array<struct<at: string, rows: long>>").json(f"{root}/{PARTS}").agg(F.max("n").alias("n"), F.max_by("parts", "n").alias("parts")).first()
    return row["n"], [(p["at"], p["rows"]) for p in row["parts"]]


def _list_parts(spark: SparkSession, root: str, n: int, parts: list[tuple[str, int]]) -> None:
    spark.createDataFrame([(n + 1, parts)], "n long, parts array<struct<at: string, rows: long>>").coalesce(1).write.mode("append").json(f"{root}/{PARTS}")


def _write_part(df: DataFrame, root: str) -> tuple[str, int]:
    at = f"{root}/part-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return at, df.sparkSession.read.parquet(at).count()


def live_parts(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all live parts of a table, columns by name and types widened."""
    _, parts = _live(spark, root)
    if not parts:
        raise ValueError(f"no parts at {root}")
    return union_wide(*[spark.read.parquet(at) for at, _ in parts])


def append_part(batch: DataFrame, root: str, key: list[str], keep: str = "last", order: list[str] | None = None) -> int:
    """Adds batch to the table of parts at root as one new part, and returns how many rows that has.

    Keys are compared with null equal to null. keep "first": only rows whose key is not stored are written. keep "last": rows
    of batch replace stored ones; only the parts that hold such keys are written anew without them, the others are not
    touched. A key that batch repeats counts once, as in `upsert`. Parts never change on disk and a new list of parts is
    appended last, so a job that is lost leaves the old state readable. One writer at a time is assumed.
    """
    spark = batch.sparkSession
    n, parts = _live(spark, root)
    if not parts:
        new = _write_part(upsert(empty_like(batch), batch, key, keep, order), root)
        _list_parts(spark, root, n, [new])
        return new[1]
    stored = live_parts(spark, root)
    if keep == "first":
        new = _write_part(absent(upsert(empty_like(batch), batch, key, keep, order), stored.select(*key), key), root)
        if new[1]:
            _list_parts(spark, root, n, [*parts, new])
        return new[1]
    new = _write_part(upsert(empty_like(batch), batch, key, keep, order), root)
    keys = spark.read.parquet(new[0]).select(*key)
    named = union_wide(*[spark.read.parquet(at).select(*key).withColumn("_at", F.lit(at)) for at, _ in parts])
    touched = {r["_at"] for r in present(named, keys, key).select("_at").distinct().collect()}  # a name for each part at most
    kept = [p for p in parts if p[0] not in touched]
    for at in sorted(touched):
        rest = _write_part(absent(spark.read.parquet(at), keys, key), root)
        kept += [rest] if rest[1] else []
    if new[1]:
        _list_parts(spark, root, n, [*kept, new])
    return new[1]


def compact_parts(spark: SparkSession, root: str, small_parts: int = SMALL_PARTS, small_rows: int = SMALL_ROWS) -> int:
    """Writes the small parts (fewer than small_rows rows) as one, if they are at least small_parts; returns how many that were."""
    n, parts = _live(spark, root)
    small = [p for p in parts if p[1] < small_rows]
    if len(small) < max(small_parts, 2):
        return 0
    merged = union_wide(*[spark.read.parquet(at) for at, _ in small]).hint("rebalance")
    _list_parts(spark, root, n, [*[p for p in parts if p not in small], _write_part(merged, root)])
    return len(small)


def append_snapshot(stored: DataFrame, batch: DataFrame, key: list[str], clock: str) -> DataFrame:
    """Stored rows and those of batch whose key and time are new. A batch without the time's column, or with a null time, is an error."""
    if clock not in batch.columns:
        raise ValueError(f"a snapshot lacks its time {clock}")
    dated = batch.withColumn(clock, F.when(F.col(clock).isNull(), F.raise_error(F.lit(f"a snapshot row lacks {clock}"))).otherwise(F.col(clock)))
    return union_wide(stored, absent(dated, stored, [*key, clock]))


def append_new(stored: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows and those of batch whose key is not stored."""
    return union_wide(stored, absent(batch, stored, key))


def register_artifacts(stored: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows and batch, in which no key may be stored already."""
    if row := present(batch, stored, key).limit(1).collect():
        raise ValueError(f"stored already: {row[0].asDict()}")
    return union_wide(stored, batch)


def by_position(*parts: DataFrame) -> DataFrame:
    """All rows of the parts, columns by position; types are widened, names are those of the first."""
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def union_exact(*parts: DataFrame) -> DataFrame:
    """All rows of the parts, which must have the same columns of the same types in the same order."""
    for part in parts[1:]:
        if part.dtypes != parts[0].dtypes:
            raise ValueError(f"columns differ: {sorted(set(part.dtypes) ^ set(parts[0].dtypes)) or 'their order'}")
    return by_position(*parts)


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return df.limit(0)


def disjoint(*parts: DataFrame) -> None:
    """Raises if a row of keys is in two of the parts."""
    for i, a in enumerate(parts):
        for b in parts[i + 1 :]:
            if row := a.intersect(b).limit(1).collect():
                raise ValueError(f"in two parts: {row[0].asDict()}")


def listing(spark: SparkSession) -> list[str]:
    """Names of the registered tables and views, in order."""
    return sorted(t.name for t in spark.catalog.listTables())


def with_versions(rows: DataFrame, key: list[str], seen: str, content: list[str]) -> DataFrame:
    """Rows from before there were versions, with first_seen_at, content_sha256 and version_id, a digest of key and content."""
    digest = content_hash(content)
    return rows.withColumns({"first_seen_at": F.col(seen), "content_sha256": digest, "version_id": F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key], digest), 256)})


def translated(legacy: DataFrame, stored: DataFrame, key: list[str], columns: dict[str, Column]) -> DataFrame:
    """Legacy rows in the columns of the store that it does not hold yet; doing it twice adds nothing."""
    return absent(legacy.select(*[c.alias(n) for n, c in columns.items()]), stored, key)


#: What the run of a resource may come to. What a run found is told by its status, never by its row count.
RUN_STATES = ("SUCCESS", "EMPTY_RESPONSE", "PARTIAL_RESPONSE", "RATE_LIMITED", "PROVIDER_ERROR", "UNSUPPORTED", "MARKET_NOT_POSTED")


def record_runs(stored: DataFrame, batch: DataFrame, key: str = "resource_run_id", status: str = "collection_status") -> DataFrame:
    """stored with the runs of batch that it lacks. A run that is stored with another content, repeats in batch, or has no known status is an error."""
    columns = [c for c in stored.columns if c != key]
    known = F.col(status).isin(*RUN_STATES)
    checked = batch.withColumn(status, F.when(known, F.col(status)).otherwise(F.raise_error(F.concat(F.lit("unknown status of a run: "), F.coalesce(F.col(status), F.lit("null"))))))
    both = stored.select(key, content_hash(columns).alias("_h")).unionByName(batch.select(key, content_hash(columns).alias("_h")))
    twice = both.groupBy(key).agg(F.min("_h").alias("_a"), F.max("_h").alias("_b")).where("_a <> _b")
    if not twice.isEmpty():
        raise ValueError("runs that are recorded with other content")
    return stored.unionByName(absent(checked, stored, [key]).dropDuplicates([key]))
