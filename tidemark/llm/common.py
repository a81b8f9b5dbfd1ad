"""Helpers shared by the corpus operators: staging, and vectorised hashing of packed texts.

Texts reach Python as Arrow string columns; `packed` views their bytes without making a Python string for
each row. All hashes are 64 bits wide.
"""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that one vectorised step works on at a time; bounds the memory of a Python worker.
SLICE_BYTES = 500_000

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


_LOCK, _WRITERS = threading.Lock(), {"now": 0, "before": "false"}
_LEFT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Has Spark remove a query's shuffle files when it ends; the setting goes back when the last of the writers within is done."""
    with _LOCK:
        if not _WRITERS["now"]:
            _WRITERS["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _WRITERS["now"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS["now"] -= 1
            if not _WRITERS["now"]:
                spark.conf.set(CLEANUP, _WRITERS["before"])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to a new Parquet table in the shared folder and reads it back.

    As nothing reads the shuffles of df after that, Spark is asked to remove their files. The table stays until
    `release` is given it, or until Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    if not _LEFT:
        atexit.register(_remove, spark)
    _LEFT.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path  # type: ignore[attr-defined]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _LEFT.discard(path)


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that `stage` wrote; nothing that is still to be computed may read them. Other DataFrames and None are passed over."""
    for df in tables:
        if df is not None and getattr(df, "staged_at", None) in _LEFT:
            _delete(df.sparkSession, df.staged_at)


def _remove(spark: SparkSession) -> None:
    """Deletes what is left when Python ends, as far as the session still runs."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        for path in list(_LEFT):
            _delete(spark, path)


def one_of_each(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """One row of texts (doc_id, text) for each row of marked (doc_id and more, ids distinct and few), the one of least text hash.

    However often an id is repeated, each task passes on one row of it.
    """
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    return texts.join(F.broadcast(marked), "doc_id").groupBy(*marked.columns).agg(least).select(*marked.columns, "least.text")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows [i, j) of about `most` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def cut(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows that hold about `most` bytes of the named column, which bounds what one step makes of them."""
    for batch in batches:
        values = column(batch, name)
        if len(values):
            offsets = np.frombuffer(values.buffers()[1], np.int64 if values.type in (pa.large_string(), pa.large_binary()) else np.int32)[values.offset : values.offset + len(values) + 1]
            for i, j in slices(offsets.astype(np.int64), most):
                yield batch.slice(i, j - i)
    pa.default_memory_pool().release_unused()  # the worker stays for other stages


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise over uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf).astype(np.uint8)


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of packed texts: start, end (bytes in buf), row, and a 64-bit hash of each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = offsets[1:-1][offsets[1:-1] < len(buf)]
        first[inner] |= solid[inner]  # a row's end parts words too
        self.start = np.flatnonzero(first)
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        last[inner[inner > 0] - 1] |= solid[inner[inner > 0] - 1]
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        size = self.end - self.start
        if len(size):
            begin = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(begin, size)
            value = _BYTE[buf[solid]] * powers(int(size.max()))[within]
            self.hash = mix(np.add.reduceat(value, begin) + size.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        #: words of each row, and the index of its first
        self.count = np.bincount(self.row, minlength=len(offsets) - 1)
        self.first = np.cumsum(self.count) - self.count


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every k consecutive values (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, p in enumerate(powers(k + 1)[1:]):
        out += hashes[j : j + n] * p
    return mix(out)


def rolling(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers from which `spans` hashes any stretch of bytes."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(n), out=sums[1:])
    inverse = pow(int(_BASE), -1, 2**64)
    return sums, powers(n + 1, np.uint64(inverse))


def spans(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of bytes [start, end) of what `rolling` read."""
    sums, inverse = prefix
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w consecutive ones (len - w + 1 of them)."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(h: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
    """Positions whose value is least in some valid window of w: a choice made by the content of the window alone.

    valid: for each window of w consecutive values, whether it counts (windows that cross from one text into the next
    don't). Ties are all taken, so equal windows have equal anchors and each valid window has one at least.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = np.where(valid, window_min(h, w), np.uint64(0))
    pad = np.zeros(w - 1, h.dtype)
    most = ~window_min(~np.concatenate([pad, least, pad]), w)
    return np.flatnonzero((most == h) & (h > 0))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def uid(docs: DataFrame) -> Column:
    """A hash of a row's doc_id and text, so that rows that repeat an id with another text are told apart."""
    return F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")))


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and uid of every row."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), uid(docs).alias("uid"))
