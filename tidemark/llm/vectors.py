"""Integer vectors of the exact searches: rounding, blocks of rows, scores, and the best rows of each window of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import column

#: Squared length from which an integer vector is refused: 90 times a score then still fits in 64 bits.
LONGEST = 2.0**55
#: Below this product of two lengths, sums of products are exact in double precision.
EXACT = 2.0**53
#: Score of what takes no part, and rows of best ones that a task holds before it hands them on.
NONE, HELD = -(2**62), 500_000


def finite(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long. A vector too long for exact sums in 64 bits is an error."""
    floors = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x))
    square = F.aggregate(floors, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return F.when(square < LONGEST, floors).otherwise(F.raise_error(F.lit("a vector is too long for exact integer scores")))


def integers(embeddings: DataFrame, scale: int = 256, *more: str) -> DataFrame:
    """vec_id, vec (array<long>) and the columns `more` of the rows that take part, one row for each vec_id.

    Rows with a null vec_id, a null vector or a component that is null or not finite are left out, as are those with a
    null in `more`. Of rows that share a vec_id the one with the least vector stays.
    """
    raw = embeddings["embedding"].cast("array<double>")
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), raw.alias("raw"), *[embeddings[c].cast("long").alias(c) for c in more])
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("raw"))).dropna(subset=list(more) or None)
    rows = rows.select("vec_id", F.struct(whole(F.col("raw"), scale).alias("vec"), *more).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Array column whose rows end at `ends` of values."""
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), pa.array(values))


def pack(rows: DataFrame, most: int, keys: tuple[str, ...] = (), columns: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Rows in blocks of at most `most`: keys, size (components of each vector), flat (all components), and each of `columns` as an array.

    Neighbouring rows with equal keys and vectors of one size form a block; nothing is shuffled.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "size int", "flat array<bigint>", *(f"{c} array<{kinds[c]}>" for c in columns)])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = column(batch, "vec")
            flat, size = vec.flatten().to_numpy(zero_copy_only=False), np.asarray(vec.value_lengths()).astype(np.int32)
            change = np.diff(size, prepend=-1) != 0
            for k in keys:
                change |= np.diff(column(batch, k).to_numpy(zero_copy_only=False), prepend=-1) != 0
            first = np.flatnonzero(change)
            within = np.arange(len(size)) - np.repeat(first, np.diff(np.append(first, len(size))))
            first = np.flatnonzero(within % most == 0)
            last = np.append(first[1:], len(size))
            ends = np.cumsum(size, dtype=np.int64)
            arrays = [column(batch, k).take(pa.array(first)) for k in keys] + [pa.array(size[first]), lists(flat, ends[last - 1])]
            arrays += [lists(column(batch, c).to_numpy(zero_copy_only=False), last) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "size", "flat", *columns])

    def as_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in packed(batches):
            yield pa.RecordBatch.from_arrays([a.cast(pa.list_(a.type.value_type)) if pa.types.is_large_list(a.type) else a for a in out.columns], names=out.schema.names)

    return rows.mapInArrow(as_lists, schema)


def matrix(flat: np.ndarray, size: int, rows: int) -> np.ndarray:
    return np.asarray(flat, np.int64).reshape(rows, size)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b; of vectors of two sizes the shorter one counts as followed by zeros."""
    m = min(a.shape[1], b.shape[1])
    a, b = a[:, :m], b[:, :m]
    x, y = a.astype(np.float64), b.astype(np.float64)
    if not x.size or not y.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.sqrt((x * x).sum(1).max()) * np.sqrt((y * y).sum(1).max()) < EXACT:
        return (x @ y.T).astype(np.int64)
    return a @ b.T


def kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest value of each row; NONE where there are fewer columns."""
    if score.shape[1] < k:
        return np.full(len(score), NONE)
    return -np.partition(-score, k - 1, axis=1)[:, k - 1]


def first(window: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of each window with its `most` highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -score, window))
    window, score, ids = window[order], score[order], ids[order]
    begin = np.flatnonzero(np.diff(window, prepend=window[0] - 1)) if len(window) else np.zeros(0, np.int64)
    at = np.arange(len(window)) - np.repeat(begin, np.diff(np.append(begin, len(window))))
    return window[at < most], score[at < most], ids[at < most]


class Best:
    """The best rows met so far of each window, which is named by an id and a slot below `slots`."""

    def __init__(self, most: int, slots: int = 1):
        self.most, self.slots = most, slots
        self._clear()

    def _clear(self) -> None:
        self.names: dict[int, int] = {}
        self.parts, self.held, self.limit = [], 0, HELD

    def add(self, names: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> bool:
        """score of each window (row) for each of ids; NONE: takes no part. Returns whether it is time to hand on what is held."""
        row, at = np.nonzero((score > NONE) & (score >= kth(score, self.most)[:, None]))
        row, value, ids = first(row, score[row, at], ids[at], self.most)
        key = np.array([self.names.setdefault(n, len(self.names)) for n in names.tolist()], np.int64) * self.slots + slot
        self.parts.append((key[row], value, ids))
        self.held += len(row)
        if self.held > self.limit:
            self._merge()
            self.limit = max(HELD, 2 * self.held)
        return self.held > HELD

    def _merge(self) -> None:
        self.parts = [first(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.most)] if self.parts else []
        self.held = sum(len(x[0]) for x in self.parts)

    def rows(self) -> dict[str, np.ndarray]:
        """name, slot, vec_id and score of the best; nothing is held after that."""
        self._merge()
        window, score, ids = self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 3
        names = np.array(list(self.names), np.int64)
        out = {"name": names[window // self.slots] if len(window) else window, "slot": window % self.slots, "vec_id": ids, "score": score}
        self._clear()
        return out
