"""Vector codes: every part of a vector is replaced by the index of its codebook's nearest entry.

Entries are filtered by lower bounds from coarse to fine: a part and an entry are cut into equal blocks, and their
squared distance is at least the sum over blocks of (size times squared difference of means plus squared difference of
the norms of what the means leave). One block comes first, then two, four and so on while blocks have two components
or more; an entry whose bound is above an exact distance already known cannot be nearest. What survives receives
exact integer distances. Codebooks go through Lloyd rounds: tasks send sums and counts of each entry's parts, nothing
else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import stage
from tidemark.llm.vectors import finite, whole

#: Rows of a vectorised step (memory: rows * parts * entries numbers), and the part of its terms that a bound may be off by.
STEP, SLACK = 256, 1e-9


class Codebook:
    """Entries of one part position: integers (n, size), and sums and residual norms of their blocks at each level."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [_blocks(entries, n) for n in levels(entries.shape[1])]


def levels(size: int) -> list[int]:
    """Numbers of blocks, coarse to fine: powers of two that divide a part and leave blocks of two components or more."""
    return [n for n in (2**i for i in range(size.bit_length())) if size % n == 0 and size // n >= 2]


def _blocks(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each of n blocks of the rows of x, and the norms of what their means leave."""
    cut = x.reshape(len(x), n, -1)
    sums, squares, m = cut.sum(2), (cut * cut).sum(2), cut.shape[2]
    return sums.astype(np.float64), np.sqrt(np.maximum(squares - sums.astype(np.float64) ** 2 / m, 0))


def nearest(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of integers x: index of the nearest entry (ties: the lower one) and squared distance; and the exact distances computed."""
    entries = book.entries
    square = (x * x).sum(1)
    known = np.full(len(x), np.iinfo(np.int64).max)  # least exact distance so far
    row, at = np.divmod(np.arange(len(x) * len(entries)), len(entries))
    for n, (sums, norms) in zip(levels(x.shape[1]), book.levels, strict=True):
        s, r = _blocks(x, n)
        m = x.shape[1] // n
        bound = ((s[row] - sums[at]) ** 2 / m + (r[row] - norms[at]) ** 2).sum(1)
        bound -= SLACK * (square[row] + (entries[at] ** 2).sum(1) + 1)
        begin = np.searchsorted(row, np.arange(len(x)))
        first = np.flatnonzero(bound == np.minimum.reduceat(bound, begin)[row])
        known = np.minimum(known, ((x - entries[at[first[np.searchsorted(row[first], np.arange(len(x)))]]]) ** 2).sum(1))
        left = bound <= known[row]
        row, at = row[left], at[left]
    exact = ((x[row] - entries[at]) ** 2).sum(1)
    begin = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(exact, begin)
    hit = np.flatnonzero(exact == least[row])  # in order of row, then index
    return at[hit[np.searchsorted(row[hit], np.arange(len(x)))]], least, len(row)


def _assigned(vec: pd.Series, books: list[Codebook], size: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their parts (rows, parts, components), indexes and squared distances (rows, parts), some rows at a time."""
    for i in range(0, len(vec), STEP):
        if any(len(v) != size for v in vec.iloc[i : i + STEP]):
            raise ValueError(f"vectors differ in length: the first has {size} components")
        x = np.array(vec.iloc[i : i + STEP].tolist(), np.int64).reshape(-1, len(books), size // len(books))
        found = [nearest(x[:, p], book) for p, book in enumerate(books)]
        yield slice(i, i + STEP), x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _trained(rows: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Codebooks after one round: the mean of each entry's parts, rounded down; entries without parts stay."""
    made = [Codebook(b) for b in books]
    parts, width = len(books), size // len(books)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros((len(b), width), np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for frame in frames:
            for _, x, index, _ in _assigned(frame["vec"], made, size):
                for p in range(parts):
                    np.add.at(total[p], index[:, p], x[:, p])
                    count[p] += np.bincount(index[:, p], minlength=len(count[p]))
        for p in range(parts):
            for e in np.flatnonzero(count[p]).tolist():
                yield pd.DataFrame({"part": p, "entry": e, "place": np.arange(width), "total": total[p][e], "parts": count[p][e]})

    out = [b.copy() for b in books]
    exact = "decimal(38,0)"
    added = rows.mapInPandas(sums, "part int, entry int, place int, total long, parts long").groupBy("part", "entry", "place")
    # components of all codebooks: entries times the length of a vector
    for r in added.agg(F.sum(F.col("total").cast(exact)).alias("total"), F.sum(F.col("parts").cast(exact)).alias("parts")).collect():
        out[r.part][r.entry, r.place] = int(r.total) // int(r.parts)
    return out


def vector_codes(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, list[np.ndarray]]:
    """The codes of all vectors, and the codebooks of the part positions.

    Components become floor(scale * x); vectors are cut into `parts` equal parts. A codebook starts as that part of the
    `entries` smallest vec_ids (all rows, if fewer), goes through `rounds` rounds, and then gives each part the index of
    its nearest entry by squared distance, ties to the lower index. Columns: vec_id, label (null if the table has no
    such column), code (an array of indexes), error (squared distances, summed).

    Rows whose vector is null or holds null or non-finite components are left out. Repeated rows each count; a null
    vec_id comes after all others, rows of one vec_id come by their vectors. Other columns are not looked at. Of an empty
    table there are no codes and no codebooks. Vectors of different lengths, or of one that `parts` does not divide, are an
    error, as are vectors longer than 2 ** 27.5 after rounding.
    """
    raw = embeddings["embedding"].cast("array<double>")
    label = embeddings["label"].cast("long") if "label" in embeddings.columns else F.lit(None).cast("long")
    given = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), label.alias("label"), raw.alias("raw")).where(finite(F.col("raw")))
    rows = given.select("vec_id", "label", whole(F.col("raw"), scale).alias("vec"))
    start = [r.vec for r in rows.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()]
    size = len(start[0]) if start else 0
    if any(len(v) != size for v in start) or size % parts:
        raise ValueError(f"vectors differ in length, or {parts} parts do not divide it: {sorted({len(v) for v in start})}")
    books = [b.copy() for b in np.array(start, np.int64).reshape(len(start), parts, size // parts).transpose(1, 0, 2)] if start else []
    for _ in range(rounds if start else 0):
        books = _trained(rows, books, size)
    made = [Codebook(b) for b in books]

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, _, index, far in _assigned(frame["vec"], made, size):
                yield frame.iloc[at][["vec_id", "label"]].assign(code=list(index), error=far.sum(1))

    return rows.mapInPandas(code, "vec_id long, label long, code array<int>, error long"), books


def hex_code(frame: DataFrame) -> DataFrame:
    """code as text: two lowercase hex digits for each index (below 256), in the order of the parts."""
    digits = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return frame.withColumn("code", F.array_join(digits, ""))


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Lowercase hex of the decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error: error added up over the rows of the same label, nulls together."""
    codes = stage(codes, "codes")
    of = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(of, F.col("label").eqNullSafe(F.col("of"))).drop("of")
