"""What can repeat at all: a filter that windows of a fixed size pass if they may start in two places.

The units of a text are its words or its bytes. Each window of `window` units holds one anchor at least: the place
of its least k-gram hash. Equal windows have equal anchors, so a window whose anchor has a k-gram that no other
anchor has is not repeated. Only anchors (about two in window - k + 2 units) are shuffled to find those that occur
again; each text gets back the places of its own. The filter loses nothing and needs no bound on any group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import SLICE_BYTES, Words, anchors, column, grams, packed, rolling, signed, slices, spans, stage, window_min


@dataclass
class Units:
    """Units of a run of texts: hash of the k-gram at each unit, units and first unit of each text, and the texts' bytes."""

    gram: np.ndarray
    count: np.ndarray
    first: np.ndarray
    buf: np.ndarray
    offsets: np.ndarray
    words: Words | None = None

    def windows(self, window: int) -> np.ndarray:
        """Units at which a window of its text starts."""
        return _runs(self.first, np.maximum(self.count - window + 1, 0))

    def row(self, unit: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first + self.count, unit, "right")


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... (size of them) of each run, joined."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)


def by_words(k: int):
    def make(buf: np.ndarray, offsets: np.ndarray) -> Units:
        words = Words(buf, offsets)
        return Units(grams(words.hash, k), words.count, words.first, buf, offsets, words)

    return make


def by_bytes(k: int):
    def make(buf: np.ndarray, offsets: np.ndarray) -> Units:
        n = max(len(buf) - k + 1, 0)
        at = np.arange(n)
        return Units(spans(rolling(buf), at, at + k), np.diff(offsets), offsets[:-1], buf, offsets)

    return make


def find_anchors(units: Units, window: int, k: int) -> np.ndarray:
    """Anchors of all windows, as units."""
    w = window - k + 1
    valid = np.zeros(max(len(units.gram) - w + 1, 0), bool)
    valid[units.windows(window)] = True
    return anchors(units.gram, w, valid)


def units_of(batch: pa.RecordBatch, make: Callable, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Units]]:
    """Units of the batch's texts, in runs of rows [i, j)."""
    buf, offsets = packed(column(batch, "text"))
    for i, j in slices(offsets, most):
        yield i, j, make(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _emit(make: Callable, window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = column(batch, "uid").to_numpy()
            for i, _, units in units_of(batch, make):
                at = find_anchors(units, window, k)
                row = units.row(at)
                yield pa.RecordBatch.from_arrays([pa.array(signed(units.gram[at])), pa.array(uid[i + row]), pa.array((at - units.first[row]).astype(np.int32))], ["h", "uid", "at"])

    return run


def shared_anchors(docs: DataFrame, make: Callable, window: int, k: int) -> DataFrame:
    """uid and the places `at` of those anchors of docs (uid, text) whose k-gram is that of another anchor too."""
    found = stage(docs.select("uid", "text").mapInArrow(_emit(make, window, k), "h long, uid long, at int"), "anchors")
    again = stage(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    return stage(found.join(again, "h").groupBy("uid").agg(F.collect_list("at").alias("at")), "shared")


def candidates(units: Units, shared: list[np.ndarray], window: int, k: int) -> np.ndarray:
    """Units at which a window starts whose anchor is shared; shared: places in each text, as shared_anchors has them.

    Only the anchor of the window itself counts: others within it may be anchors here for the sake of windows that
    its twins don't have beside them.
    """
    w = window - k + 1
    if len(units.gram) < w:
        return np.zeros(0, np.int64)
    only = np.full(len(units.gram), np.iinfo(np.uint64).max)
    for first, at in zip(units.first, shared, strict=True):
        only[first + at] = units.gram[first + at]
    start = units.windows(window)
    return start[window_min(only, w)[start] == window_min(units.gram, w)[start]]


def array_of(values: pa.Array) -> list[np.ndarray]:
    """Each list of a list column; a null is empty."""
    return [np.zeros(0, np.int64) if x is None else np.array(x, np.int64) for x in values.to_pylist()]


def cover(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n units lie in a window that starts at one of starts."""
    step = np.zeros(n + 1, np.int64)
    starts = np.unique(starts)
    step[starts] += 1
    step[starts + window] -= 1
    return np.cumsum(step)[:n] > 0
