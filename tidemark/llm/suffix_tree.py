"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix is cut off after `window` words, as no deeper node matters, and read as four symbols of eight or nine words,
each named by 32 bits of a hash: that is the path of its leaf. Suffixes that `anchored` rules out are never made.
The others are dealt out by a prefix of their path: its first symbol, and where more than `most` suffixes begin
with that, as many more as it takes (`dealt`). So each subtree has `most` leaves at most and is built in memory; a
prefix as long as the path is one node, whose leaves stream. In a subtree the leaves come in the order of their paths,
what neighbours have in common gives the internal nodes, and the leaves below a node at full depth are the places of a
repeated window. Nodes above that depth only serve to deal suffixes out.
A path that a task meets twice is repeated whatever the others hold: it stays there, and one witness of it goes out,
so a passage in very many texts costs a row for each task. The windows a text gets back are merged into maximal
repeats, which are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.anchored import array_of, by_words, candidates, cover, shared_anchors, units_of
from tidemark.llm.common import column, cut, documents, grams, signed, stage

WINDOW, GRAM = 35, 10
SYMBOLS = 4
#: Leaves of a subtree at most; more of them get a longer prefix.
LEAVES = 1 << 13


def _paths(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The four symbols of each suffix, two in each of two 64-bit numbers, the first in the upper half."""
    bounds = [window * i // SYMBOLS for i in range(SYMBOLS + 1)]
    name = [grams(hashes, b - a)[starts + a] >> np.uint64(32) for a, b in zip(bounds, bounds[1:], strict=False)]
    return (name[0] << np.uint64(32)) | name[1], (name[2] << np.uint64(32)) | name[3]


def _suffixes(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, shared = column(batch, "uid").to_numpy(), array_of(column(batch, "at"))
            parts = []
            for i, j, units in units_of(batch, by_words(k)):
                start = candidates(units, shared[i:j], window, k)
                row = units.row(start)
                parts.append((*_paths(units.words.hash, start, window), i + row, start - units.first[row]))
            k1, k2, row, at = map(np.concatenate, zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
            if not len(row):
                continue
            order = np.lexsort((k2, k1))
            k1, k2, row, at = k1[order].astype(np.uint64), k2[order].astype(np.uint64), row[order], at[order]
            new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            again = ~new
            again[:-1] |= ~new[1:]
            uid = uids[row]
            # suffixes: those met once with their place, the others as one witness
            out = new | ~again
            lone = pa.array(again[out])
            yield pa.RecordBatch.from_arrays([pa.array(signed(k1[out])), pa.array(signed(k2[out])), pa.array(uid[out], mask=again[out]), pa.array(at[out].astype(np.int32), mask=again[out]), pa.nulls(len(lone), pa.list_(pa.int32()))], ["k1", "k2", "uid", "at", "known"])
            order = np.lexsort((at[again], row[again]))
            row, at = row[again][order], at[again][order].astype(np.int32)
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                known = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int64()), pa.array(uids[row[first]]), pa.nulls(len(first), pa.int32()), known], ["k1", "k2", "uid", "at", "known"])

    return run


def common_symbols(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """How many leading symbols each suffix shares with the one before; the first shares none."""
    out = np.zeros(len(k1), np.int64)
    if len(k1) > 1:
        half = np.uint64(32)
        a, b = k1[1:] ^ k1[:-1], k2[1:] ^ k2[:-1]
        out[1:] = np.where(a, np.where(a >> half, 0, 1), np.where(b, np.where(b >> half, 2, 3), SYMBOLS))
    return out


def dealt(suffixes: DataFrame, most: int = LEAVES) -> DataFrame:
    """suffixes (k1, k2 and more) with the symbols `length` in the prefix of each: the fewest that no more than `most` suffixes begin with, or all.

    Suffixes are counted by one symbol first and by one more only under prefixes that have too many; those number
    at most the suffixes over `most`, and Spark chooses how to join them by the size of their table.
    """
    heads = [["s1"], ["k1"], ["k1", "s3"]]
    rows = suffixes.withColumns({"s1": F.shiftrightunsigned("k1", 32), "s3": F.shiftrightunsigned("k2", 32), "length": F.lit(1)})
    for length, head in enumerate(heads, 1):
        counts = rows.where(F.col("length") == length).groupBy(*head).agg(F.count("*").alias("n"))
        heavy = stage(counts.where(F.col("n") > most).select(*head, F.lit(1).alias("longer")), "prefixes")
        if heavy.isEmpty():
            break
        rows = rows.join(heavy, head, "left").withColumn("length", F.col("length") + F.coalesce("longer", F.lit(0))).drop("longer")
    return rows


def _prefix() -> Column:
    """A hash of the first `length` symbols, of columns that are shuffled anyway."""
    upper = [F.shiftrightunsigned(k, 32) for k in ("k1", "k2")]
    heads = [F.xxhash64(upper[0]), F.xxhash64("k1"), F.xxhash64("k1", upper[1])]
    return F.when(F.col("length") == 1, heads[0]).when(F.col("length") == 2, heads[1]).when(F.col("length") == 3, heads[2]).otherwise(F.xxhash64("k1", "k2"))


def deep_nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end leaf of each internal node at full depth; common: as of common_symbols."""
    first = np.flatnonzero(common < SYMBOLS)
    end = np.append(first[1:], len(common))
    inner = end - first > 1
    return first[inner], end[inner]


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid and at of the leaves under nodes at full depth, of suffixes in the order of their paths, one subtree after another.

    The last subtree of a batch is held until it is complete; of one whose prefix is the whole path, only the last leaf.
    """

    def paths(batch: pa.RecordBatch) -> np.ndarray:
        return common_symbols(*(column(batch, c).to_numpy().view(np.uint64) for c in ("k1", "k2")))

    def leaves(batch: pa.RecordBatch, common: np.ndarray) -> pa.RecordBatch:
        first, end = deep_nodes(common)
        step = np.zeros(len(common) + 1, np.int64)
        step[first] += 1
        step[end] -= 1
        deep = np.cumsum(step)[:-1] > 0
        return batch.filter(pa.array(deep & column(batch, "uid").is_valid().to_numpy(False))).select(["uid", "at"])

    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        common, length = paths(batch), column(batch, "length").to_numpy()
        last = int(np.flatnonzero(common < length)[-1])  # leaves of two subtrees have fewer symbols in common than a prefix
        if length[-1] == SYMBOLS:
            # one node: all its leaves so far are reported, the held one maybe again
            yield leaves(batch, common)
            held = batch.slice(batch.num_rows - 1)
        else:
            yield leaves(batch.slice(0, last), common[:last])
            held = batch.slice(last)
    if held is not None:
        yield leaves(held, paths(held))


def repeated_windows(docs: DataFrame, window: int = WINDOW, k: int = GRAM, most: int = LEAVES) -> DataFrame:
    """uid and the starts `at` (lists of lists) of the repeated windows of docs (uid, text)."""
    shared = shared_anchors(docs, by_words(k), window, k)
    rows = docs.select("uid", "text").join(shared, "uid")
    suffixes = stage(rows.mapInArrow(_suffixes(window, k), "k1 long, k2 long, uid long, at int, known array<int>"), "suffixes")
    paths = dealt(suffixes.where("k1 IS NOT NULL").select("k1", "k2", "uid", "at"), most)
    subtrees = paths.select("length", "k1", "k2", "uid", "at").repartition(_prefix()).sortWithinPartitions("k1", "k2")
    deep = subtrees.mapInArrow(_subtrees, "uid long, at int").groupBy("uid").agg(F.collect_list("at").alias("known"))
    known = suffixes.where("k1 IS NULL").select("uid", "known")
    return stage(deep.unionByName(known).groupBy("uid").agg(F.flatten(F.collect_list("known")).alias("at")), "windows")


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            n, gone, texts = [], [], []
            for text, at in zip(column(batch, "text").to_pylist(), column(batch, "at").to_pylist(), strict=True):
                words = text.encode().split()  # bytes split at 0x20 and 0x09 to 0x0D and nowhere else
                n.append(len(words))
                if at:
                    covered = cover(np.array(at, np.int64), window, len(words))
                    words = list(compress(words, ~covered))
                gone.append(n[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return run


def suffix_tree_dedup(docs: DataFrame, window: int = WINDOW, k: int = GRAM, most: int = LEAVES) -> DataFrame:
    """doc_id, n_words, n_removed and text (kept words joined by one space) of every row of docs (doc_id, text).

    A word is removed if a window of `window` consecutive words of its document covers it whose words also start
    anywhere else, in the same document too. Windows are judged on the input. A null text has no words; null and
    repeated ids are documents like others, and rows repeated whole repeat each other. Other columns are ignored.
    Texts are read whole, however long; an empty table gives an empty result. most: leaves of a subtree held in memory.
    """
    docs = documents(docs)
    found = repeated_windows(docs, window, k, most)
    return docs.join(found, "uid", "left").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, text string")
