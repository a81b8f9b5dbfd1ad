"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves and each half is quantised apart; a cell is a pair of centroids. A query goes
through the pairs that hold entries by the sum of its two distances, with a heap, until they hold enough; those
entries are reranked by their exact cosine. Equal vectors are one entry, which carries its k + 1 smallest ids: no query can
need more of them. Entries of neighbouring cells form blocks of bounded size; a block meets queries in groups, and
only those of which some chose a cell in it. Within it a query looks at the cells it chose.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import stage

#: Vectors that the codebooks are fitted on at most (those of least hash), rounds of k-means, and most centroids of a half.
FIT_ROWS, ROUNDS, CENTROIDS = 20_000, 10, 1024
#: Share of all entries that a query looks at, whatever their number.
SHARE = 0.55
#: Centroids of a half that the walk takes at once.
RUN = 16
#: Bits of a hash by which entries are counted before the codebooks' vectors are taken.
BITS = 12
#: Entries of a block, queries that meet it at once, and queries whose nearest a task holds before it hands them on.
BLOCK, TOGETHER, HELD = 1024, 128, 50_000


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and holds neither nulls nor numbers that aren't finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _distance(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codebook(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's k-means from k of the rows, spread evenly over them; distances are held for 1,000 rows at a time."""
    centroids = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = np.concatenate([_distance(x[i : i + 1000], centroids).argmin(1) for i in range(0, len(x), 1000)])
        order = np.argsort(at, kind="stable")
        names, first = np.unique(at[order], return_index=True)
        centroids[names] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return centroids


class Cells:
    """The cells that hold entries: id (left centroid times n plus right centroid) in order, size, first block and number of blocks."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, n: int, block: int = 1):
        order = np.argsort(ids)
        self.id, self.size, self.n = ids[order].astype(np.int64), sizes[order].astype(np.int64), n
        self.block, self.split = np.zeros(len(ids), np.int32), (-(-self.size // block)).astype(np.int32)
        at = full = 0
        for i, count in enumerate(self.size.tolist()):
            if full and full + count > block:
                at, full = at + 1, 0
            self.block[i] = at
            full += count
            if count > block:
                at, full = at + int(self.split[i]), 0
        #: place of each cell by its two centroids; -1: it holds nothing
        self.at = np.full((int(self.id[-1]) // n + 1 if len(ids) else 0, n), -1, np.int32)
        self.at.ravel()[self.id] = np.arange(len(ids))


def cells_in_order(left: np.ndarray, right: np.ndarray, cells: Cells, enough: int) -> np.ndarray:
    """Cells (by their place) in the order of the sum of their halves' distances, until they hold enough entries.

    Centroids of each half go in runs of neighbours by distance. The heap has, of each run of left centroids that is near
    enough, the nearest run of right ones not yet taken with it; what two runs hold together is taken at once and sorted in the end.
    """
    lefts, rights = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    lefts = lefts[lefts < len(cells.at)]
    least = lambda a, b: (float(left[lefts[a]] + right[rights[b]]), a, b)
    heap, taken, have, far = [least(0, 0)] if len(lefts) and enough > 0 else [], [np.zeros(0, np.int32)], 0, np.inf

    def nearest() -> tuple[np.ndarray, np.ndarray]:
        places = np.concatenate(taken)
        sums = left[cells.id[places] // cells.n] + right[cells.id[places] % cells.n]
        order = np.lexsort((places, sums))
        order = order[: int(np.searchsorted(np.cumsum(cells.size[places[order]]), enough)) + 1]
        return places[order], sums[order]

    while heap and heap[0][0] <= far:
        _, a, b = heapq.heappop(heap)
        if not b and a + RUN < len(lefts):
            heapq.heappush(heap, least(a + RUN, 0))
        if b + RUN < len(rights):
            heapq.heappush(heap, least(a, b + RUN))
        places = cells.at[lefts[a : a + RUN, None], rights[b : b + RUN]]
        taken.append(places[places >= 0])
        have += int(cells.size[taken[-1]].sum())
        if have >= enough and far == np.inf:  # from here on only what may be nearer than these
            far = float(nearest()[1][-1])
    return nearest()[0]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


class _Best:
    """The nearest entries met so far, for each query."""

    def __init__(self, most: int):
        self.most, self.index, self.ids = most, {}, []
        self.score, self.first, self.entry = np.zeros((0, most)), np.zeros((0, most), np.int64), np.zeros((0, most), np.int64)

    def add(self, reps: np.ndarray, score: np.ndarray, ids: list) -> None:
        """score of each rep for each entry (-inf: not looked at); ids: those of each entry, smallest first."""
        at = np.array([self.index.setdefault(r, len(self.index)) for r in reps.tolist()], np.int64)
        if (more := len(self.index) - len(self.score)) > 0:
            more = max(more, len(self.score))
            self.score = np.concatenate([self.score, np.full((more, self.most), -np.inf)])
            self.first, self.entry = (np.concatenate([x, np.full((more, self.most), -1)]) for x in (self.first, self.entry))
        first = np.array([i[0] for i in ids], np.int64)
        entry = np.arange(len(ids)) + len(self.ids)
        self.ids += [tuple(i) for i in ids]
        s = np.concatenate([self.score[at], score], axis=1)
        f, e = (np.concatenate([own[at], np.broadcast_to(new, score.shape)], axis=1) for own, new in ((self.first, first), (self.entry, entry)))
        # all that may be among the best, ties included, come first
        behind = s < -np.partition(-s, self.most - 1, axis=1)[:, self.most - 1 : self.most]
        near = np.argsort(behind, axis=1, kind="stable")[:, : int((~behind).sum(1).max())]
        s, f, e = (np.take_along_axis(x, near, 1) for x in (s, f, e))
        order = np.lexsort((f, -s), axis=1)[:, : self.most]
        self.score[at], self.first[at], self.entry[at] = (np.take_along_axis(x, order, 1) for x in (s, f, e))

    def rows(self) -> pd.DataFrame:
        out = []
        for rep, i in self.index.items():
            out += [(rep, v, s) for s, v in sorted(((s, v) for s, e in zip(self.score[i].tolist(), self.entry[i].tolist(), strict=True) if s > -np.inf for v in self.ids[e]), key=lambda x: (-x[0], x[1]))[: self.most]]
        return pd.DataFrame(out, columns=["rep", "vec_id", "score"])


def _least(entries: DataFrame, most: int) -> np.ndarray:
    """The vectors of least hash, `most` at the most. Hashes are counted first, so that tasks hand on few more than are wanted, however many tasks there are."""
    key = F.xxhash64("vec")
    bins = F.shiftright(key, 64 - BITS).cast("int")
    counts = entries.groupBy(bins.alias("bin")).count().toArrow()
    names, sizes = counts["bin"].to_numpy(), counts["count"].to_numpy()
    order = np.argsort(names)
    last = min(int(np.searchsorted(np.cumsum(sizes[order]), most)), len(names) - 1)
    wanted = entries.where(bins <= int(names[order][last]))
    return _flat(wanted.orderBy(key, "vec").limit(most).select("vec").toArrow()["vec"])


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _search(vectors: DataFrame, size: int, every: int, k: int, share: float) -> DataFrame:
    vectors = stage(vectors.where(F.size("vec") == size).distinct(), "vectors")
    by_id = Window.partitionBy("vec").orderBy("vec_id")
    small = vectors.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    entries = stage(small.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    reps = stage(asked.groupBy("vec").agg(F.min("vec_id").alias("rep")), "reps")

    total = entries.count()
    sample = _unit(_least(entries, FIT_ROWS))
    half = size // 2
    n = int(np.clip(2 ** round(np.log2(max(np.sqrt(total) / 2, 1))), 32, CENTROIDS))
    books = codebook(sample[:, :half], n, ROUNDS), codebook(sample[:, half:], n, ROUNDS)

    def distances(vec: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        x = _unit(_matrix(vec))
        return _distance(x[:, :half], books[0]), _distance(x[:, half:], books[1])

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                left, right = distances(frame["vec"])
                yield frame.assign(cell=left.argmin(1) * len(books[1]) + right.argmin(1))

    placed = stage(entries.mapInPandas(assign, "vec array<double>, ids array<long>, cell int"), "cells")
    counted = placed.groupBy("cell").agg(F.count("*").alias("size")).toArrow()  # CENTROIDS squared rows at most, 12 bytes each
    cells = Cells(counted["cell"].to_numpy(), counted["size"].to_numpy(), len(books[1]), BLOCK)

    @F.pandas_udf("first int, split int")
    def block_of(cell: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(cells.id, cell)
        return pd.DataFrame({"first": cells.block[at], "split": cells.split[at]})

    # neighbouring cells fill a block; a cell of more than a block is split over several
    spread = placed.withColumn("b", block_of("cell")).withColumn("block", F.col("b.first") + F.pmod(F.xxhash64("vec"), F.col("b.split")).cast("int"))
    packed = spread.groupBy("block").agg(F.collect_list(F.struct("vec", "ids", "cell")).alias("rows"))
    packed = packed.select("block", F.flatten("rows.vec").alias("vecs"), F.col("rows.ids").alias("ids"), F.col("rows.cell").alias("cells"))
    enough = int(np.ceil(share * total))

    first = np.flatnonzero(np.diff(cells.block, prepend=-1)).tolist()  # the cells of a block are neighbours

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), TOGETHER):
                part = frame.iloc[i : i + TOGETHER]
                reps, flat = part["rep"].to_numpy(), _matrix(part["vec"])
                opened = np.zeros((len(part), len(cells.id)), bool)
                for row, (left, right) in zip(opened, zip(*distances(part["vec"]), strict=True), strict=True):
                    row[cells_in_order(left, right, cells, enough)] = True
                out = []
                for low, high in zip(first, first[1:] + [len(cells.id)], strict=True):
                    rows = np.flatnonzero(opened[:, low:high].any(1))
                    if len(rows):
                        # one bit for each query and cell; a cell of several blocks is chosen in each of them
                        bits = np.packbits(opened[rows, low:high]).tobytes()
                        out += [(int(cells.block[low]) + b, reps[rows], flat[rows].ravel(), bits) for b in range(int(cells.split[low]))]
                    if len(out) >= TOGETHER or high == len(cells.id):
                        yield pd.DataFrame(out, columns=["block", "reps", "queries", "open"])
                        out = []

    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that few bytes of queries still make many tasks
    near_first = reps.mapInPandas(assign, "vec array<double>, rep long, cell int").repartitionByRange(tasks, "cell").sortWithinPartitions("cell")
    routed = near_first.mapInPandas(route, "block int, reps array<long>, queries array<double>, open binary")

    def rerank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(k + 1)
        for frame in frames:
            for reps, flat, bits, vecs, ids, held in zip(*(frame[c] for c in ("reps", "queries", "open", "vecs", "ids", "cells")), strict=True):
                q, x = np.asarray(flat).reshape(-1, size), np.asarray(vecs).reshape(-1, size)
                score = q @ x.T / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1)))
                names, at = np.unique(held, return_inverse=True)
                open_ = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(q) * len(names)).reshape(len(q), -1).astype(bool)
                best.add(np.asarray(reps), np.where(open_[:, at], score, -np.inf), ids)
                if len(best.index) > HELD or len(best.ids) > 20 * HELD:
                    yield best.rows()
                    best = _Best(k + 1)
        yield best.rows()

    # neither side is small, whatever Spark makes of the size of arrays: a broadcast would take all of routed to the driver
    found = routed.join(packed.hint("merge"), "block").mapInPandas(rerank, "rep long, vec_id long, score double")
    near = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    best = stage(found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).drop("r"), "nearest")
    # back to every query: those with equal vectors share what was found, each without its own row
    asked = stage(asked.join(reps, "vec").select(F.col("vec_id").alias("query_id"), "rep"), "asked")
    each = asked.join(best, "rep").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def multi_index(embeddings: DataFrame, every: int = 50, k: int = 5, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: of each row whose vec_id is divisible by `every`, the k nearest found.

    Nearness is the largest cosine, in double precision on the vectors as given; ties go to the smaller vec_id. Each
    query looks at the share of all distinct vectors whose cells are nearest; with a share of 1 it finds all. Rows that are
    not `usable`, or whose vec_id is null, take no part; nor do rows of the query's own id. Rows repeated whole
    count once. Vectors of different lengths are searched apart. An empty table gives an empty result.
    """
    vectors = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("vec"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    lengths = sorted(r[0] for r in vectors.select(F.size("vec")).distinct().collect())
    parts = [_search(vectors, n, every, k, share) for n in lengths]
    out = parts[0] if parts else embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
