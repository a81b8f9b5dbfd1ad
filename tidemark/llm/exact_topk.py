"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, in blocks, in each round. A round counts the scores of each query in equal bins
of the interval that holds its k-th highest score, adds the counts up over all tasks and goes on with the bin that
holds it, until that bin is one value wide or has no more rows than are asked for. Then its lower end is a threshold:
a last pass keeps the scores that reach it. Nothing but counts and results is shuffled after the vectors are packed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import release, stage
from tidemark.llm.vectors import NONE, Best, integers, kth, matrix, pack, scores

#: Rows of a block, queries of a block on average, and bins of a histogram.
BLOCK, TOGETHER, BINS = 4096, 512, 4096


def _pairs(state: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each block of queries beside each block of rows: the stated queries against all rows. Spark broadcasts the queries if it finds them small."""
    one = F.collect_list(F.struct("query_id", "vec", "low", "high", "above")).alias("q")
    packed = state.groupBy("part", "n").agg(one).select(F.col("n").alias("q_size"), F.flatten("q.vec").alias("q_flat"), *[F.col(f"q.{c}").alias(f"q_{c}") for c in ("query_id", "low", "high", "above")])
    return blocks.crossJoin(packed)


def _scored(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    """ids of queries, their low, high and above, ids of rows, and all scores (NONE for a query's own id)."""
    for size, flat, ids, q_size, q_flat, query, low, high, above in zip(*(frame[c] for c in ("size", "flat", "vec_id", "q_size", "q_flat", "q_query_id", "q_low", "q_high", "q_above")), strict=True):
        query, ids = np.asarray(query), np.asarray(ids)
        score = scores(matrix(q_flat, q_size, len(query)), matrix(flat, size, len(ids)))
        score[query[:, None] == ids] = NONE
        yield query, np.asarray(low), np.asarray(high), np.asarray(above), ids, score


def width(low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    return -((low - high) // bins)


def histogram(score: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bin and count of the scores of each row from low up to high, which `bins` bins divide.

    left: how many of the highest scores of the interval are still looked for. Bins below the one in which these rows
    alone have that many are left out: the value looked for is not there, whatever other tasks count.
    """
    inside = np.where((score >= low[:, None]) & (score < high[:, None]), score, NONE)
    most, each = min(int(left.max()), score.shape[1]), width(low, high, bins)
    top = -np.sort(np.partition(-inside, most - 1, axis=1)[:, :most], axis=1)
    nth = np.where(left <= most, np.take_along_axis(top, np.minimum(left, most)[:, None] - 1, axis=1)[:, 0], NONE)
    least = np.where(nth > NONE, low + (nth - low) // each * each, low)
    row, at = np.nonzero(inside >= least[:, None])
    keys, counts = np.unique(row * bins + (inside[row, at] - low[row]) // each[row], return_counts=True)
    return keys // bins, keys % bins, counts


def exact_top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256, bins: int = BINS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: of each row whose vec_id is divisible by `every`, the k rows of highest score.

    The score is the inner product of the vectors' components times `scale`, rounded down. Candidates are all rows
    but the query's own; a query with fewer than k gets all of them; ties go to the smaller vec_id. Rows with a null
    vec_id, a null vector or a component that is null or not finite take no part. Of rows that share a vec_id the one
    with the least vector counts. Of vectors of two lengths the shorter one counts as followed by zeros, so empty
    vectors score 0. Other columns are not looked at. An empty table gives an empty result. Vectors longer than 2 ** 27.5 after
    rounding are an error, as scores would not fit in 64 bits.
    """
    rows = stage(integers(embeddings, scale), "integers")
    blocks = stage(pack(rows, BLOCK), "blocks")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    sized = rows.select("vec_id", "vec", length.alias("length"))
    asked = F.pmod("vec_id", F.lit(every)) == 0
    longest, n = sized.agg(F.coalesce(F.max("length"), F.lit(0.0)), F.count_if(asked)).first()
    # no score is beyond the product of two lengths
    reach = F.ceil(F.col("length") * longest * (1 + 1e-9)) + 1
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // TOGETHER)))).alias("part")
    state = sized.where(asked).select(F.col("vec_id").alias("query_id"), "vec", F.size("vec").alias("n"), part, (-reach).alias("low"), (reach + 1).alias("high"), F.lit(0).cast("long").alias("above"), F.lit(True).alias("open"))
    state = stage(state, "state")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for query, low, high, above, _, score in _scored(frame):
                row, at, found = histogram(score, low, high, k - above, bins)
                yield pd.DataFrame({"query_id": query[row], "bin": at, "found": found})

    while not state.where("open").isEmpty():
        open_ = state.where("open")
        counts = _pairs(open_, blocks).mapInPandas(count, "query_id long, bin long, found long").groupBy("query_id", "bin").agg(F.sum("found").alias("found"))
        upto = F.sum("found").over(Window.partitionBy("query_id").orderBy(F.desc("bin")))
        reached = counts.withColumn("upto", upto).join(open_.select("query_id", "above"), "query_id").where(F.col("above") + F.col("upto") >= k)
        at = reached.groupBy("query_id").agg(F.max_by(F.struct("bin", "found", "upto"), "bin").alias("at"))
        each = F.ceil((F.col("high") - F.col("low")) / bins)
        low = F.col("low") + F.col("at.bin") * each
        # without a bin the query has fewer than k candidates, and all scores from low on are asked for
        more = F.coalesce((F.col("above") + F.col("at.upto") > k) & (each > 1), F.lit(False))
        above = F.col("above") + F.coalesce(F.col("at.upto") - F.col("at.found"), F.lit(0))
        now = open_.join(at, "query_id", "left").select("query_id", "vec", "n", "part", F.coalesce(low, "low").alias("low"), F.coalesce(F.least(low + each, "high"), "high").alias("high"), above.alias("above"), more.alias("open"))
        before, state = state, stage(state.where("NOT open").unionByName(now), "state")
        release(before)

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(k)
        for frame in frames:
            for query, low, _, _, ids, score in _scored(frame):
                if best.add(query, np.zeros(len(query), np.int64), np.where(score >= low[:, None], score, NONE), ids):
                    yield pd.DataFrame(best.rows()).drop(columns="slot")
        yield pd.DataFrame(best.rows()).drop(columns="slot")

    kept = _pairs(state, blocks).mapInPandas(keep, "name long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumnRenamed("name", "query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
