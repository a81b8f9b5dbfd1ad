"""Hard-negative mining over one-dimensional distance keys.

Each vector x gets one more component, sqrt(M - |x|^2) with M the largest squared length, and an anchor gets 0 there: the
largest inner products are then the smallest distances. Rows are stored sorted by (nearest pivot, distance to it), in
annuli about the pivots. What an anchor's own distance to a pivot is says how near the rows of an annulus can be to it.
So annuli are opened outward from the anchor's key, in a few rounds of growing share, and one stays closed as soon as
the bound on its scores cannot beat the k-th score found: in the last round nothing else is left, which certifies the
top k. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import release, stage
from tidemark.llm.multi_index import codebook
from tidemark.llm.vectors import NONE, Best, integers, matrix, pack, scores

#: Vectors that pivots are fitted on at most (those of least hash), rounds of k-means, most pivots and annuli of a pivot.
FIT_ROWS, ROUNDS, PIVOTS, ANNULI = 20_000, 5, 64, 64
#: Rows of a piece of an annulus on average, anchors that meet it at once, and shares of all rows that the rounds open.
PIECE, TOGETHER, SHARES = 4096, 256, (1 / 32, 1 / 4, 1.0)
#: Part of the lengths by which a distance may be off in double precision, and more.
SLACK = 1e-6


class Keys:
    """Pivots, and of each annulus (pivot times `cuts` plus place) the rows, pieces, least and largest distance."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots, most

    def distances(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """Of integer rows x to each pivot. lifted: with the added component (rows of the table), else with 0 (anchors)."""
        m = min(x.shape[1], self.pivots.shape[1] - 1)
        x = x.astype(np.float64)
        square = (x * x).sum(1)
        last = np.sqrt(np.maximum(self.most - square, 0)) if lifted else np.zeros(len(x))
        far = (square + last * last)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * (x[:, :m] @ self.pivots[:, :m].T + last[:, None] * self.pivots[:, -1])
        return np.sqrt(np.maximum(far, 0))

    def scanned(self, annuli: pd.DataFrame, cuts: int) -> None:
        annuli = annuli.sort_values("annulus")
        self.id, self.rows, self.pieces = (annuli[c].to_numpy(np.int64) for c in ("annulus", "rows", "pieces"))
        self.pivot, self.least, self.largest = self.id // cuts, annuli["least"].to_numpy(), annuli["largest"].to_numpy()

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of anchors x: their keys, and the least and largest score that a row of each annulus can have."""
        square, key = (x.astype(np.float64) ** 2).sum(1), self.distances(x, False)
        own = key[:, self.pivot]
        slack = SLACK * (np.sqrt(self.most) + np.sqrt(square))[:, None]
        near = np.maximum(np.maximum(own - self.largest, self.least - own) - slack, 0)
        far = own + self.largest + slack
        both = (square + self.most)[:, None]
        return key, np.floor((both - far * far) / 2), np.ceil((both - near * near) / 2)


def _annulus(keys: Keys, cuts: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = keys.distances(x, True)
    pivot = far.argmin(1)
    far = far[np.arange(len(x)), pivot]
    return pivot * (cuts.shape[1] + 1) + (cuts[pivot] < far[:, None]).sum(1), far


def _stored(rows: DataFrame) -> tuple[DataFrame, Keys]:
    """The table of pieces, sorted by annulus and distance, and the directory of annuli (PIVOTS times ANNULI of them at most)."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    most, total = rows.agg(F.max(square), F.count("*")).first()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vec").toPandas()["vec"].tolist()
    size = int(np.median([len(v) for v in sample]))  # pivots are points of this many components; any points would do
    x = np.zeros((len(sample), size + 1))
    for i, v in enumerate(sample):
        x[i, : min(size, len(v))] = v[:size]
    x[:, -1] = np.sqrt(np.maximum(most - (x * x).sum(1), 0))
    n = int(np.clip(2 ** round(np.log2(max(np.sqrt(total / PIECE), 1))), 4, PIVOTS))
    keys = Keys(codebook(x, n, ROUNDS), most)
    n, parts = len(keys.pivots), int(np.clip(-(-total // (PIECE * len(keys.pivots))), 2, ANNULI))

    def key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 1000):
                vec = frame["vec"].iloc[i : i + 1000]
                for size in set(map(len, vec)):
                    same = [j for j, v in enumerate(vec) if len(v) == size]
                    far = keys.distances(np.array([vec.iloc[j] for j in same], np.int64).reshape(len(same), size), True)
                    yield frame.iloc[[i + j for j in same]].assign(pivot=far.argmin(1).astype(np.int32), distance=far.min(1))

    keyed = stage(rows.mapInPandas(key, "vec_id long, vec array<long>, label long, pivot int, distance double"), "keys")
    cuts = np.full((n, parts - 1), np.inf)
    for pivot, at in keyed.groupBy("pivot").agg(F.percentile_approx("distance", [(i + 1) / parts for i in range(parts - 1)], 1000)).collect():
        cuts[pivot] = at
    flat = F.lit(cuts.ravel().tolist())
    own = F.slice(flat, F.col("pivot") * (parts - 1) + 1, F.lit(parts - 1))
    annulus = F.col("pivot") * parts + F.size(F.filter(own, lambda c: c < F.col("distance")))
    placed = keyed.withColumn("annulus", annulus)
    annuli = placed.groupBy("annulus").agg(F.count("*").alias("rows"), F.min("distance").alias("least"), F.max("distance").alias("largest"))
    annuli = annuli.withColumn("pieces", F.ceil(F.col("rows") / PIECE)).toPandas()
    keys.scanned(annuli, parts)
    pieces = F.create_map(*[F.lit(int(x)) for pair in zip(keys.id, keys.pieces, strict=True) for x in pair])
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("vec_id"), pieces[F.col("annulus")]))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = placed.repartitionByRange(tasks, "annulus", "piece").sortWithinPartitions("annulus", "piece", F.size("vec"), "distance")
    return stage(pack(order, PIECE, ("annulus", "piece"), ("vec_id", "label", "distance")), "pieces"), keys


def _routed(anchors: DataFrame, keys: Keys, low: float, high: float) -> DataFrame:
    """Anchors beside the pieces that they open when rows up to the share `high` are opened, without those up to `low`.

    anchors: anchor_id, label, vec, and windows (slot, low, high, least): scores from low to high are looked for, and
    those below least are no longer of use.
    """
    total = int(keys.rows.sum())

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby([frame["vec"].map(len), np.arange(len(frame)) // TOGETHER]):
                x = np.array(part["vec"].tolist(), np.int64).reshape(len(part), -1)
                ids, labels = part["anchor_id"].to_numpy(), part["label"].to_numpy()
                key, smallest, greatest = keys.bounds(x)
                order = np.argsort(-greatest, axis=1, kind="stable")
                upto = np.zeros_like(order)
                np.put_along_axis(upto, order, np.cumsum(keys.rows[order], axis=1) - keys.rows[order], axis=1)  # rows of annuli before it
                turn = (upto >= low * total) & (upto < high * total)
                window = [(i, w["slot"], w["low"], w["high"], max(w["low"], w["least"])) for i, ws in enumerate(part["windows"]) for w in ws]
                row, slot, _, top, least = (np.array(c, np.int64) for c in zip(*window, strict=True))
                use = (greatest[row] >= least[:, None]) & (smallest[row] <= top[:, None])
                for at, annulus in enumerate(keys.id.tolist()):
                    some = np.flatnonzero(use[:, at] & turn[row, at])
                    if len(some):
                        own, new = np.unique(row[some], return_inverse=True)
                        # rows beyond this distance from every anchor cannot reach a window
                        reach = np.sqrt(np.maximum((x[row[some]].astype(np.float64) ** 2).sum(1) + keys.most - 2.0 * least[some], 0))
                        reach += SLACK * (np.sqrt(keys.most) + np.sqrt((x[row[some]].astype(np.float64) ** 2).sum(1)))
                        key_ = key[row[some], keys.pivot[at]]
                        least_, most_ = float((key_ - reach).min()), float((key_ + reach).max())
                        data = (ids[own], labels[own], x.shape[1], x[own].ravel(), new, slot[some], least[some], top[some], least_, most_)
                        for piece in range(int(keys.pieces[at])):
                            yield pd.DataFrame([(annulus, piece, *data)], columns=["annulus", "piece", "a_id", "a_label", "a_size", "a_flat", "row", "slot", "low", "high", "nearest", "farthest"])

    return anchors.mapInPandas(route, "annulus int, piece long, a_id array<long>, a_label array<long>, a_size int, a_flat array<long>, row array<long>, slot array<long>, low array<long>, high array<long>, nearest double, farthest double")


def _search(anchors: DataFrame, windows: DataFrame, pieces: DataFrame, keys: Keys, k: int, same: bool, slots: int) -> DataFrame:
    """anchor_id, slot, rank, vec_id and score: the k highest scores in each window, of rows of the anchor's label (same) or of others.

    windows: anchor_id, slot, low and high, at most `slots` of each anchor.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(k, slots)
        for frame in frames:
            for flat, size, ids, labels, distance, a_id, a_label, a_size, a_flat, row, slot, low, high, nearest, farthest in zip(*(frame[c] for c in ("flat", "size", "vec_id", "label", "distance", "a_id", "a_label", "a_size", "a_flat", "row", "slot", "low", "high", "nearest", "farthest")), strict=True):
                i, j = np.searchsorted(distance, nearest, "left"), np.searchsorted(distance, farthest, "right")
                if i >= j:
                    continue
                ids, labels, row = np.asarray(ids)[i:j], np.asarray(labels)[i:j], np.asarray(row)
                a_id, a_label, low, high = (np.asarray(x)[:, None] for x in (a_id, a_label, low, high))
                score = scores(matrix(a_flat, a_size, len(a_id)), matrix(flat, size, len(distance))[i:j])
                score = np.where((a_id != ids) & ((a_label == labels) == same), score, NONE)[row]
                score = np.where((score >= low) & (score <= high), score, NONE)
                if best.add(a_id[row, 0], np.asarray(slot), score, ids):
                    yield pd.DataFrame(best.rows())
        yield pd.DataFrame(best.rows())

    order, found = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"), None
    for low, high in zip((0.0, *SHARES), SHARES, strict=False):
        now = windows.withColumn("least", F.lit(NONE))
        if found is not None:
            last = found.where(F.col("rank") == k).select("anchor_id", "slot", F.col("score").alias("least"))
            now = windows.join(last, ["anchor_id", "slot"], "left").withColumn("least", F.coalesce("least", F.lit(NONE)))
        now = now.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "low", "high", "least")).alias("windows"))
        routed = _routed(anchors.join(now, "anchor_id"), keys, low, high)
        new = routed.join(pieces, ["annulus", "piece"]).mapInPandas(scan, "name long, slot long, vec_id long, score long").withColumnRenamed("name", "anchor_id")
        new = new if found is None else new.unionByName(found.drop("rank"))
        before, found = found, stage(new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
        release(before)
    return found


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Anchors are the rows whose vec_id is divisible by `every`; a row's score is the inner product with the anchor of the
    components times `scale`, rounded down. Higher scores come first, ties by smaller vec_id. An anchor's positives are
    its first other rows of the same label; for each of them the first rows of other labels are returned whose score is
    from `least` to `most` hundredths of the positive's (so none for a negative score), all if there are fewer. Rows with
    a null vec_id or label, a null vector or a component that is null or not finite take no part. Of rows that share a
    vec_id the one with the least (vector, label) counts. Of vectors of two lengths the shorter one counts as followed
    by zeros. Other columns are not looked at. An empty table gives an empty result. Vectors longer than 2 ** 27.5 after
    rounding are an error.
    """
    rows = stage(integers(embeddings, scale, "label"), "integers")
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    pieces, keys = _stored(rows)
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("anchor_id"), "label", "vec")
    anywhere = anchors.select("anchor_id", F.lit(0).cast("long").alias("slot"), F.lit(NONE + 1).alias("low"), F.lit(-NONE).alias("high"))
    near = _search(anchors, anywhere, pieces, keys, positives, True, 1)
    near = near.select("anchor_id", F.col("rank").cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    window = near.where("positive_score >= 0").select("anchor_id", "slot", F.expr(f"({least} * positive_score + 99) div 100").alias("low"), F.expr(f"{most} * positive_score div 100").alias("high"))
    far = _search(anchors, window, pieces, keys, negatives, False, positives + 1)
    out = far.join(near, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
