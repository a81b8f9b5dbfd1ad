"""Entropy tilting: weights of draws in proportion to exp(theta . features), with theta fitted to what happened, in order of time.

The loss of a theta is minus the mean, over kinds of props, of the skill against theta = 0 (1 - score / baseline score),
plus a ridge. Score and gradient of every game are computed in the task that holds its shard; tasks add them up by fold
and prop, Spark adds up those few rows, and only they reach the driver. All folds advance together: each evaluation is one
pass over the shards, packed as bytes, and each game meets the thetas of its own folds alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.scoring import CLIP
from tidemark.operators.quality import require_empty
from tidemark.operators.shards import PACKED, Block, PackedBlock, blocks, packed
from tidemark.sources.tables import cut

#: Weight of the ridge, most passes of a fit, and the largest gradient at which a fold is done.
RIDGE, ROUNDS, TOLERANCE = 0.01, 60, 1e-9
#: Step lengths, the full one before the others, and the share of the expected fall that a step must bring.
STEPS, ENOUGH = (1.0, 0.3, 0.1, 0.01), 1e-4
#: Draws whose scores are computed at once: few enough for the arrays to stay in a core's cache.
TOGETHER = 30_000


@dataclass(frozen=True)
class Fold:
    """Fits on what was known by train_end, scores what lies from score_start to score_end."""

    name: str
    train_start: datetime
    train_end: datetime
    score_start: datetime
    score_end: datetime


def checked_folds(folds: list[Fold]) -> list[Fold]:
    """The folds, if there are some, with distinct names and one origin, each scoring after it trains and after the fold before."""
    if not folds or len({f.name for f in folds}) < len(folds) or len({f.train_start for f in folds}) > 1:
        raise ValueError("folds need distinct names and one origin")
    for f in folds:
        if not f.train_start <= f.train_end < f.score_start <= f.score_end:
            raise ValueError(f"fold {f.name}: training must end before scoring begins")
    for a, b in zip(folds, folds[1:], strict=False):
        if not (a.train_end < b.train_end and a.score_end < b.score_start):
            raise ValueError(f"folds {a.name} and {b.name} overlap or are out of order")
    return folds


def _effects(block: Block, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the draws, score of each label (log loss if its prop is binary, else CRPS), and for each label and draw what its weight adds to the score, times that weight."""
    w, n = block.weights(theta), len(block.start)
    drawn = w[block.draw]
    mass = np.bincount(block.code, drawn, len(block.values))
    label, y = block.label, block.observed
    binary, hit, outside, below, above = block.fixed
    add = lambda v: np.bincount(label, v, n)
    # log loss of the labels that are binary
    p = add(np.where(hit, mass, 0.0))
    q = np.clip(p, CLIP, 1 - CLIP)
    log_loss, pull = -(y * np.log(q) + (1 - y) * np.log(1 - q)), np.where(p == q, (1 - y) / (1 - q) - y / q, 0.0)
    # CRPS of the others: distribution functions begin anew with each label
    def running(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        v[block.start[1:]] -= add(v)[:-1]
        return np.cumsum(v)

    cdf = running(mass)
    crps = add(cdf * cdf * below + (1 - cdf) ** 2 * above) + outside
    # what a mass adds to the score: a mass counts in the distribution function from its value on
    bend = 2 * (cdf * below - (1 - cdf) * above)
    each = np.where(binary[label], hit * pull[label], add(bend)[label] - running(bend) + bend)
    drawn *= each[block.code]
    return w, np.where(binary, log_loss, crps), drawn


def block_scores(block: Block, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of each label of a block and its gradient, one row a label."""
    w, score, pulled = _effects(block, theta)
    mean = np.add.reduceat(w[:, None] * block.x, block.first, axis=0)[block.game]
    first = np.cumsum(block.many) - block.many  # draws of a label are neighbours
    gradient = np.add.reduceat(pulled[:, None] * block.x_of_draw, first, axis=0) - mean * np.add.reduceat(pulled, first)[:, None]
    return score, gradient


def block_sums(block: Block, theta: np.ndarray) -> np.ndarray:
    """Labels, sum of scores and sums of gradients of a block, one row for each of its props."""
    w, score, pulled = _effects(block, theta)
    names, prop = block.props
    at = np.repeat(prop * len(w), block.many)
    at += block.draw
    pulled = np.bincount(at, pulled, len(names) * len(w)).reshape(len(names), len(w))
    for own in pulled:  # less what the mean of a game moves with its weights
        own -= w * np.add.reduceat(own, block.first)[block.of]
    return np.column_stack([np.bincount(prop, minlength=len(names)), np.bincount(prop, score, len(names)), pulled @ block.x])


def game_scores(x: np.ndarray, labels: list, theta: np.ndarray) -> Iterator[tuple[str, float, np.ndarray]]:
    """prop, score and gradient of each label (player, prop, observed, values, codes) of one game."""
    names = ("player", "prop", "observed", "values", "codes")
    kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True))))
    held = [{c: v.tolist() if isinstance(v, np.ndarray) else v for c, v in zip(names, label, strict=True)} for label in labels]
    batch = pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist()], pa.list_(pa.float64())), pa.array([len(x)]), pa.array([held], kind)], names=["flat", "n_draws", "labels"])
    score, slope = block_scores(Block(batch), theta)
    yield from ((label[1], float(s), g) for label, s, g in zip(labels, score, slope, strict=True))


def evaluated(shards: DataFrame, folds: str, thetas: dict[str, list[np.ndarray]]) -> dict[tuple[str, int, str], tuple[float, float, np.ndarray]]:
    """By fold, number of theta and prop: labels, sum of scores, and sum of gradients. shards: packed ones. folds: an array column of the folds a game counts in."""
    k = len(next(iter(thetas.values()))[0])

    figures = ["n", "score", *(f"g{j}" for j in range(k))]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, str], np.ndarray] = {}
        for batch in batches:
            members = batch.column(batch.schema.get_field_index("folds")).to_pylist()
            for fold, own in thetas.items():  # a fold's games alone meet its thetas
                for _, block in blocks(batch.filter(pa.array([fold in fs for fs in members], pa.bool_())), PackedBlock, TOGETHER):
                    if not len(block.start):
                        continue
                    for i, theta in enumerate(own):
                        for prop, row in zip(block.props[0], block_sums(block, theta), strict=True):
                            sums.setdefault((fold, i, prop), np.zeros(2 + k))[:] += row
        if sums:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*((*key, *v.tolist()) for key, v in sums.items()), strict=True), (pa.string(), pa.int32(), pa.string(), *[pa.float64()] * (2 + k)), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["fold", "i", "prop", *figures])

    rows = shards.where(F.size(folds) > 0).withColumnRenamed(folds, "folds")
    parts = rows.select("folds", "n_draws", "props", *PACKED).mapInArrow(added, ", ".join(["fold string, i int, prop string", *(f"{c} double" for c in figures)]))
    out = parts.groupBy("fold", "i", "prop").agg(*[F.sum(c).alias(c) for c in figures]).collect()  # folds times thetas times props
    return {(r.fold, r.i, r.prop): (r.n, r.score, np.array([r[f"g{j}"] for j in range(k)])) for r in out}


def _loss(found: dict, fold: str, i: int, base: dict[str, float], theta: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Minus the mean skill, plus the ridge, and its gradient."""
    skills, slopes = [], []
    for prop in sorted(base):
        n, score, slope = found[fold, i, prop]
        skills.append(1 - score / n / base[prop] if base[prop] else 0.0)
        slopes.append(-slope / n / base[prop] if base[prop] else 0 * slope)
    return -float(np.mean(skills)) + ridge * float(theta @ theta), -np.mean(slopes, axis=0) + 2 * ridge * theta


@dataclass
class Fit:
    theta: np.ndarray
    loss: float
    rounds: int
    converged: bool


def fit(shards: DataFrame, folds: str, names: list[str], ridge: float = RIDGE, rounds: int = ROUNDS) -> dict[str, Fit]:
    """theta of each fold by a quasi-Newton method (BFGS with backtracking) from 0; `rounds` bounds the steps. shards: packed ones.

    A step is one pass over the shards, and a second one for all shorter lengths at once if its full length is not good enough.
    A fold without games is an error. A fold is done when no component of its gradient exceeds TOLERANCE, or when no step
    length lowers its loss any more.
    """
    k = shards.select(F.max(F.length("x") / (8 * F.col("n_draws")))).first()[0] or 0
    k = int(k)
    zero = evaluated(shards, folds, {n: [np.zeros(k)] for n in names}) if k else {}
    base: dict[str, dict[str, float]] = {n: {} for n in names}
    for (fold, _, prop), (n, score, _) in zero.items():
        base[fold][prop] = score / n
    if empty := [n for n in names if not base[n]]:
        raise ValueError(f"folds without games to fit on: {empty}")
    now, slope, inverse = {}, {}, {n: np.eye(k) for n in names}
    for n in names:
        loss, slope[n] = _loss(zero, n, 0, base[n], np.zeros(k), ridge)
        now[n] = Fit(np.zeros(k), loss, 0, bool(np.abs(slope[n]).max() < TOLERANCE))
    open_ = [n for n in names if not now[n].converged] if rounds else []
    ways, tried = {}, {}
    while open_:
        for n in open_:
            if n not in tried:
                ways[n], tried[n] = -inverse[n] @ slope[n], STEPS[:1]
                now[n].rounds += 1
        thetas = {n: [now[n].theta + t * ways[n] for t in tried[n]] for n in open_}
        found = evaluated(shards, folds, thetas)
        for n in list(open_):
            fall = float(slope[n] @ ways[n])
            for i, t in enumerate(tried[n]):
                loss, new = _loss(found, n, i, base[n], thetas[n][i], ridge)
                if loss <= now[n].loss + ENOUGH * t * fall:
                    break
            else:
                if tried[n] == STEPS[:1]:
                    tried[n] = STEPS[1:]
                    continue
                del tried[n]
                # no step is good enough: begin again along the gradient, and give up after that
                if np.array_equal(inverse[n], np.eye(k) * inverse[n][0, 0]):
                    open_.remove(n)
                    now[n].converged = bool(np.abs(slope[n]).max() < 1e3 * TOLERANCE)
                elif now[n].rounds == rounds:
                    open_.remove(n)
                inverse[n] = np.eye(k)
                continue
            del tried[n]
            s, g = thetas[n][i] - now[n].theta, new - slope[n]
            if s @ g > 1e-18:
                if now[n].rounds == 1:
                    inverse[n] = np.eye(k) * (s @ g) / (g @ g)
                left = np.eye(k) - np.outer(s, g) / (s @ g)
                inverse[n] = left @ inverse[n] @ left.T + np.outer(s, s) / (s @ g)
            now[n].theta, now[n].loss, slope[n] = thetas[n][i], loss, new
            if np.abs(new).max() < TOLERANCE:
                now[n].converged = True
            if now[n].converged or now[n].rounds == rounds:
                open_.remove(n)
    return now


def fold_members(shards: DataFrame, folds: list[Fold], as_of: str, known: str) -> DataFrame:
    """shards with fit_folds and score_folds: the folds that a game is fitted on (asked and settled by train_end) and scored in."""
    inside = lambda test: F.filter(F.array(*[F.when(test(f), F.lit(f.name)) for f in folds]), lambda x: x.isNotNull())
    at = F.col(as_of)
    fits = inside(lambda f: (at >= F.lit(f.train_start)) & (at <= F.lit(f.train_end)) & (F.col(known) <= F.lit(f.train_end)))
    return shards.withColumns({"fit_folds": fits, "score_folds": inside(lambda f: (at >= F.lit(f.score_start)) & (at <= F.lit(f.score_end)))})


def walk_forward(shards: DataFrame, folds: list[Fold], game: str, as_of: str, known: str, ridge: float = RIDGE) -> tuple[DataFrame, dict[str, Fit]]:
    """fold, prop, n, score, baseline and skill out of sample, and the fits. shards: those of `compact` with two times.

    Fails on a fold without games to fit on or to score, and on a game that one fold fits on and scores.
    """
    checked_folds(folds)
    members = cut(packed(fold_members(shards, folds, as_of, known), game, "fit_folds", "score_folds"))  # each pass reads it
    require_empty(members.where(F.arrays_overlap("fit_folds", "score_folds")).select(game), "games that a fold fits on and scores")
    names = [f.name for f in folds]
    fits = fit(members, "fit_folds", names, ridge)
    found = evaluated(members, "score_folds", {n: [fits[n].theta, 0 * fits[n].theta] for n in names})
    if empty := [n for n in names if not any(k[0] == n for k in found)]:
        raise ValueError(f"folds without games to score: {empty}")
    rows = [(f, p, int(n), score / n, found[f, 1, p][1] / n) for (f, i, p), (n, score, _) in sorted(found.items()) if i == 0]
    out = shards.sparkSession.createDataFrame(rows, "fold string, prop string, n long, score double, baseline double")
    return out.withColumn("skill", F.when(F.col("baseline") == 0, 0.0).otherwise(1.0 - F.col("score") / F.col("baseline"))), fits


def fit_frame(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """fold, theta, loss, rounds and converged of each fold."""
    rows = [(n, f.theta.tolist(), f.loss, f.rounds, f.converged) for n, f in sorted(fits.items())]
    return spark.createDataFrame(rows, "fold string, theta array<double>, loss double, rounds int, converged boolean")
