"""Prequential calibration: every probability is calibrated by what was known strictly before it was made.

Each row belongs to groups from narrow to broad. For every group and time of asking, logistic, beta and isotonic maps
are fitted on the outcomes known before; the map used is the one whose own earlier predictions, of outcomes known before,
had the least log loss. The narrowest group that can say both gives the answer; without one a row keeps its probability.

Probabilities are counted on a grid, so what a fit needs is a bounded table of counts, whatever the number of rows
behind it. Losses and answers come from such counts too; rows meet their answer in the end and are not shuffled for
it while answers are few. A group's times are dealt out by range, and a range begins with the counts of all ranges before it, which
Spark adds up: no task reads a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scoring import CLIP
from tidemark.operators.calibration import METHODS, pooled
from tidemark.operators.distributions import RANGES, past_sums, with_range
from tidemark.operators.quality import require_empty
from tidemark.sources.tables import cut

#: Ridge on the weights (not the intercept), and most rounds of a fit.
RIDGE, ROUNDS = 1e-6, 100
#: Most answers (one for each set of groups, time and p) that are sent to every task instead of shuffling the rows to them.
BROADCAST_ROWS = 200_000


def newton(x: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Intercept and weights of a logistic fit to s successes in n trials at the rows of x, by Newton's method with halved steps."""
    x, ridge, w = np.column_stack([np.ones(len(x)), x]), np.full(x.shape[1] + 1, RIDGE), np.zeros(x.shape[1] + 1)
    ridge[0] = 0.0

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * np.logaddexp(0, z) - s * z).sum() + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        slope = x.T @ (n * p - s) + ridge * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-12)
        step = np.linalg.solve(curve, slope)
        for _ in range(40):
            if (new := loss(w - step)) <= now:
                break
            step = step / 2
        else:
            break
        w, now = w - step, new
        if np.abs(step).max() < 1e-11 * (1 + np.abs(w).max()):
            break
    return w


def _features(p: np.ndarray, method: str) -> np.ndarray:
    return np.log(p / (1 - p))[:, None] if method == "logistic" else np.column_stack([np.log(p), np.log(1 - p)])


def calibrated(p: np.ndarray, s: np.ndarray, n: np.ndarray, asked: np.ndarray, method: str) -> np.ndarray:
    """Calibrated values of `asked` by one method, fitted to s outcomes among n rows at each of the rising p."""
    p, asked = np.clip(p, CLIP, 1 - CLIP), np.clip(asked, CLIP, 1 - CLIP)
    if method == "isotonic":
        p, at = np.unique(p, return_inverse=True)
        blocks = pooled(p, np.bincount(at, s), np.bincount(at, n))
        knots = [(x, b[2] / b[3]) for b in blocks for x in dict.fromkeys(b[:2])]
        out = np.interp(asked, [k[0] for k in knots], [k[1] for k in knots])
    else:
        w = newton(_features(p, method), s, n)
        out = 1 / (1 + np.exp(-np.clip(w[0] + _features(asked, method) @ w[1:], -700, 700)))
    return np.clip(out, CLIP, 1 - CLIP)


class _History:
    """Outcomes and rows of each p known so far."""

    def __init__(self):
        self.p = self.s = self.n = np.zeros(0)

    def add(self, p: np.ndarray, s: np.ndarray, n: np.ndarray) -> None:
        self.p, at = np.unique(np.concatenate([self.p, p]), return_inverse=True)
        self.s, self.n = np.bincount(at, np.concatenate([self.s, s])), np.bincount(at, np.concatenate([self.n, n]))


def _candidates(rows: DataFrame, methods: tuple[str, ...], least: int) -> DataFrame:
    """group, asked_at, p, one column a method and fit_rows. rows: group, part, time, kind (0: counts before the part, 1: asked, 2: known), p, s and n."""
    kinds = dict(rows.dtypes)

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, time, history, asked, known = None, None, _History(), [], []

        def ended() -> Iterator[pd.DataFrame]:
            """What is asked at a time sees what was known before it; then what became known then is added."""
            nonlocal asked, known
            if asked and history.n.sum() >= least and 0 < history.s.sum() < history.n.sum():
                p = np.unique(np.concatenate(asked))
                values = {m: calibrated(history.p, history.s, history.n, p, m) for m in methods}
                yield pd.DataFrame({"group": at[0], "asked_at": time, "p": p, **values, "fit_rows": int(history.n.sum())})
            if known:
                history.add(*(np.concatenate(x) for x in zip(*known, strict=True)))
            asked, known = [], []

        for frame in frames:
            # runs of equal group, part, time and kind
            keys = [frame[c] for c in ("group", "part", "time", "kind")]
            new = np.zeros(len(frame), bool)
            for k in keys:
                new |= (k != k.shift()).to_numpy() & ~(k.isna() & k.shift().isna()).to_numpy()
            for i, j in zip(first := np.flatnonzero(new).tolist(), [*first[1:], len(frame)], strict=True):
                group, part, when, kind = (k.iloc[i] for k in keys)
                if (group, part) != at:
                    yield from ended()
                    at, time, history = (group, part), None, _History()
                p, s, n = (frame[c].to_numpy(float)[i:j] for c in ("p", "s", "n"))
                if kind == 0:
                    history.add(p, s, n)
                    continue
                if when != time:
                    yield from ended()
                    time = when
                (asked.append(p) if kind == 1 else known.append((p, s, n)))
        yield from ended()

    sorted_ = rows.repartition("group", "part").sortWithinPartitions("group", "part", F.col("time").asc_nulls_first(), "kind")
    return sorted_.mapInPandas(stream, ", ".join(["group string", f"asked_at {kinds['time']}", "p double", *(f"{m} double" for m in methods), "fit_rows long"]))


def prequential(rows: DataFrame, key: list[str], levels: dict[str, str | None], p: str, y: str, as_of: str, known: str, least: int = 200, methods: tuple[str, ...] = METHODS, digits: int = 6) -> DataFrame:
    """rows with p_calibrated, calibration_level, calibration_group, calibration_method, calibration_fallback_depth, fit_rows, selection_rows and selection_log_loss.

    key: columns that tell rows apart. levels: names of levels from narrow to broad, each with its column (None: all rows);
    a row whose column is null or empty has no group there. A map is fitted on rows whose outcome was known before the
    row's as_of, at least `least` of them with both outcomes; a method is chosen among at least `least` earlier predictions
    of its group with both outcomes, ties to the first of `methods`. Rows of one as_of see the same past. p is counted
    to `digits` decimals. A row without such a group keeps p, with level identity and depth -1. A p that is null or beyond 0
    and 1, an outcome other than 0 and 1, and a null time are errors; so is a key that repeats.
    """
    if least < 1 or not methods:
        raise ValueError("one row and one method at least")
    bad = F.col(p).isNull() | ~F.col(p).between(0.0, 1.0) | F.col(y).isNull() | ~F.col(y).isin(0, 1) | F.col(as_of).isNull() | F.col(known).isNull()
    require_empty(rows.where(bad), "rows with a probability, outcome or time that cannot be used")
    _require_distinct(rows, key)
    at = F.round(F.col(p).cast("double"), digits)
    names = {level: None if c is None else f"_v{i}" for i, (level, c) in enumerate(levels.items())}
    of = {names[level]: F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for level, c in levels.items() if c is not None}
    of |= {"_asked": F.col(as_of), "_p": at}
    # rows that agree in all that a map, a loss or an answer depends on are counted once; the rest works on these counts
    counts = rows.groupBy(*[v.alias(k) for k, v in of.items()], F.col(known).alias("known_at")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("int")).alias("ones"))
    counts = cut(counts)
    named = F.array(*[F.struct(F.lit(i).alias("depth"), F.lit(level).alias("level"), (F.lit("GLOBAL") if c is None else F.col(c)).alias("value")) for i, (level, c) in enumerate(names.items())])
    usable = F.filter(named, lambda g: g["value"].isNotNull())
    grouped = lambda df, *more: df.select("*", F.inline(usable)).select(F.concat_ws("|", "level", "value").alias("group"), F.col("_asked").alias("asked_at"), F.col("_p").alias("p"), *more)
    each = grouped(counts, "known_at", "n", "ones").groupBy("group", "asked_at", "p", "known_at").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    candidates = cut(_candidates(_events(each), methods, least))
    # losses of what each group predicted, by the time the outcome became known
    loss = lambda m: -(F.col("ones") * F.log(F.col(m)) + (F.col("n") - F.col("ones")) * F.log(F.lit(1.0) - F.col(m)))
    sums = ["n", "ones", *(f"loss_{m}" for m in methods)]
    added = each.join(candidates, ["group", "asked_at", "p"]).groupBy("group", F.col("known_at").alias("time")).agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), *[F.sum(loss(m)).alias(f"loss_{m}") for m in methods])
    asked = candidates.select("group", F.col("asked_at").alias("time")).distinct().select("*", *[F.lit(0).cast("long").alias(c) for c in sums[:2]], *[F.lit(0.0).alias(c) for c in sums[2:]])
    times = cut(added.unionByName(asked).groupBy("group", "time").agg(*[F.sum(c).alias(c) for c in sums]))
    past = past_sums(times, ["group"], "time", sums)
    ranked = F.array_min(F.array(*[F.struct(F.col(f"loss_{m}").alias("loss"), F.lit(i).alias("i"), F.lit(m).alias("method")) for i, m in enumerate(methods)]))
    chosen = past.where((F.col("n") >= least) & (F.col("ones") > 0) & (F.col("ones") < F.col("n")))
    chosen = chosen.select("group", F.col("time").alias("asked_at"), ranked["method"].alias("calibration_method"), F.col("n").alias("selection_rows"), (ranked["loss"] / F.col("n")).alias("selection_log_loss"))
    value = F.coalesce(*[F.when(F.col("calibration_method") == m, F.col(m)) for m in methods])
    found = candidates.join(chosen, ["group", "asked_at"])
    answer = F.min(F.struct("depth", value.alias("p_calibrated"), F.col("level").alias("calibration_level"), F.col("value").alias("calibration_group"), "calibration_method", "fit_rows", "selection_rows", "selection_log_loss")).alias("_a")
    cells = grouped(counts.select(*of).distinct(), *of, "depth", "level", "value")
    best = cut(cells.join(found, ["group", "asked_at", "p"]).groupBy(*of).agg(answer))
    if best.count() <= BROADCAST_ROWS:
        best = F.broadcast(best)
    on = F.lit(True)
    for k, v in of.items():
        on &= v.eqNullSafe(best[k])
    plain = lambda c, other: F.coalesce(F.col(f"_a.{c}"), F.lit(other)).alias(c)
    return rows.join(best, on, "left").select(
        *[rows[c] for c in rows.columns], F.coalesce(F.col("_a.p_calibrated"), F.col(p).cast("double")).alias("p_calibrated"), plain("calibration_level", "identity"), plain("calibration_group", "IDENTITY"), plain("calibration_method", "identity"),
        F.coalesce(F.col("_a.depth"), F.lit(-1)).alias("calibration_fallback_depth"), plain("fit_rows", 0), plain("selection_rows", 0), F.col("_a.selection_log_loss").alias("selection_log_loss"),
    )


def _require_distinct(rows: DataFrame, key: list[str]) -> None:
    """Raises if a key repeats. Hashes of keys are counted, keys themselves only where hashes are equal."""
    at = F.xxhash64(*key).alias("_h")
    twice = rows.select(at).groupBy("_h").count().where("count > 1").select("_h")
    if twice.limit(1).count():
        suspects = rows.select(*key, at).join(twice, "_h", "left_semi")
        require_empty(suspects.groupBy(*key).count().where("count > 1"), "rows that repeat a key")


def _events(each: DataFrame) -> DataFrame:
    """What `_candidates` reads, of each (group, asked_at, p, known_at, n, ones): counts of each group, part of its times, time and p; those of earlier parts as the counts a part begins with."""
    zero = [F.lit(0.0).alias("s"), F.lit(0.0).alias("n")]
    known = each.groupBy("group", F.col("known_at").alias("time"), "p").agg(F.sum("ones").cast("double").alias("s"), F.sum("n").cast("double").alias("n")).withColumn("kind", F.lit(2))
    asked = each.select("group", F.col("asked_at").alias("time"), "p").distinct().select("*", *zero, F.lit(1).alias("kind"))
    rows = cut(with_range(known.unionByName(asked), "time", "part"))
    totals = rows.where("kind = 2").groupBy("group", "part", "p").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    needed = rows.where("kind = 1").select("group", F.col("part").alias("_to")).distinct()
    later = F.explode(F.sequence(F.col("part") + 1, F.lit(RANGES)))
    before = totals.where(F.col("part") < RANGES).select("group", later.alias("_to"), "p", "s", "n").join(needed, ["group", "_to"]).groupBy("group", "_to", "p").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    before = before.select("group", F.lit(None).cast(dict(rows.dtypes)["time"]).alias("time"), "p", "s", "n", F.lit(0).alias("kind"), F.col("_to").alias("part"))
    return rows.unionByName(before)

