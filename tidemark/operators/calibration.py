"""Calibration of probabilities: fitted maps, and their use in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scoring import clipped, log_loss
from tidemark.operators.distributions import past_sums, with_range
from tidemark.sources.tables import cut


def logit(p: Column) -> Column:
    q = clipped(p)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_logistic(df: DataFrame, features: list[Column], y: str, rounds: int = 12, ridge: float = 1e-6) -> list[float]:
    """Intercept and weights by Newton's method; each round is one aggregate of sums, whose number depends on the features only."""
    x = [F.lit(1.0), *features]
    k, w = len(x), np.zeros(len(features) + 1)
    for _ in range(rounds):
        z = sum((c * float(b) for c, b in zip(x[1:], w[1:], strict=True)), F.lit(float(w[0])))
        p = sigmoid(z)
        rows = df.select(p.alias("_p"), F.col(y).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
        grad = [F.sum(F.col(f"_x{i}") * (F.col("_y") - F.col("_p"))).alias(f"g{i}") for i in range(k)]
        curve = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}") * F.col("_p") * (F.lit(1.0) - F.col("_p"))).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        s = rows.agg(F.count("*").alias("n"), *grad, *curve).first()
        if not s["n"]:
            return [0.0] * k
        h = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + np.eye(k) * ridge
        step = np.linalg.solve(h, np.array([s[f"g{i}"] for i in range(k)]) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def apply_logistic(weights: list[float], features: list[Column]) -> Column:
    return sigmoid(sum((c * b for c, b in zip(features, weights[1:], strict=True)), F.lit(weights[0])))


def beta_features(p: Column) -> list[Column]:
    """Features of beta calibration: log p and -log(1 - p)."""
    q = clipped(p)
    return [F.log(q), -F.log(F.lit(1.0) - q)]


def _pool(blocks: list[list[float]], block: list[float]) -> None:
    """Appends a block (lower, upper, sum, count) and pools adjacent violators."""
    blocks.append(block)
    while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
        _, upper, s, n = blocks.pop()
        blocks[-1][1:] = [upper, blocks[-1][2] + s, blocks[-1][3] + n]


def pooled(p: np.ndarray, s: np.ndarray, n: np.ndarray) -> list[list[float]]:
    """Blocks (lower, upper, sum, count) of rising means. p: distinct and rising."""
    blocks: list[list[float]] = []
    for block in zip(p.tolist(), p.tolist(), s.tolist(), n.tolist(), strict=True):
        _pool(blocks, list(block))
    return blocks


def _pooled_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of each part, with the rows (x) and outcomes (y) of the part up to their end. Rows come sorted by part and p."""
    part, blocks = None, []

    def ended() -> pd.DataFrame:
        out = pd.DataFrame(blocks, columns=["lower", "upper", "s", "n"])
        return out.assign(part=np.int32(part), x=out["n"].cumsum(), y=out["s"].cumsum())

    for frame in frames:
        for at, p, s, n in frame[["_part", "p", "s", "n"]].itertuples(index=False):
            if at != part:
                if blocks:
                    yield ended()
                part, blocks = at, []
            _pool(blocks, [p, p, s, n])
    if blocks:
        yield ended()


def _bridges(blocks: DataFrame, ends: list[tuple[int, float, float]]) -> list[tuple[float, float]]:
    """The edges of the whole hull that go over the end of a part, as the rows before their begin and up to their end.

    Means rise exactly if they are the slopes of the lower hull of the points (rows so far, outcomes so far). Of two known
    vertices in different parts, the point farthest below their line is a vertex too; one aggregate finds it for all such
    pairs at once. Between two vertices of one part the hull is that part's own. ends: part, rows and outcomes at its end.
    """
    place = {part: i for i, (part, _, _) in enumerate(ends)}
    last = {i: x for i, (_, x, _) in enumerate(ends)}
    hull, open_, done = [(0.0, 0.0, -1), (ends[-1][1], ends[-1][2], len(ends) - 1)], None, set()

    def within(u, v) -> bool:
        return u[2] == v[2] or (v[2] == u[2] + 1 and (u[2] < 0 or u[0] == last[u[2]]))

    while True:
        open_ = [(u, v) for u, v in zip(hull, hull[1:], strict=False) if not within(u, v) and (u, v) not in done]
        if not open_:
            return sorted((u[0], v[0]) for u, v in zip(hull, hull[1:], strict=False) if not within(u, v))
        gap = lambda u, v: F.col("y") - (F.lit(u[1]) + (F.col("x") - u[0]) * ((v[1] - u[1]) / (v[0] - u[0])))
        row = blocks.agg(*[F.min(F.when((F.col("x") > u[0]) & (F.col("x") < v[0]), F.struct(gap(u, v), "x", "y", "part"))).alias(f"m{i}") for i, (u, v) in enumerate(open_)]).first()
        for i, (u, v) in enumerate(open_):
            m = row[f"m{i}"]
            if m is None or m[0] >= -1e-12 * (1 + abs(v[1] - u[1])):
                done.add((u, v))
            else:
                hull.append((m["x"], m["y"], place[m["part"]]))
        hull.sort()


def fit_isotonic(df: DataFrame, p: str, y: str) -> DataFrame:
    """knot and fitted: a rising function of p, by pooling adjacent violators over every distinct p; rows without p or y are left out.

    Spark adds up the rows of each p and tasks pool ranges of p. Blocks stay where they are; only those that a bridge
    over the end of a range spans become one. The driver learns a few points for each of the ranges, whose number is
    fixed, and no block.
    """
    rows = df.select(F.col(p).cast("double").alias("p"), F.col(y).cast("double").alias("y")).where("p IS NOT NULL AND NOT isnan(p) AND y IS NOT NULL")
    each = with_range(rows.groupBy("p").agg(F.sum("y").alias("s"), F.count("*").cast("double").alias("n")), "p")
    parts = each.repartition("_part").sortWithinPartitions("_part", "p").mapInPandas(_pooled_parts, "lower double, upper double, s double, n double, part int, x double, y double")
    parts = cut(parts)
    sums = sorted(map(tuple, parts.groupBy("part").agg(F.max("x"), F.max_by("y", "x")).collect()))  # RANGES rows at most
    if not sums:
        return parts.select(F.col("lower").alias("knot"), F.col("s").alias("fitted"))
    x, y_ = (np.cumsum([r[i] for r in sums]).tolist() for i in (1, 2))
    ends = [(r[0], a, b) for r, a, b in zip(sums, x, y_, strict=True)]
    offset = {r[0]: (a - r[1], b - r[2]) for r, a, b in zip(sums, x, y_, strict=True)}
    shift = lambda i: F.create_map(*[F.lit(v) for k, o in offset.items() for v in (k, float(o[i]))])[F.col("part")]
    blocks = parts.withColumns({"x": F.col("x") + shift(0), "y": F.col("y") + shift(1)})
    bridge = F.lit(None).cast("int")
    for i, (low, high) in enumerate(_bridges(blocks, ends)):
        bridge = F.when((F.col("x") > low) & (F.col("x") <= high), i).otherwise(bridge)
    blocks = blocks.withColumn("bridge", bridge)
    alone = blocks.where("bridge IS NULL").select("lower", "upper", "s", "n")
    joined = blocks.where("bridge IS NOT NULL").groupBy("bridge").agg(F.min("lower").alias("lower"), F.max("upper").alias("upper"), F.sum("s").alias("s"), F.sum("n").alias("n")).drop("bridge")
    ends_of = F.array_distinct(F.array("lower", "upper"))
    return alone.unionByName(joined).select(F.explode(ends_of).alias("knot"), (F.col("s") / F.col("n")).alias("fitted"))


def apply_isotonic(df: DataFrame, knots: DataFrame, p: str) -> DataFrame:
    """df with fitted: interpolated between knots, clipped beyond the first and the last; null without p or knots.

    Each distinct p meets the knots around it in its range of p; ranges hand each other their outermost knots.
    """
    at = F.when(~F.isnan(F.col(p).cast("double")), F.col(p).cast("double"))
    asked = df.select(at.alias("x")).where("x IS NOT NULL").distinct().withColumn("k", F.lit(None).cast("struct<x:double,v:double>"))
    own = knots.select(F.col("knot").cast("double").alias("x"), F.struct(F.col("knot").cast("double").alias("x"), F.col("fitted").cast("double").alias("v")).alias("k"))
    rows = with_range(asked.unionByName(own), "x")
    order = Window.partitionBy("_part").orderBy("x", F.col("k").isNull())
    # a knot comes before a question at the same place, so looking back it counts
    back, ahead = F.last("k", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("k", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    ends = rows.groupBy("_part").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    by = Window.partitionBy(F.lit(0)).orderBy("_part")  # a row for each range
    ends = ends.select(F.col("_part").alias("_at"), F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min("first").over(by.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    near = rows.withColumns({"back": back, "ahead": ahead}).where("k IS NULL").join(ends, F.col("_part") == F.col("_at"))
    near = near.select("x", F.coalesce("back", "before").alias("a"), F.coalesce("ahead", "after").alias("b"))
    a, b = (lambda f, c=c: F.col(f"{c}.{f}") for c in "ab")
    value = F.when(F.col("a").isNull(), b("v")).when(F.col("b").isNull() | (a("x") == F.col("x")), a("v")).otherwise(a("v") + (F.col("x") - a("x")) * ((b("v") - a("v")) / (b("x") - a("x"))))
    near = near.select(F.col("x").alias("_x"), value.alias("fitted"))
    return df.join(near, at == F.col("_x"), "left").drop("_x")


METHODS = ("logistic", "beta", "isotonic")


def choose_calibrator(df: DataFrame, p: str, y: str, columns: tuple[str, ...] = METHODS) -> tuple[DataFrame, str]:
    """df with a column for each calibrator, fitted on all its rows and clipped, and the name of the one with the least log loss there, the first of equals.

    Rows without p or y are not fitted on; both outcomes must occur.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    least, most = rows.agg(F.min(y), F.max(y)).first()
    if least == most:
        raise ValueError("calibration needs both outcomes")
    q = clipped(F.col(p))
    line, beta = [logit(F.col(p))], beta_features(F.col(p))
    out = df.withColumns({"logistic": clipped(apply_logistic(fit_logistic(rows, line, y, 40), line)), "beta": clipped(apply_logistic(fit_logistic(rows, beta, y, 40), beta)), "_q": q})
    knots = fit_isotonic(rows.withColumn("_q", q), "_q", y)
    out = apply_isotonic(out, knots, "_q").withColumn("isotonic", clipped(F.col("fitted"))).drop("fitted", "_q")
    loss = out.where(F.col(p).isNotNull() & F.col(y).isNotNull()).agg(*[log_loss(F.col(c), F.col(y).cast("double")).alias(c) for c in columns]).first().asDict()
    return out, min(columns, key=lambda c: loss[c])


def prior_rate(df: DataFrame, group: list[str], time: str, y: str, prior: float, strength: float) -> DataFrame:
    """df with prequential: the group's rate of outcomes strictly before the row's time, shrunk to a prior.

    Rows of one time see the same past; a row without a time sees none and is seen by none. Outcomes are added up by time first.
    """
    told = F.when(F.col(time).isNotNull(), F.col(y))
    times = df.groupBy(*group, time).agg(F.count(told).alias("n"), F.coalesce(F.sum(told).cast("double"), F.lit(0.0)).alias("s"))
    names = [f"_k{i}" for i in range(len(group) + 1)]
    past = past_sums(times, group, time, ["n", "s"]).toDF(*names, "_n", "_s")
    on = F.lit(True)
    for c, name in zip([*group, time], names, strict=True):
        on &= df[c].eqNullSafe(past[name])
    known = F.col(time).isNotNull()
    n, s = (F.when(known, F.col(c)).otherwise(0) for c in ("_n", "_s"))
    return df.join(past, on).select(*df.columns, ((s + prior * strength) / (n + strength)).alias("prequential"))


def choose(df: DataFrame, group: list[str], candidates: list[str], y: str) -> DataFrame:
    """group and choice: the candidate column with the least log loss, the first of equals."""
    scores = df.groupBy(*group).agg(*[log_loss(F.col(c), F.col(y)).alias(c) for c in candidates])
    ranked = F.array(*[F.struct(F.col(c).alias("loss"), F.lit(i).alias("place"), F.lit(c).alias("name")) for i, c in enumerate(candidates)])
    return scores.select(*group, F.array_min(ranked)["name"].alias("choice"))


def walk_forward(df: DataFrame, season: str) -> DataFrame:
    """fold, role and rows: each season but the first is scored once, with all earlier ones to fit on. A row occurs once for each fold, of which there are as many as seasons."""
    seasons = df.select(F.col(season).alias("fold")).distinct()
    first = seasons.agg(F.min("fold").alias("_first"))
    folds = seasons.crossJoin(F.broadcast(first)).where("fold > _first").drop("_first")
    return df.crossJoin(F.broadcast(folds)).where(F.col(season) <= F.col("fold")).withColumn("role", F.when(F.col(season) == F.col("fold"), "score").otherwise("fit"))


def fold_totals(df: DataFrame, season: str, values: list[str]) -> DataFrame:
    """fold, role, n and the sum and count of each value (sum_*, n_*): what `walk_forward` and an aggregate by fold and role give, without a copy of each row for each later season.

    Rows are added up by season once; seasons, which are few, then add up what was before them. Rows without a season are in no fold.
    """
    sums = [F.count("*").alias("n"), *[c for v in values for c in (F.coalesce(F.sum(v).cast("double"), F.lit(0.0)).alias(f"sum_{v}"), F.count(v).alias(f"n_{v}"))]]
    by = df.where(F.col(season).isNotNull()).groupBy(F.col(season).alias("fold")).agg(*sums)
    names = [c for c in by.columns if c != "fold"]
    past = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    roles = F.array(F.struct(F.lit("score").alias("role"), *names), F.struct(F.lit("fit").alias("role"), *[F.col(f"_{c}").alias(c) for c in names]))
    return by.withColumns({f"_{c}": F.sum(c).over(past) for c in names}).where("_n IS NOT NULL").select("fold", F.inline(roles))
