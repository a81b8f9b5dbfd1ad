"""Shards and the entropy tilt against plain loops over rows."""

import hashlib
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import shards as S, tilt as T

START = datetime(2021, 1, 1)
PROPS = ("receiving_yards", "receptions", "anytime_td")


def made(games, draws=12, k=2, seed=0):
    """draws (game, draw, features), outcomes and labels of games; what happens leans towards draws with a high first feature."""
    rng = np.random.default_rng(seed)
    rows, outcomes, labels = [], [], []
    for g in range(games):
        x = rng.standard_normal((draws, k))
        values = {"receiving_yards": np.floor(10 * x[:, 0] + 5 * rng.standard_normal(draws)).astype(int), "receptions": rng.integers(0, 5, draws), "anytime_td": (x[:, 0] + rng.standard_normal(draws) > 0).astype(int)}
        best = int(np.argmax(x[:, 0] + rng.standard_normal(draws)))
        rows += [(g, d, *map(float, x[d])) for d in range(draws)]
        for prop, v in values.items():
            outcomes += [(g, d, "p", prop, int(v[d])) for d in range(draws)]
            labels.append((g, "p", prop, float(v[best]) + (0.5 if prop == "receiving_yards" and g % 4 == 0 else 0.0)))
    return rows, outcomes, labels


def shards(spark, data, names=("a", "b")):
    rows, outcomes, labels = data
    out = S.compact(spark.createDataFrame(rows, "game long, draw int, a double, b double"), spark.createDataFrame(outcomes, "game long, draw int, player string, prop string, value long"), spark.createDataFrame(labels, "game long, player string, prop string, observed double"), "game", "draw", list(names))
    return out.withColumns({"as_of": F.lit(START) + F.expr("make_dt_interval(cast(game as int) * 10)"), "known": F.lit(START) + F.expr("make_dt_interval(cast(game as int) * 10 + 1)")})


def plain_scores(data, games, theta):
    """prop: scores, from rows."""
    rows, outcomes, labels = data
    out = {}
    for g in games:
        x = {r[1]: np.array(r[2:]) for r in rows if r[0] == g}
        e = {d: math.exp(float(theta @ v)) for d, v in x.items()}
        w = {d: v / sum(e.values()) for d, v in e.items()}
        for h, player, prop, y in labels:
            if h != g:
                continue
            drawn = {o[1]: o[4] for o in outcomes if o[0] == g and o[2:4] == (player, prop)}
            if prop == "anytime_td":
                p = min(max(sum(w[d] for d, v in drawn.items() if v >= 1), 1e-6), 1 - 1e-6)
                score = -(y * math.log(p) + (1 - y) * math.log(1 - p))
            else:
                score = sum(w[d] * abs(v - y) for d, v in drawn.items()) - 0.5 * sum(w[d] * w[c] * abs(v - u) for d, v in drawn.items() for c, u in drawn.items())
            out.setdefault(prop, []).append(score)
    return out


def plain_fit(data, games, ridge=T.RIDGE, k=2):
    base = {p: np.mean(v) for p, v in plain_scores(data, games, np.zeros(k)).items()}

    def loss(theta):
        return -np.mean([1 - np.mean(v) / base[p] for p, v in plain_scores(data, games, theta).items()]) + ridge * float(theta @ theta)

    theta, h, one = np.zeros(k), 1e-4, np.eye(k)
    for _ in range(12):
        slope = np.array([(loss(theta + h * a) - loss(theta - h * a)) / (2 * h) for a in one])
        curve = np.array([[(loss(theta + h * (a + b)) - loss(theta + h * (a - b)) - loss(theta - h * (a - b)) + loss(theta - h * (a + b))) / (4 * h * h) for b in one] for a in one])
        step = np.linalg.solve(curve, slope) if np.linalg.eigvalsh(curve)[0] > 1e-6 else slope
        while loss(theta - step) > loss(theta) and np.abs(step).max() > 1e-12:
            step = step / 2
        theta = theta - step
    return theta


def test_shards_hold_what_rows_hold(spark):
    data = made(5)
    got = shards(spark, data)
    for r in got.collect():
        assert np.allclose(r.features, [x[2:] for x in data[0] if x[0] == r.game])
        for label in r.labels:
            drawn = [o[4] for o in data[1] if o[0] == r.game and o[3] == label.prop]
            assert [label["values"][c] for c in label.codes] == drawn and label["values"] == sorted(set(drawn))
    assert S.checked(got, "game").count() == 5
    with pytest.raises(Exception, match="has changed"):
        S.checked(got.withColumn("n_draws", F.when(F.col("game") == 3, 11).otherwise(F.col("n_draws"))), "game").collect()
    with pytest.raises(Exception, match="lacks values"):
        shards(spark, (data[0], data[1][1:], data[2])).collect()


def test_rows_out_of_fold_equal_a_loop(spark):
    data = made(6)
    theta = np.array([0.7, -0.2])
    rows = S.scored(S.distributions(shards(spark, data), "game", {"raw": [0.0, 0.0], "tilted": theta.tolist()}), "game").collect()
    assert len(rows) == 36
    for variant, t in (("raw", np.zeros(2)), ("tilted", theta)):
        want = {(g, p): v for g in range(6) for p, (v,) in plain_scores(data, [g], t).items()}
        for r in rows:
            if r.variant == variant:
                assert math.isclose(r.log_loss if r.prop == "anytime_td" else r.crps, want[r.game, r.prop], abs_tol=1e-9)
    for r in rows:
        u = (int(hashlib.sha256(f"pit-u/v1|{r.game}|p|{r.prop}".encode()).hexdigest()[:16], 16) + 0.5) / 2**64
        assert math.isclose(r.pit, sum(x.p for x in r.pmf if x.outcome < r.observed) + u * sum(x.p for x in r.pmf if x.outcome == r.observed), abs_tol=1e-9)
        cdf = np.cumsum([x.p for x in r.pmf])
        for name, q in S.QUANTILES.items():
            assert r[name] == r.pmf[int(np.argmax(cdf >= q - 1e-12))].outcome
    report = {r.variant: r for r in S.summary(S.scored(S.distributions(shards(spark, data), "game", {"raw": [0.0, 0.0]}), "game"), [[]]).collect()}["raw"]
    assert report.n_rows == 18 and report.n_binary == 6 and math.isclose(report.mean_crps, np.mean([r.crps for r in rows if r.variant == "raw" and r.crps is not None]))


def test_fits_of_all_folds_equal_plain_fits(spark, monkeypatch):
    data = made(16)
    passes, evaluated = [], T.evaluated
    monkeypatch.setattr(T, "evaluated", lambda *a: passes.append(1) or evaluated(*a))
    day = lambda n: START + timedelta(days=n)
    folds = [T.Fold("one", START, day(75), day(80), day(105)), T.Fold("two", START, day(115), day(120), day(160))]
    out, fits = T.walk_forward(shards(spark, data), folds, "game", "as_of", "known")
    assert len(passes) <= T.ROUNDS + 2
    for name, games, score in (("one", range(8), range(8, 11)), ("two", range(12), range(12, 16))):
        want = plain_fit(data, games)
        assert fits[name].converged and np.abs(fits[name].theta - want).max() < 1e-5, (fits[name], want)
        assert fits[name].theta[0] > 0
        mine, base = plain_scores(data, score, fits[name].theta), plain_scores(data, score, np.zeros(2))
        for r in out.where(F.col("fold") == name).collect():
            assert r.n == len(score) and math.isclose(r.score, np.mean(mine[r.prop])) and math.isclose(r.baseline, np.mean(base[r.prop]))


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((9, 3))
    codes = rng.integers(0, 4, 9)
    values = np.array([-2, 0, 1, 5])
    values = values[np.unique(codes)]
    codes = np.unique(codes, return_inverse=True)[1]
    for prop, y in (("receptions", 0.5), ("receptions", -9.0), ("receptions", 9.0), ("anytime_td", 1.0), ("anytime_td", 0.0)):
        label, theta = [("p", prop, y, values, codes)], rng.standard_normal(3)
        (_, _, slope), = T.game_scores(x, label, theta)
        for i in range(3):
            h = 1e-6 * np.eye(3)[i]
            up, down = (next(T.game_scores(x, label, t))[1] for t in (theta + h, theta - h))
            assert abs((up - down) / 2e-6 - slope[i]) < 1e-5


def test_what_walk_forward_refuses(spark):
    day = lambda n: START + timedelta(days=n)
    data = shards(spark, made(4))
    ok = T.Fold("a", START, day(15), day(16), day(40))
    for folds in ([], [ok, ok], [T.Fold("a", START, day(5), day(4), day(9))], [ok, T.Fold("b", START, day(20), day(30), day(50))], [ok, T.Fold("b", day(1), day(45), day(50), day(60))]):
        with pytest.raises(ValueError):
            T.checked_folds(folds)
    with pytest.raises(ValueError, match="to fit on"):
        T.walk_forward(data, [T.Fold("a", START - timedelta(days=9), START - timedelta(days=5), START, day(40))], "game", "as_of", "known")
    with pytest.raises(ValueError, match="to score"):
        T.walk_forward(data, [T.Fold("a", START, day(40), day(41), day(60))], "game", "as_of", "known")
