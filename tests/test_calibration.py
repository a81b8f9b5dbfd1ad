"""Isotonic maps merged in tasks, the choice of a calibrator, and prequential calibration, each against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration as C, distributions as D
from tidemark.operators.prequential import calibrated, newton, prequential


def isotonic(pairs):
    """Knots of a plain pooling of adjacent violators."""
    each = {}
    for p, y in pairs:
        s, n = each.get(p, (0, 0))
        each[p] = (s + y, n + 1)
    p = np.array(sorted(each))
    blocks = C.pooled(p, np.array([each[x][0] for x in p.tolist()], float), np.array([each[x][1] for x in p.tolist()], float))
    return {x: s / n for low, high, s, n in blocks for x in (low, high)}


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_equals_plain_pooling(spark, seed):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(1500) ** 2, [2, 3, 4, 4][seed])
    y = (rng.random(1500) < [0.5, p, 1 - p, p][seed]).astype(float) if seed < 3 else rng.standard_normal(1500) + 3 * p
    df = spark.createDataFrame([*zip(p.tolist(), y.tolist(), strict=True), (None, 1.0), (float("nan"), 1.0), (0.5, None)], "p double, y double")
    knots = C.fit_isotonic(df, "p", "y")
    got, want = {r.knot: r.fitted for r in knots.collect()}, isotonic(zip(p.tolist(), y.tolist(), strict=True))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    asked = spark.createDataFrame([(float(x),) for x in np.linspace(-0.2, 1.2, 57)] * 2 + [(None,), (float("nan"),)], "p double")
    out = [(r.p, r.fitted) for r in C.apply_isotonic(asked, knots, "p").collect()]
    x = sorted(want)
    assert len(out) == 116 and sum(v is None for _, v in out) == 2
    for q, v in out:
        if v is not None:
            assert math.isclose(v, float(np.interp(q, x, [want[k] for k in x])), abs_tol=1e-9)


def test_isotonic_of_nothing_one_value_and_one_hot_value(spark):
    none = spark.createDataFrame([], "p double, y double")
    assert C.fit_isotonic(none, "p", "y").count() == 0
    assert [r.fitted for r in C.apply_isotonic(spark.createDataFrame([(0.3,)], "p double"), C.fit_isotonic(none, "p", "y"), "p").collect()] == [None]
    hot = spark.createDataFrame([(0.5, float(i % 2)) for i in range(900)] + [(0.1, 1.0), (0.9, 0.0)], "p double, y double")
    assert {(r.knot, round(r.fitted, 9)) for r in C.fit_isotonic(hot, "p", "y").collect()} == {(0.1, 0.5), (0.9, round(450 / 901, 9))} or {round(r.fitted, 6) for r in C.fit_isotonic(hot, "p", "y").collect()} == {round(451 / 902, 6)}


def test_sums_over_the_past_with_null_groups(spark):
    rows = [(g, t, float(t % 3)) for g in ("a", None) for t in range(40)] + [("b", 7, 1.0)]
    df = spark.createDataFrame(rows, "g string, t long, v double")
    got = {(r.g, r.t): r.v for r in D.past_sums(df, ["g"], "t", ["v"]).collect()}
    assert got == {(g, t): sum(v for h, u, v in rows if h == g and u < t) for g, t, _ in rows}


def test_calibrator_choice_equals_plain_fits(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.uniform(0.02, 0.98, 600), 3)
    y = (rng.random(600) < p**2).astype(float)
    df = spark.createDataFrame(list(zip(p.tolist(), y.tolist(), strict=True)), "p double, y double")
    out, name = C.choose_calibrator(df, "p", "y")
    rows = out.collect()
    loss = {}
    for m in C.METHODS:
        want = dict(zip(p.tolist(), calibrated(*counted(p, y), p, m).tolist(), strict=True))
        assert all(abs(r[m] - want[r.p]) < 1e-5 for r in rows), m
        loss[m] = -np.mean([r.y * math.log(r[m]) + (1 - r.y) * math.log(1 - r[m]) for r in rows])
    assert name == min(C.METHODS, key=loss.get)
    with pytest.raises(ValueError, match="both outcomes"):
        C.choose_calibrator(df.where("y = 1"), "p", "y")


def counted(p, y):
    x, at = np.unique(p, return_inverse=True)
    return x, np.bincount(at, y), np.bincount(at).astype(float)


def test_newton_finds_the_least_loss():
    rng = np.random.default_rng(6)
    x, n = rng.standard_normal((50, 2)), rng.integers(1, 9, 50).astype(float)
    s = np.floor(n * rng.random(50))
    w = newton(x, s, n)
    a = np.column_stack([np.ones(50), x])
    slope = a.T @ (n / (1 + np.exp(-a @ w)) - s)
    assert np.abs(slope).max() < 1e-4
    assert np.isfinite(newton(np.linspace(-1, 1, 20)[:, None], (np.arange(20) > 9).astype(float), np.ones(20))).all()  # outcomes that p separates


def loop(rows, levels, least, methods):
    """The same by a loop over times of asking. rows: id, prop, position, p, y, asked, known."""
    out = {r[0]: (r[3], "identity", "IDENTITY", "identity", -1, 0, 0) for r in rows}
    pending = {}
    for t in sorted({r[5] for r in rows}):
        now = [r for r in rows if r[5] == t]
        fits = {}
        for depth, (level, c) in enumerate(levels.items()):
            for value in {"GLOBAL" if c is None else r[c] for r in now} - {None, ""}:
                inside = lambda r: c is None or r[c] == value  # noqa: B023, E731
                past = [r for r in rows if r[6] < t and inside(r)]
                if len(past) < least or len({r[4] for r in past}) < 2:
                    continue
                own = [r for r in now if inside(r)]
                p, y = np.array([r[3] for r in past]), np.array([r[4] for r in past], float)
                values = {m: calibrated(*counted(p, y), np.array([r[3] for r in own]), m) for m in methods}
                old = [x for x in pending.get((level, value), []) if x[0] < t]
                method = None
                if len(old) >= least and len({x[1] for x in old}) == 2:
                    loss = {m: sum(-math.log(x[2][m] if x[1] else 1 - x[2][m]) for x in old) for m in methods}
                    method = min(methods, key=lambda m: loss[m])
                fits[level, value] = (depth, own, values, method, len(past), len(old))
        for (level, value), (depth, own, values, method, n, k) in sorted(fits.items(), key=lambda f: f[1][0]):
            for i, r in enumerate(own):
                if method and out[r[0]][1] == "identity":
                    out[r[0]] = (float(values[method][i]), level, str(value), method, depth, n, k)
        for key, (_, own, values, _, _, _) in fits.items():
            pending.setdefault(key, []).extend((r[6], r[4], {m: float(values[m][i]) for m in methods}) for i, r in enumerate(own))
    return out


@pytest.mark.parametrize("ranges", [3, 64])
def test_prequential_equals_a_loop(spark, monkeypatch, ranges):
    rng = np.random.default_rng(ranges)
    rows = []
    for i in range(500):
        p = round(float(rng.uniform(0, 1)), 2)
        asked = int(rng.integers(0, 12)) * 10
        rows.append((i, ["x", "y", "z"][int(rng.integers(0, 3))], ["A", "B", None, ""][int(rng.integers(0, 4))], p, int(rng.random() < p * p), asked, asked + int(rng.integers(1, 40))))
    rows.append((500, "rare", "A", 0.4, 1, 110, 115))
    df = spark.createDataFrame(rows, "id long, prop string, position string, p double, y int, asked long, known long")
    methods = ("logistic", "beta", "isotonic")
    got = prequential(df, ["id"], {"prop": "prop", "position": "position", "global": None}, "p", "y", "asked", "known", 30, methods)
    want = loop(rows, {"prop": 1, "position": 2, "global": None}, 30, methods)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        w = want[r.id]
        assert (r.calibration_level, r.calibration_group, r.calibration_method, r.calibration_fallback_depth, r.fit_rows, r.selection_rows) == w[1:], (r, w)
        assert abs(r.p_calibrated - w[0]) < 1e-6
    assert {r.calibration_level for r in found} == {"identity", "prop", "position", "global"}


def test_prequential_refuses_what_it_cannot_use(spark):
    kind = "id long, g string, p double, y int, asked long, known long"
    for row in [(1, "a", None, 1, 0, 1), (1, "a", 1.5, 1, 0, 1), (1, "a", 0.5, 2, 0, 1), (1, "a", 0.5, 1, None, 1), (1, "a", 0.5, 1, 0, None)]:
        with pytest.raises(ValueError, match="cannot be used"):
            prequential(spark.createDataFrame([row], kind), ["id"], {"g": "g"}, "p", "y", "asked", "known")
    twice = spark.createDataFrame([(1, "a", 0.5, 1, 0, 1)] * 2, kind)
    with pytest.raises(ValueError, match="repeat"):
        prequential(twice, ["id"], {"g": "g"}, "p", "y", "asked", "known")
    assert prequential(spark.createDataFrame([], kind), ["id"], {"g": "g", "all": None}, "p", "y", "asked", "known").count() == 0


def test_rates_of_the_past_keep_rows_with_nulls(spark):
    from tidemark.operators import gates as G

    rows = [(i, ["a", None][i % 2], [i // 2, None][i % 5 == 0], float(i % 3 == 0)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, g string, t long, y double")
    got = G.fallback_rate(df, [["g"], []], "t", "y", 4).collect()
    assert len(got) == 30
    for r in got:
        own = [y for _, g, t, y in rows if g == r.g and r.t is not None and t is not None and t < r.t]
        assert r.level is None or r.t is not None
        if r.level == 0:
            assert math.isclose(r.rate, sum(own) / len(own)) and len(own) >= 4
    assert C.prior_rate(df, ["g"], "t", "y", 0.25, 10.0).count() == 30
