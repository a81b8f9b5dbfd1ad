"""Work that must not grow faster than the input, and the same results as before."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates as G, prequential as Q, shards as S


def _lines(spark, n: int):
    i = F.col("id")
    return spark.range(n).select("id", F.when(i % 3 > 0, (i % 3).cast("string")).alias("g"), (i % 7 / 7.0).alias("p"), (i % 5 > 1).cast("int").alias("y"), (F.floor(i / 3) % 6 * 10).alias("asked"), (F.floor(i / 3) % 6 * 10 + i % 4).alias("known"))


def test_copies_of_rows_add_no_work_to_prequential_fits(spark, monkeypatch):
    seen, events = [], Q._events

    def counted(each):
        seen.append(each.count())
        return events(each)

    monkeypatch.setattr(Q, "_events", counted)
    rows, args = _lines(spark, 2100), (["id"], {"g": "g", "all": None}, "p", "y", "asked", "known", 20)
    copies = rows.crossJoin(spark.range(5).toDF("copy")).select((F.col("id") * 5 + F.col("copy")).alias("id"), *rows.columns[1:])
    results = [Q.prequential(df, *args) for df in (rows, copies)]
    assert seen[0] == seen[1] < 2100
    assert results[0].count() == 2100 and results[1].count() == 10500
    # rows that agree in what counts have one answer, and rows meet it without a shuffle
    assert results[1].groupBy("g", "p", "asked").agg(F.countDistinct(F.struct("p_calibrated", "calibration_group")).alias("n")).where("n > 1").count() == 0
    assert " Exchange hashpartitioning" not in results[1]._jdf.queryExecution().executedPlan().toString()
    assert {r[0] for r in results[1].select("calibration_level").distinct().collect()} >= {"g", "all", "identity"}


def test_prequential_answers_that_are_many_are_joined_alike(spark, monkeypatch):
    rows, args = _lines(spark, 600), (["id"], {"g": "g", "all": None}, "p", "y", "asked", "known", 20)
    few = Q.prequential(rows, *args).collect()
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 0)
    many = Q.prequential(rows, *args).collect()
    assert sorted(few, key=lambda r: r.id) == sorted(many, key=lambda r: r.id)


def test_a_repeated_key_with_nulls_is_told_from_an_equal_hash(spark):
    kind = "a long, b long, g string, p double, y int, asked long, known long"
    rest = ("x", 0.5, 1, 0, 1)
    # hashes of (null, 1) and (1, null) are equal, the keys are not
    assert Q.prequential(spark.createDataFrame([(None, 1, *rest), (1, None, *rest)], kind), ["a", "b"], {"g": "g"}, "p", "y", "asked", "known").count() == 2
    with pytest.raises(ValueError, match="repeat"):
        Q.prequential(spark.createDataFrame([(None, 1, *rest)] * 2, kind), ["a", "b"], {"g": "g"}, "p", "y", "asked", "known")


def _figures_by_loop(pmf, y):
    out = {"model_mean": sum(p * x for x, p in pmf), "p_zero": sum(p for x, p in pmf if x == 0), "_hit": sum(p for x, p in pmf if x >= 1)}
    out["model_variance"] = sum(p * (x - out["model_mean"]) ** 2 for x, p in pmf)
    out |= {"_below": sum(p for x, p in pmf if y is not None and x < y), "_at": sum(p for x, p in pmf if x == y), "support_min": pmf[0][0] if pmf else None, "support_max": pmf[-1][0] if pmf else None}
    steps = [(x, sum(p for _, p in pmf[: i + 1])) for i, (x, _) in enumerate(pmf)]
    for name, level in S.QUANTILES.items():
        out[name] = next((x for x, c in steps if c >= level - 1e-12), None)
    if pmf and y is not None:
        inside = sum(c * c * (min(max(y, x), z) - x) + (1 - c) ** 2 * (z - min(max(y, x), z)) for (x, c), (z, _) in zip(steps, steps[1:], strict=False))
        out["_crps"] = inside + max(pmf[0][0] - y, 0) + max(y - pmf[-1][0], 0)
    return out


def test_figures_of_flat_distributions_equal_a_loop(monkeypatch):
    monkeypatch.setattr(S, "PADDED", 50)
    rng = np.random.default_rng(4)
    pmfs = [[(3, 1.0)], [], [(0, 0.25), (1, 0.75)], [(-2, 0.5), (0, 0.25), (7, 0.25)]]
    for n in rng.integers(1, 90, 40).tolist():
        w = rng.random(n)
        pmfs.append(list(zip(np.sort(rng.choice(200, n, replace=False)).tolist(), (w / w.sum()).tolist(), strict=True)))
    actual = [None if i % 9 == 8 else float(rng.integers(-5, 210)) if i % 2 else 3.0 for i in range(len(pmfs))]
    got = S._figures(np.array([len(m) for m in pmfs]), np.array([x for m in pmfs for x, _ in m]), np.array([p for m in pmfs for _, p in m]), pa.array(actual, pa.float64()))
    assert list(got) == list(S.FIGURES)
    for i, (pmf, y) in enumerate(zip(pmfs, actual, strict=True)):
        for name, want in _figures_by_loop(pmf, y).items():
            value = got[name][i].as_py()
            assert value == want if want is None or isinstance(want, int) and name[0] in "sp" and name != "p_zero" else math.isclose(value, want, abs_tol=1e-9), (name, pmf, y)


def _shards(spark, labels):
    draws = spark.createDataFrame([(g, d, float(d * g % 3)) for g in range(6) for d in range(8)], "game long, draw int, a double")
    outcomes = draws.select("game", "draw", F.inline(F.array(*[F.struct(F.lit("x").alias("player"), F.lit(p).alias("prop"), (F.col("draw") * k % 5).alias("value")) for k, p in ((2, "yards"), (3, "anytime_td"), (1, "unlabelled"))])))
    return S.compact(draws, outcomes, spark.createDataFrame(labels, "game long, player string, prop string, observed double"), "game", "draw", ["a"])


def test_scores_in_one_pass_are_those_of_the_distributions(spark):
    shards = _shards(spark, [(g, "x", p, None if g == 5 else float(g)) for g in range(6) for p in ("yards", "anytime_td")])
    thetas = {"raw": [0.0], "tilted": [0.7]}
    one = S.scored_distributions(shards, "game", thetas)
    two = S.scored(S.distributions(shards, "game", thetas), "game")
    assert one.columns == [c for c in two.columns if c != "pmf"]
    by = lambda df: sorted(df.select(*one.columns).collect(), key=lambda r: (r.variant, r.game, r.prop))
    assert by(one) == by(two) and one.count() == 24
    # one row a label goes through the shuffle that labels are joined in, not one a draw
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("collect_list(struct(d")


def test_a_label_that_is_there_twice_is_an_error(spark):
    with pytest.raises(Exception, match="there twice"):
        _shards(spark, [(1, "x", "yards", 2.0)] * 2).collect()
    assert len(_shards(spark, [(1, "x", "yards", 2.0), (1, "x", "yards", 3.0)]).first().labels) == 2


def test_tables_joined_one_to_one_are_shuffled_once(spark):
    left, right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a")), spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 3).alias("b"))
    out = G.joined_one_to_one(left, right, ["k"], at_once=False)
    assert out.columns == ["k", "a", "b"]
    assert sorted(map(tuple, out.collect())) == [(i, 2 * i, 3 * i) for i in range(50)]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
    null = spark.createDataFrame([(None, 1)], "k long, b long")
    for l, r in ((left, right.where("k > 0")), (left.where("k > 0"), right), (left.union(left.limit(1)), right), (left, right.union(right.limit(1))), (left.union(null), right), (left.union(null), right.union(null))):
        with pytest.raises(Exception, match="exactly once"):
            G.joined_one_to_one(l, r, ["k"], at_once=False).count()


def test_wide_rows_meet_time_and_position_in_one_join(spark):
    settled = spark.range(20).select(F.col("id").cast("string").alias("prediction_id"), (F.col("id") % 4).alias("game_id"), (F.col("id") % 5).alias("player_id"), F.lit("x" * 50).alias("wide"))
    known = settled.select("game_id", "player_id", F.lit(9).alias("outcome_available_at"))
    where = spark.range(5).select(F.col("id").alias("player_id"), F.lit("QB").alias("position_group"))
    out = G.scoreable(settled, known, where, "game_id", "player_id")
    assert out.count() == 20 and out.columns == ["player_id", "game_id", "prediction_id", "wide", "outcome_available_at", "position_group"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "LeftOuter" in line)
    assert plan.count("LeftOuter") == 2 and "game_id" in top
