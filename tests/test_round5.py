"""Searches and fits whose driver and passes must not grow with the input, and the same results as before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tilt import START, made, shards
from tidemark.llm import multi_index as I
from tidemark.operators import distributions as D, shards as S, tilt as T


def test_what_queries_are_routed_with_is_never_broadcast(spark, monkeypatch):
    plans, stage = {}, I.stage

    def seen(df, name):
        out = stage(df, name)
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(I, "stage", seen)
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 8)))], "vec_id long, embedding array<double>")
    assert I.multi_index(rows).count() == 40
    assert "SortMergeJoin" in plans["nearest"] and "Broadcast" not in plans["nearest"]


def test_vectors_of_least_hash_are_those_of_a_whole_sort(spark, monkeypatch):
    rows = spark.createDataFrame([([float(i % 97), float(i)],) for i in range(3000)], "vec array<double>").repartition(7)
    whole = [r.vec for r in rows.orderBy(F.xxhash64("vec"), "vec").collect()]
    for most in (1, 500, 3000, 9000):
        assert I._least(rows, most).tolist() == whole[:most]
    monkeypatch.setattr(I, "BITS", 1)
    assert I._least(rows, 500).tolist() == whole[:500]


def test_a_walk_in_runs_takes_what_a_sort_of_all_cells_takes():
    rng = np.random.default_rng(6)
    for n, decimals in ((7, 9), (40, 1), (64, 9)):
        held = rng.permutation(n * n)[: n * n * 2 // 3]
        cells = I.Cells(held, rng.integers(1, 9, len(held)), n)
        left, right = np.round(rng.random(n), decimals), np.round(rng.random(n), decimals)
        order = np.lexsort((cells.id, left[cells.id // n] + right[cells.id % n]))
        for enough in (0, 1, int(0.5 * cells.size.sum()), 10**9):
            short = np.cumsum(cells.size[order]) - cells.size[order] < enough
            assert I.cells_in_order(left, right, cells, enough).tolist() == order[short].tolist()


def test_a_pass_of_the_tilt_scores_a_game_under_the_thetas_of_its_own_folds_alone(spark, monkeypatch):
    """each game met four step lengths of every fold, also of those that don't count it."""
    data = shards(spark, made(16, seed=4))
    day = lambda n: F.lit(START) + F.expr(f"make_dt_interval({n})")
    folds = F.filter(F.array(F.when(F.col("as_of") < day(50), "one"), F.when(F.col("as_of") >= day(30), "two")), lambda f: f.isNotNull())
    rows = S.packed(data.withColumn("folds", folds), "game", "folds")
    met = spark.sparkContext.accumulator(0)
    sums = T.block_sums

    def counted(block, theta):
        met.add(len(block.draws))
        return sums(block, theta)

    monkeypatch.setattr(T, "block_sums", counted)
    thetas = {"one": [np.array([0.3, -0.1])], "two": [np.array([0.2, 0.5]), np.zeros(2)]}
    for together in (T.TOGETHER, 30):  # all games at once, and a few draws at a time
        monkeypatch.setattr(T, "TOGETHER", together)
        before = met.value
        found = T.evaluated(rows, "folds", thetas)
        assert met.value - before == 5 + 2 * 13
        plain = {g: r for r in data.collect() for g in (r.game,)}
        for name, games in (("one", range(5)), ("two", range(3, 16))):
            for i, theta in enumerate(thetas[name]):
                each = [x for g in games for x in T.game_scores(np.array(plain[g].features), [(v.player, v.prop, v.observed, np.array(v["values"]), np.array(v.codes)) for v in plain[g].labels], theta)]
                for prop in {x[0] for x in each}:
                    n, score, slope = found[name, i, prop]
                    assert n == len(games) and np.isclose(score, sum(x[1] for x in each if x[0] == prop)) and np.allclose(slope, sum(x[2] for x in each if x[0] == prop))


def test_a_fit_tries_shorter_steps_only_where_the_full_one_fails(spark, monkeypatch):
    seen, evaluated = [], T.evaluated

    def counted(rows, folds, thetas):
        seen.append([len(v) for v in thetas.values()])
        return evaluated(rows, folds, thetas)

    monkeypatch.setattr(T, "evaluated", counted)
    rows = S.packed(shards(spark, made(16)).withColumn("folds", F.array(F.lit("one"))), "game", "folds").cache()
    fit = T.fit(rows, "folds", ["one"])["one"]
    assert fit.converged and len(seen) == 1 + fit.rounds + sum(x == [3] for x in seen) and max(x[0] for x in seen) <= 3
    assert T.fit(rows, "folds", ["one"], rounds=2)["one"].rounds == 2


def test_shards_of_wide_draws_are_those_of_long_outcomes(spark):
    rows, outcomes, labels = made(7, seed=9)
    value = {(g, d, p): v for g, d, _, p, v in outcomes}
    seen = {(g, p): y for g, _, p, y in labels}
    props = {"receiving_yards": "ry", "receptions": "rc", "anytime_td": "td"}
    wide = spark.createDataFrame([(*r, *(value[r[0], r[1], p] for p in props), *(seen[r[0], p] for p in props)) for r in rows], "game long, draw int, a double, b double, ry long, rc long, td long, yry double, yrc double, ytd double")
    top = F.first(F.struct(*[F.col(f"y{c}").alias(c) for c in props.values()]))
    got = S.compact_wide(wide, "game", "draw", ["a", "b"], F.lit("p"), props, top)
    want = shards(spark, (rows, outcomes, labels)).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect())
    with pytest.raises(Exception, match="lacks values"):
        S.compact_wide(wide.withColumn("rc", F.when(F.col("draw") != 3, F.col("rc"))), "game", "draw", ["a", "b"], F.lit("p"), props, top).collect()


def test_z_scores_of_several_columns_are_those_of_each(spark):
    rows = spark.range(60).select((F.col("id") % 5).alias("g"), (F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 == 1, 3.0).otherwise(F.sqrt("id")).alias("b"))
    for r in D.z_scores_of(D.z_scores(D.z_scores(rows, ["g"], "a").withColumnRenamed("z", "wa"), ["g"], "b").withColumnRenamed("z", "wb"), ["g"], ["a", "b"]).collect():
        assert (r.za, r.zb) == (r.wa, r.wb)
