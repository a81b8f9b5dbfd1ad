"""What the findings of round 3 were about: each of these failed before its finding was settled."""

import os
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from tidemark.operators import manifests as M, publication as P, shards as S, tilt as T
from tidemark.operators.stats import LADDERS, NATIVE, long_form, pmf, stat_pmf
from tidemark.plans import ORACLE_SQL, QUERIES
from tidemark.plans.stats import LONG


def shuffled(spark, work):
    """Bytes that the stages of some work wrote for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = total()
    work()
    return sum(v for k, v in total().items() if k not in before)


def beside(sf, at, **tables):
    """A folder with the tables of sf, of which some are replaced."""
    for name in os.listdir(sf):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(f"{sf}/{name}", f"{at}/{name}")
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_fingerprints_move_rows_and_not_sums_of_all_scopes(spark):
    """18 sums went through four shuffles for every row."""
    rows = spark.range(40_000).select((F.col("id") % 40).alias("k"), (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(hours=(F.col("id") % 9973).cast("int"))).cast("timestamp_ntz").alias("t"), "id")
    asked = spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(days=90 * i)) for k in range(40) for i in range(3)], "k long, at timestamp_ntz")
    scopes = {f"s{i}": F.col("id") % (i + 2) == 0 for i in range(9)}
    found = []
    moved = shuffled(spark, lambda: found.extend(M.fingerprints(rows, ["k"], "t", scopes, ["id"], asked, "at").collect()))
    assert moved < 120 * 40_000, moved
    r = next(r for r in found if r.k == 7 and r.at == datetime(2024, 1, 1) + timedelta(days=180))
    assert r.s3.n_rows == sum(i % 9973 <= 180 * 24 and i % 5 == 0 for i in range(7, 40_000, 40))


def test_chains_of_ids_end_in_new_ids_beyond_a_hundred_thousand_parts(spark, sf, tmp_path):
    """the new ids were parts themselves, so the chains went round."""
    at = beside(sf, tmp_path, part=spark.range(120_000).select(F.col("id").alias("p_partkey")))
    compare(QUERIES["followed_ids"](spark, at), connect(at), ORACLE_SQL["followed_ids"])


def test_scores_of_a_block_of_games_are_those_of_each_game_and_take_no_loop_over_games():
    """every pass made a dozen small arrays for each label of each game, theta and fold; 400 games took as many calls."""
    rng = np.random.default_rng(5)
    games = [(rng.standard_normal((6, 2)), [("p", prop, float(rng.integers(0, 3)), *np.unique(rng.integers(0, 3, 6), return_inverse=True)) for prop in ("receptions", "anytime_td")]) for _ in range(400)]
    label = lambda v: {"player": v[0], "prop": v[1], "observed": v[2], "values": v[3].tolist(), "codes": v[4].tolist()}
    kind = pa.list_(pa.struct([("player", pa.string()), ("prop", pa.string()), ("observed", pa.float64()), ("values", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist() for x, _ in games]), pa.array([6] * 400), pa.array([[label(v) for v in own] for _, own in games], kind)], names=["flat", "n_draws", "labels"])
    (_, block), = S.blocks(batch)
    theta = np.array([0.4, -0.7])
    score, slope = T.block_scores(block, theta)
    each = [g for x, own in games for g in T.game_scores(x, own, theta)]
    assert np.allclose(score, [g[1] for g in each]) and np.allclose(slope, [g[2] for g in each])


def test_catalog_rounds_half_a_unit_up_in_whatever_order_shares_are_added(spark, sf):
    """F4 to F7: sums of shares fell on either side of half a unit of the sixth decimal."""
    halves = connect(sf).execute(f"WITH {LONG}, e AS ({' UNION ALL '.join(f'SELECT {k!r} AS stat, unnest({v}) AS threshold' for k, v in LADDERS.items())}) SELECT l_suppkey, stat, threshold, count(*), sum((value >= threshold)::INT)::BIGINT FROM x JOIN e USING (stat) GROUP BY 1, 2, 3").fetchall()
    want = {(k, s, t): (2 * hit * 10**6 + n) // (2 * n) / 10**6 for k, s, t, n, hit in halves}
    got = {(r.l_suppkey, r.stat, r.threshold): r.p_hit for r in QUERIES["catalog_thresholds"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("many", [100_000, 10])
def test_distributions_of_statistics_move_draws_and_not_rows_of_statistics(spark, many):
    """F8 to F10: 31 rows of a name and a value went through the shuffle for each draw."""
    draws = spark.range(20_000).select((F.col("id") % 60).alias("k"), *[(F.xxhash64("id", F.lit(s)) % 400).alias(s) for s in NATIVE])
    out = {}
    moved = shuffled(spark, lambda: out.update({(r.k, r.stat, r.outcome): r.p for r in stat_pmf(draws, ["k"], list(NATIVE), many).collect()}))
    want = {(r.k, r.stat, r.outcome): r.p for r in pmf(long_form(draws, ["k"], list(NATIVE)).withColumnRenamed("value", "v"), ["k", "stat"], "v").collect()}
    assert out == pytest.approx(want) and (many == 10 or moved < 100 * 20_000), moved


def test_documents_of_many_runs_are_few_files_and_a_run_replaces_itself_only(spark, tmp_path):
    """every run had a folder and a file of its own."""
    at, now = f"{tmp_path}/d", datetime(2024, 1, 1, 12)
    quotes = lambda n, edge: spark.range(n).select(F.col("id").cast("string").alias("run"), F.col("id").cast("string").alias("opportunity_id"), *[F.lit(c).alias(c) for c in ("player", "team", "prop", "book")], F.lit("YES").alias("pick"), F.lit(None).cast("double").alias("line"), *[F.lit(edge).alias(c) for c in ("model_probability", "edge", "projection")], *[F.lit(100).alias(c) for c in ("fair_odds", "book_odds")], F.lit(datetime(2024, 1, 1, 9)).alias("updated_at"))
    runs = lambda n: spark.range(n).select(F.col("id").cast("string").alias("run"), F.col("id").alias("game"), F.lit(datetime(2024, 1, 1, 11)).alias("generated_at"), F.lit(datetime(2024, 1, 1, 15)).alias("expires_at"))
    for n, edge in ((200, 0.25), (3, 0.5)):
        P.write_documents(P.documents(quotes(n, edge), runs(n)), at)
    assert sum(f.endswith(".txt") for _, _, files in os.walk(at) for f in files) <= 20
    read = {r.run: r for r in P.read_documents(spark, at, F.lit(now), "6 HOURS").collect()}
    assert len(read) == 200 and {r.fault for r in read.values()} == {None}
    assert {run for run, r in read.items() if r.rows[0].edge == 0.5} == {"0", "1", "2"}
