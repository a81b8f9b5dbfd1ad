"""Cases that the shared tables do not have: nulls, ties, empty tables, repeated batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import odds, text
from tidemark.operators import calibration, distributions, pit, products, quality
from tidemark.plans import QUERIES
from tidemark.sources import raw, tables
from tidemark.streaming import snapshots


def test_versions_are_appended_once(spark):
    schema = "k long, v string, seen int"
    stored = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "n", 1)], schema)
    batch = spark.createDataFrame([(1, "b", 3), (2, "c", 3), (None, "n", 3), (None, None, 3)], schema)
    got = {(r.k, r.v) for r in tables.append_versions(stored, batch, ["k"], ["v"], "seen").collect()}
    assert got == {(2, "c"), (None, None)}
    again = tables.append_versions(tables.union_wide(stored, batch.where("v IS NOT NULL")), batch.where("v IS NOT NULL"), ["k"], ["v"], "seen")
    assert again.count() == 0


def test_upsert_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(None, "x", 1), (1, "x", 1)], "k long, j string, v int")
    b = spark.createDataFrame([(None, "x", 2), (2, None, 2)], "k long, j string, v int")
    assert {(r.k, r.v) for r in tables.upsert(a, b, ["k", "j"]).collect()} == {(None, 2), (1, 1), (2, 2)}
    assert {(r.k, r.v) for r in tables.upsert(a, b, ["k", "j"], keep="first").collect()} == {(None, 1), (1, 1), (2, 2)}


def test_streamed_store_keeps_versions(spark, tmp_path):
    schema = "k long, v string, seen long"
    for i, rows in enumerate([[(1, "a", 1), (2, "a", 1)], [(1, "b", 2), (2, "a", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        snapshots.keep_versions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/check", ["k"], ["v"], "seen")
        got = sorted((r.k, r.v) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/store").collect())
        assert got == [[(1, "a"), (2, "a")], [(1, "a"), (1, "b"), (2, "a")]][i]


def test_stream_drops_repeated_keys(spark, tmp_path):
    schema = "k long, ts timestamp, v double"
    rows = spark.sql("SELECT id % 5 AS k, TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts, 1.0D AS v FROM range(20)")
    rows.write.parquet(f"{tmp_path}/in")
    snapshots.run_available(snapshots.stream(spark, f"{tmp_path}/in", schema, "ts", ["k"]), f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.schema(schema).parquet(f"{tmp_path}/out").count() == 5


def test_odds(spark):
    r = spark.range(1).select(*[c.alias(n) for n, c in {"a": odds.implied(F.lit(-150)), "b": odds.implied(F.lit(0)), "c": odds.american(F.lit(0.6)), "d": odds.american(F.lit(1.0)), "e": odds.kelly(F.lit(0.1), F.lit(0.0), F.lit(100)), "f": odds.non_push(F.lit(0.0), F.lit(1.0)), "g": odds.outcome(F.lit("OVER"), F.lit(3.0), F.lit(3.0)), "h": odds.outcome(F.lit("HIT"), F.lit(3.0), F.lit(3.0)), "i": odds.outcome(F.lit("UNDER"), F.lit(None).cast("double"), F.lit(3.0))}.items()]).first()
    assert r.a == pytest.approx(0.6) and r.b is None and r.c == pytest.approx(-150) and r.d is None and r.e == 0 and r.f is None and r.g is None and r.h == 1 and r.i is None


def test_names_and_clocks(spark):
    df = spark.createDataFrame([("D'Andre  Smith Jr.", "12:05"), (None, "x"), ("", None)], "n string, c string")
    got = [tuple(r) for r in df.select(text.person_name(F.col("n")), text.clock_seconds(F.col("c"))).collect()]
    assert got == [("dandre smith", 725), (None, None), ("", None)]


def test_closing_quotes_with_ties(spark):
    quotes = spark.sql("SELECT * FROM VALUES (1, 'a', TIMESTAMP'2024-01-01 10:00:00', 5.0D), (1, 'a', TIMESTAMP'2024-01-01 10:00:00', 5.0D), (1, 'b', TIMESTAMP'2024-01-01 10:00:00', 5.0D), (1, 'b', TIMESTAMP'2024-01-01 10:00:00', 6.0D), (1, 'c', TIMESTAMP'2024-01-01 12:00:00', 1.0D) AS t(game, book, at, line)")
    kick = spark.sql("SELECT 1 AS game, TIMESTAMP'2024-01-01 12:00:00' AS kickoff")
    got = {r.book: (r.n_variants, r.line) for r in pit.close_of(quotes, kick, "game", ["book"], "at", "kickoff", "10 MINUTES", ["line"]).collect()}
    assert got == {"a": (1, 5.0), "b": (2, None)}


def test_isotonic_and_logistic(spark):
    rng = np.random.default_rng(0)
    p = rng.random(3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.4 + 1.7 * np.log(p / (1 - p)))))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")
    w = calibration.fit_logistic(df, [calibration.logit(F.col("p"))], "y")
    assert w[0] == pytest.approx(0.4, abs=0.2) and w[1] == pytest.approx(1.7, abs=0.2)
    rows = sorted((r.p, r.fitted) for r in calibration.apply_isotonic(df, calibration.fit_isotonic(df, "p", "y"), "p").collect())
    fitted = [f for _, f in rows]
    assert fitted == sorted(fitted) and np.mean((np.array(fitted) - 1 / (1 + np.exp(-(0.4 + 1.7 * np.log(np.array([a for a, _ in rows]) / (1 - np.array([a for a, _ in rows]))))))) ** 2) < 0.01
    beta = calibration.fit_logistic(df, calibration.beta_features(F.col("p")), "y")
    assert len(beta) == 3 and calibration.fit_logistic(df.limit(0), [F.col("p")], "y") == [0.0, 0.0]


def test_isotonic_pools_every_distinct_p(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([0.5 + np.arange(400) * 1e-6, rng.random(400)])
    y = np.concatenate([rng.random(400) < np.linspace(0, 1, 400), rng.random(400) < p[400:]]).astype(int)
    order = np.argsort(p)
    blocks = []
    for a, b in zip(p[order], y[order], strict=True):
        blocks.append([[a], [b]])
        while len(blocks) > 1 and np.mean(blocks[-2][1]) >= np.mean(blocks[-1][1]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1]]
    x, f = [e for b in blocks for e in (b[0][0], b[0][-1])], [np.mean(b[1]) for b in blocks for _ in range(2)]
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)] + [(None, 1), (0.3, None)], "p double, y int").repartition(5)
    rows = calibration.apply_isotonic(df, calibration.fit_isotonic(df, "p", "y"), "p").collect()
    assert len(rows) == 802 and [r.fitted for r in rows if r.p is None] == [None]
    for r in rows:
        assert r.p is None or r.fitted == pytest.approx(np.interp(r.p, x, f), abs=1e-9)


def test_header_does_not_depend_on_partitions(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("run", F.col("l_suppkey"))
    a, b = (sorted(map(tuple, products.header(r, "run", ["l_orderkey", "l_quantity"]).collect())) for r in (rows, rows.repartition(7, "l_quantity")))
    assert a == b and products.header(rows.withColumn("l_quantity", F.lit(0.0)), "run", ["l_orderkey", "l_quantity"]).join(spark.createDataFrame(a, "run long, n_rows long, old string"), "run").where("content_hash = old").count() == 0


def test_raw_payloads(spark):
    df = spark.createDataFrame([(1, '{"a": 5, "b": "x"}'), (2, "no"), (3, None)], "id long, body string")
    good, bad = raw.mapped(df, "body", "a long, b string")
    assert [(r.id, r.a, r.b) for r in good.collect()] == [(1, 5, "x")] and sorted(r.id for r in bad.collect()) == [2, 3]
    url = spark.createDataFrame([("http://x/?api_key=abc&z=1",)], "u string")
    assert url.select(raw.masked("u", ["api_key"])).first()[0] == "http://x/?api_key=***&z=1"


def test_empty_tables(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").limit(0)
    assert pit.latest(events, ["user_id"], F.current_timestamp(), "ts", "event_id").count() == 0
    assert distributions.pmf(events, ["event_type"], "user_id").count() == 0
    quality.require_empty(events, "none")
    with pytest.raises(ValueError):
        quality.require_empty(spark.range(1), "one row")


def test_filters_reach_the_reader(spark, sf, capsys):
    QUERIES["pushed_scan"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan and "o_orderdate" not in plan
