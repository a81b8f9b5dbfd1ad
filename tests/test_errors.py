"""What must raise does, and says why."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsing
from tidemark.operators import gates, stats, timing
from tidemark.sources import tables


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


@pytest.mark.parametrize(("make", "bad"), [(parsing.possession_seconds, "31:75"), (parsing.possession_seconds, "x"), (parsing.line, "2..5"), (parsing.line, "")])
def test_values_that_must_be_known(spark, make, bad):
    with pytest.raises(Exception, match="invalid possession time|unparseable line"):
        rows(spark, [(bad,)], "v string").select(make(F.col("v"))).collect()
    assert rows(spark, [(None,)], "v string").select(make(F.col("v")).alias("x")).first().x is None


def test_forms_of_heights(spark):
    given = {"6' 2\"": 74.0, "6-2": 74.0, "74": 74.0, "74 in": 74.0, " 74.5 Inches ": 74.5, "6 ′ 2″": 74.0, "tall": None, "": None, None: None, "6'2\"x": None}
    got = rows(spark, [(k,) for k in given], "v string").select("v", parsing.inches(F.col("v")).alias("x")).collect()
    assert {r.v: r.x for r in got} == given


def test_knowledge_time(spark):
    quotes = rows(spark, [(1, "2024-01-01")], "id long, collector_received_at string")
    assert timing.knowledge_time(quotes, "opening").first().known_at == "2024-01-01"
    with pytest.raises(ValueError, match="mode"):
        timing.knowledge_time(quotes, "closing")
    with pytest.raises(ValueError, match="lack"):
        timing.knowledge_time(quotes.drop("collector_received_at"), "live")
    with pytest.raises(Exception, match="lacks collector_received_at"):
        timing.knowledge_time(rows(spark, [(1, None)], "id long, collector_received_at string"), "live").collect()


def test_one_to_one(spark):
    a, b = rows(spark, [(1, 5), (2, 6)], "k long, a long"), rows(spark, [(1, 7), (2, 8)], "k long, b long")
    assert sorted(map(tuple, gates.joined_one_to_one(a, b, ["k"]).collect())) == [(1, 5, 7), (2, 6, 8)]
    for other in (b.where("k = 1"), b.union(b)):
        with pytest.raises(ValueError, match="exactly once"):
            gates.joined_one_to_one(a, other, ["k"])


def test_two_stores_that_disagree(spark):
    a, b = rows(spark, [(1, 5.0), (2, 6.0)], "k long, v double"), rows(spark, [(2, 6.5), (3, 7.0)], "k long, v double")
    with pytest.raises(Exception, match="disagree"):
        gates.read_either(a, b, ["k"], "v").collect()
    assert sorted(map(tuple, gates.read_either(a, b.where("k = 3"), ["k"], "v").collect())) == [(1, 5.0), (2, 6.0), (3, 7.0)]


def test_catalog(spark):
    assert stats.catalog(spark, {"receptions": [2, 4]}, None).count() == 2
    for ladders in ({"touchdowns": [1]}, {"receptions": []}, {"receptions": [4, 2]}, {"receptions": [0, 2]}):
        with pytest.raises(ValueError, match="statistic|rise"):
            stats.catalog(spark, ladders, None)


def test_distributions_are_checked(spark):
    whole = rows(spark, [("a", 1, 0.5), ("a", 2, 0.5)], "k string, outcome long, p double")
    assert sorted(map(tuple, stats.unpacked(stats.packed(whole, ["k"]), ["k"]).collect())) == [("a", 1, 0.5), ("a", 2, 0.5)]
    with pytest.raises(Exception, match="SUM"):
        stats.unpacked(stats.packed(whole.where("outcome = 1"), ["k"]), ["k"]).collect()


def test_links_need_a_distribution(spark):
    made = rows(spark, [(1,)], "k long")
    with pytest.raises(ValueError, match="without a distribution"):
        stats.linked(made, rows(spark, [(2, "d")], "k long, id string"), ["k"])


def test_late_quotes_are_refused(spark):
    quotes = rows(spark, [(1, "OVER", 1.5, 110, 9)], "k long, side string, line double, odds int, at int")
    dist = rows(spark, [(1, 1, 0.25), (1, 2, 0.75)], "k long, outcome long, p double")
    assert stats.priced(quotes, dist, ["k"], F.lit(9), "at").first().p_win == 0.75
    with pytest.raises(Exception, match="after the cutoff"):
        stats.priced(quotes, dist, ["k"], F.lit(8), "at").collect()


def test_sinks(spark, tmp_path):
    a = rows(spark, [(1, "x"), (2, "y")], "k long, v string")
    with pytest.raises(ValueError, match="lacks its time"):
        tables.append_snapshot(a, a, ["k"], "at")
    with pytest.raises(Exception, match="lacks v"):
        tables.append_snapshot(a, rows(spark, [(3, None)], "k long, v string"), ["k"], "v").collect()
    with pytest.raises(ValueError, match="stored already"):
        tables.register_artifacts(a, a.where("k = 2"), ["k"])
    with pytest.raises(ValueError, match="two parts"):
        tables.disjoint(a.select("k"), rows(spark, [(9,)], "k long"), a.where("k = 1").select("k"))
    assert sorted(map(tuple, tables.upsert(a, rows(spark, [(2, "z"), (2, "z")], "k long, v string"), ["k"]).collect())) == [(1, "x"), (2, "z")]
    root = str(tmp_path / "t")
    for n in (1, 2):
        tables.replace(a.limit(n), root)
        assert tables.current(spark, root).count() == n
    assert not tables.exists(spark, root + "x")


def test_provenance_and_gates(spark):
    a = rows(spark, [(1, "x")], "k long, source_hash string")
    with pytest.raises(ValueError, match="already"):
        gates.with_provenance(a, a, ["k"])
    bench = rows(spark, [(600, 0.1, 0.2, 0.1, 0.2, 0.03, 0.02), (499, 0.1, 0.2, 0.1, 0.2, 0.02, 0.02), (600, 0.2, 0.2, 0.1, 0.1, 0.05, 0.02), (600, 0.1, 0.2, 0.1, 0.2, None, 0.02)],
        "n long, log_loss_model double, log_loss_market double, brier_model double, brier_market double, ece_model double, ece_market double")
    got = [len(r.r) for r in bench.select(gates.superiority_reasons(500, 0.0101).alias("r")).collect()]
    assert got == [0, 1, 3, 1]
    evidence = rows(spark, [(True, None, False)], "a boolean, b boolean, c boolean")
    assert evidence.select(gates.evidence_reasons(["a", "b", "c"]).alias("r")).first().r == ["missing: b", "failed: c"]


@pytest.mark.parametrize(("policy", "want"), [("field", [1.0, 1.0, None, None]), ("require_all", [3.0, None, None, None]), ("zero_if_any_known", [3.0, 1.0, 2.0, None])])
def test_settlement_policies(spark, policy, want):
    df = rows(spark, [(0, 1, 2), (1, 1, None), (2, None, 2), (3, None, None)], "i int, a int, b int")
    assert [r.v for r in df.select("i", stats.actual(["a", "b"], policy).alias("v")).orderBy("i").collect()] == want
