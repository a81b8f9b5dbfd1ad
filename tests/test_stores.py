"""Pins, indexes, fingerprints, the registry, bindings and documents: what is planted is found, what must raise does."""

import hashlib
import os
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import odds, parsing, scoring
from tidemark.operators import gates, manifests as M, publication as P, registry as C, timing
from tidemark.sources import crosswalk as X, pinned as N, tables as S


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def files(at):
    return sorted(f for f in os.listdir(at) if f.endswith(".parquet"))


def test_a_pinned_file_is_what_it_was(spark):
    at = folder() + "/roster"
    spark.range(100).select("id", F.lit(2023).alias("season")).coalesce(1).write.parquet(at)
    name, = files(at)
    path, sha = f"{at}/{name}", hashlib.sha256(open(f"{at}/{name}", "rb").read()).hexdigest()
    rows = N.pinned_scan(spark, path, sha, 100, {"season": 2023}, ["id"])
    assert rows.count() == 100 and {r.source_sha256 for r in rows.collect()} == {sha}
    for bad in ((path, "0" * 64, 100, {"season": 2023}), (path, sha, 99, {"season": 2023}), (path, sha, 100, {"season": 2024})):
        with pytest.raises(ValueError, match="pinned|rows"):
            N.pinned_scan(spark, *bad, ["id"])


def test_a_manifest_finds_changed_missing_and_new_files(spark):
    at = folder() + "/data"
    spark.range(400).repartition(4).write.parquet(at)
    stored = spark.createDataFrame(N.manifest(spark, at, "2024-01-01").collect())
    N.require_manifest(spark, at, stored)
    one, two, *_ = files(at)
    with open(f"{at}/{one}", "ab") as f:
        f.write(b"x")
    os.remove(f"{at}/.{one}.crc")
    os.remove(f"{at}/{two}")
    with open(f"{at}/part-new.parquet", "wb") as f:
        f.write(b"y")
    assert {(r.file, r.fault) for r in N.differences(spark, at, stored).collect()} == {(one, "CHANGED"), (two, "MISSING"), ("part-new.parquet", "NEW")}
    with pytest.raises(ValueError, match="differ"):
        N.require_manifest(spark, at, stored)


def test_an_index_leads_to_the_files_that_hold_a_key(spark):
    at = folder()
    rows = spark.range(1000).select((F.col("id") % 50).alias("game"), "id").unionByName(spark.createDataFrame([(None, -1)], "game long, id long"))
    rows.repartitionByRange(10, "game").write.parquet(f"{at}/rows")
    table = spark.read.parquet(f"{at}/rows")
    N.write_index(N.key_index(table, "game"), f"{at}/index", "game")
    index = spark.read.parquet(f"{at}/index")
    found = N.indexed_scan(spark, index, "game", [7], table.schema)
    assert len(found.inputFiles()) == 1 < len(files(f"{at}/rows"))
    assert sorted(r.id for r in found.collect()) == list(range(7, 1000, 50))
    assert N.indexed_scan(spark, index, "game", [99], table.schema).count() == 0
    gone = index.where("game = 7").select("file").distinct()
    live = N.live_index(index, index.select("file").distinct().exceptAll(gone))
    assert live.where("game = 7").count() == 0 and live.count() == index.count() - index.join(gone, "file", "left_semi").count()


def test_fingerprints_equal_filtered_hashes_and_change_where_a_row_does(spark):
    rows = [(k, t, v) for k in ("a", None) for t in range(6) for v in range(t % 3 + 1)] + [("a", None, 9)]
    df = spark.createDataFrame(rows, "k string, t int, v long")
    checkpoints = spark.createDataFrame([(k, t) for k in ("a", None, "none") for t in (-1, 2, 5)], "k string, at int")
    scopes = {"even": F.col("v") % 2 == 0, "odd": F.col("v") % 2 == 1, "all": F.lit(True)}
    out = M.fingerprints(df, ["k"], "t", scopes, ["v", "t"], checkpoints.where("k IS NOT NULL"), "at")
    got = {(r.k, r.at): r for r in out.collect()}
    digest = lambda v, t: hashlib.sha256(f'{{"t":{t},"v":{v}}}'.encode()).hexdigest()
    for (k, at), r in got.items():
        for name, test in (("even", lambda v: v % 2 == 0), ("odd", lambda v: v % 2 == 1), ("all", lambda v: True)):
            inside = [digest(v, t) for j, t, v in rows if j == k and t is not None and t <= at and test(v)]
            text = f"{len(inside)}|{sum(int(h[:15], 16) for h in inside)}|{sum(int(h[15:30], 16) for h in inside)}"
            if k != "none":
                assert (r[name].n_rows, r[name].sha256) == (len(inside), hashlib.sha256(text.encode()).hexdigest())
    other = M.fingerprints(df.withColumn("v", F.when((F.col("t") == 4) & (F.col("v") == 1) & (F.col("k") == "a"), 3).otherwise(F.col("v"))), ["k"], "t", scopes, ["v", "t"], checkpoints.where("k IS NOT NULL"), "at")
    assert {tuple(r) for r in M.changed(out, other, ["k", "at"], list(scopes)).collect()} == {("a", 5, "odd"), ("a", 5, "all")}


def test_the_registry_refuses_what_is_out_of_order(spark):
    log = [
        ("x", "s", "VALIDATED", 1, "", True, "not registered"), ("x", "s", "REGISTERED", 2, "c", None, None), ("x", "s", "REGISTERED", 3, "c", None, None), ("x", "s", "REGISTERED", 4, "d", None, "registered again with other content"),
        ("x", "s", "APPROVED", 5, "", None, "no passed validation"), ("x", "s", "VALIDATED", 6, "", False, None), ("x", "s", "APPROVED", 7, "", None, "no passed validation"), ("x", "s", "VALIDATED", 8, "", True, None),
        ("x", "s", "PROMOTED", 9, "", None, "not approved"), ("x", "s", "APPROVED", 10, "", None, None), ("x", "s", "PROMOTED", 11, "", None, None), ("y", "s", "REGISTERED", 11, "c", None, None), ("y", "s", "VALIDATED", 12, "", True, None),
        ("y", "s", "APPROVED", 13, "", None, None), ("y", "s", "PROMOTED", 14, "", None, None), ("y", "s", "RETIRED", 16, "", None, None), ("y", "s", "PROMOTED", 17, "", None, "ended"), ("x", "s", "RENAMED", 18, "", None, "unknown event"),
    ]
    events = spark.createDataFrame([(a, s, k, t, i, c, p) for i, (a, s, k, t, c, p, _) in enumerate(log)], "artifact string, scope string, kind string, at int, seq int, content string, passed boolean")
    assert {r.seq: r.fault for r in C.judged(events).collect()} == {i: e[-1] for i, e in enumerate(log)}
    asked = spark.createDataFrame([("s", t) for t in (5, 10, 11, 13, 14, 15, 16, 30)] + [("other", 30)], "scope string, at int")
    assert {(r.scope, r.at): r.artifact for r in C.in_force(events, asked).collect()} == {("s", 5): None, ("s", 10): None, ("s", 11): "x", ("s", 13): "x", ("s", 14): "y", ("s", 15): "y", ("s", 16): None, ("s", 30): None, ("other", 30): None}


def test_bindings_never_change(spark):
    kind = "entity_kind string, provider string, provider_id string, canonical_id string"
    stored = spark.createDataFrame([("P", "a", "1", "c1"), ("P", "b", "1", "c2")], kind)
    batch = spark.createDataFrame([("P", "a", "1", None), ("P", "a", "1", "c1"), ("P", "a", "2", None), ("P", "a", "3", "c9")], kind)
    out = {(r.provider, r.provider_id): r.canonical_id for r in X.attached(stored, batch).collect()}
    assert out[("a", "1")] == "c1" and out[("a", "3")] == "c9" and out[("a", "2")].startswith("p_") and len(out) == 4
    again = X.attached(stored, batch.where("provider_id = '2'"))
    assert again.where("provider_id = '2'").first().canonical_id == out[("a", "2")]
    bad = spark.createDataFrame([("P", "a", "1", "c2"), ("P", "z", "1", "c2"), ("P", "z", "1", "c3")], kind)
    assert {tuple(r) for r in X.conflicts(stored, bad).select("provider", "first", "last").collect()} == {("a", "c1", "c2"), ("z", "c2", "c3")}
    with pytest.raises(ValueError, match="more than one"):
        X.attached(stored, bad)
    links = spark.createDataFrame([(i, i + 1) for i in range(37)] + [(100, 101)], "from long, to long")
    assert {r["from"]: r["to"] for r in X.followed(links).collect()} == {**{i: 37 for i in range(37)}, 100: 101}
    with pytest.raises(ValueError, match="back to themselves"):
        X.followed(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "from long, to long"))


ROWS = "run string, opportunity_id string, player string, team string, prop string, pick string, line double, model_probability double, fair_odds long, book string, book_odds long, edge double, projection double, updated_at timestamp_ntz"
NOW = datetime(2024, 1, 1, 12)


def published(spark, change=None, n=30):
    rows = [["r", str(i), f"p{i % 4}", "T", "yards", "OVER", 10.25 + i, 0.51237, 120, "b", 110, i / 7, None, datetime(2024, 1, 1, 10)] for i in range(n)]
    runs = ["r", "g", datetime(2024, 1, 1, 11), datetime(2024, 1, 1, 20)]
    if change:
        change(rows, runs)
    return P.documents(spark.createDataFrame([tuple(r) for r in rows], ROWS), spark.createDataFrame([tuple(runs)], "run string, game string, generated_at timestamp_ntz, expires_at timestamp_ntz"))


def test_documents_are_the_same_bytes_whatever_the_partitions(spark):
    one = published(spark).first().document
    rows = spark.createDataFrame([("r", str(i), f"p{i % 4}", "T", "yards", "OVER", 10.25 + i, 0.51237, 120, "b", 110, i / 7, None, datetime(2024, 1, 1, 10)) for i in reversed(range(30))], ROWS)
    runs = spark.createDataFrame([("r", "g", datetime(2024, 1, 1, 11), datetime(2024, 1, 1, 20))], "run string, game string, generated_at timestamp_ntz, expires_at timestamp_ntz")
    assert P.documents(rows.repartition(7), runs).first().document == one
    assert one.startswith('{"schema_version":"public-ready/v1"') and '"model_probability":0.5124' in one and '"generated_at":"2024-01-01T11:00:00Z"' in one


def test_readers_refuse_documents_that_are_not_fit(spark):
    def fault(change):
        at = folder()
        P.write_documents(published(spark, change), at)
        read = P.read_documents(spark, at, F.lit(NOW), "6 HOURS")
        assert P.current(read).count() == (read.first().fault is None)
        return read.first().fault

    put = lambda i, v: lambda rows, runs: rows[3].__setitem__(i, v)
    run = lambda i, v: lambda rows, runs: runs.__setitem__(i, v)
    assert fault(None) is None
    assert fault(run(3, datetime(2024, 1, 1, 12))) == "EXPIRED"
    assert fault(run(2, datetime(2024, 1, 1, 5))) == "STALE"
    assert fault(run(2, datetime(2024, 1, 1, 13))) == "FUTURE"
    assert fault(put(1, "4")) == "REPEATED"
    for i, v in ((2, ""), (5, "MAYBE"), (6, None), (7, 1.5), (8, None), (11, None), (13, datetime(2024, 1, 1, 11, 30))):
        assert fault(put(i, v)) == "ROW", i
    at = folder()
    spark.createDataFrame([("no document",)], "value string").write.mode("overwrite").text(at)
    assert P.read_documents(spark, at, F.lit(NOW), "6 HOURS").first().fault == "SCHEMA"


def test_small_checks(spark):
    pairs = spark.createDataFrame([(0.5, 0.1), (-0.1, 0.2), (1.2, 0.0), (0.9, 0.2), (float("nan"), 0.1), (None, 0.1)], "w double, p double")
    assert [r[0] for r in pairs.select(odds.win_push_fault(F.col("w"), F.col("p"))).collect()] == [None, "NEGATIVE", "ABOVE_ONE", "SUM_ABOVE_ONE", "NOT_FINITE", "NOT_FINITE"]
    with pytest.raises(Exception, match="win and push"):
        pairs.select(odds.checked_win(F.col("w"), F.col("p"))).collect()
    one = spark.range(1)
    assert one.select(scoring.draws_needed(F.lit(0.5), F.lit(0.01))).first()[0] == 2500
    for bad in (scoring.draws_needed(F.lit(0.5), F.lit(0.0)), scoring.standard_error(F.lit(0.5), F.lit(0))):
        with pytest.raises(Exception, match="error|draws"):
            one.select(bad).collect()
    weeks = spark.createDataFrame([(True, 1), (True, 4), (None, 4), (False, 17), (True, None)], "p boolean, w int")
    assert [r[0] for r in weeks.select(parsing.season_week(F.col("p"), F.col("w"))).collect()] == [19, None, 4, 17, None]
    heights = spark.createDataFrame([("6' 2\"",), ("6-2",), ("74",), ("74 in",), ("tall",), (None,), ("6′2″",)], "h string")
    assert [r[0] for r in heights.select(parsing.inches(F.col("h"))).collect()] == [74.0, 74.0, 74.0, 74.0, None, None, 74.0]
    for bad in ("7", "7:60", "x:10", "1:5"):
        with pytest.raises(Exception, match="possession"):
            one.select(parsing.possession_seconds(F.lit(bad))).collect()


def test_requests_runs_and_backtest_rows(spark):
    requests = spark.createDataFrame([("a", 5, 1), ("b", 20, 3), ("c", 15, 9), ("d", None, 0)], "run_id string, kickoff_at int, as_of int")
    assert timing.select_request(requests, F.lit(10)).first().run_id == "c"
    assert timing.select_request(requests, F.lit(30)).first().run_id == "d"
    assert timing.select_request(requests, F.lit(10), "a").first().run_id == "a"
    with pytest.raises(ValueError, match="not among"):
        timing.select_request(requests, F.lit(10), "z")
    kind = "resource_run_id long, collection_status string, row_count long"
    stored = spark.createDataFrame([(1, "SUCCESS", 5)], kind)
    assert S.record_runs(stored, spark.createDataFrame([(1, "SUCCESS", 5), (2, "EMPTY_RESPONSE", 0), (2, "EMPTY_RESPONSE", 0)], kind)).count() == 2
    for row, error in (((1, "SUCCESS", 6), "other content"), ((3, "FINE", 1), "unknown status")):
        with pytest.raises(Exception, match=error):
            S.record_runs(stored, spark.createDataFrame([row], kind)).collect()
    settled = spark.createDataFrame([("p", 1, 2)], "prediction_id string, game_id long, player_id long")
    known = spark.createDataFrame([(1, 2, 9)], "game_id long, player_id long, outcome_available_at int")
    where = spark.createDataFrame([(2, "QB")], "player_id long, position_group string")
    assert gates.scoreable(settled, known, where, "game_id", "player_id").first().position_group == "QB"
    for a, b, error in ((known.where("false"), where, "outcome_available_at"), (known, where.where("false"), "position_group")):
        with pytest.raises(Exception, match=error):
            gates.scoreable(settled, a, b, "game_id", "player_id").collect()
    assert len(gates.BACKTEST) == 28


def test_upsert_takes_the_last_by_a_stated_order(spark):
    a = spark.createDataFrame([(1, "x", 0)], "k long, v string, seq int")
    b = spark.createDataFrame([(1, "new", 2), (1, "old", 1), (2, "p", 1), (2, "q", 1)], "k long, v string, seq int")
    assert {(r.k, r.v) for r in S.upsert(a, b, ["k"], order=["seq"]).collect()} == {(1, "new"), (2, "q")}
    assert {(r.k, r.v) for r in S.upsert(a, b, ["k"], keep="first", order=["seq"]).collect()} == {(1, "x"), (2, "p")}
