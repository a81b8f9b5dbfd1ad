"""The report of a backtest, boards, inputs, folds, receipts and tables of parts on small tables, and what they refuse."""

import hashlib
import json
import tempfile
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import boards as B, inputs as I, protocol as P, report as E
from tidemark.sources import receipts as C, tables as S

ROW = "id int, prop_type string, season int, week int, p double, q double, y int, actual double, model_mean double, selected boolean, ev double, profit double, close_available boolean, clv_probability double, clv_cents double"


def bets(spark, *changes):
    base = {"prop_type": "a", "season": 2020, "week": 2, "p": 0.6, "q": 0.5, "y": 1, "actual": 4.0, "model_mean": 3.0, "selected": True, "ev": 0.1, "profit": 1.0, "close_available": True, "clv_probability": 0.02, "clv_cents": 2.0}
    return spark.createDataFrame([{"id": i, **base, **c} for i, c in enumerate(changes)], ROW)


def values(df):
    return {(r["section"], r["slice"], r["metric"]): r["value"] for r in df.collect()}


def test_report_of_a_few_bets(spark):
    rows = bets(spark, {}, {"profit": -1.0, "y": 0, "week": 15, "close_available": False, "clv_cents": 9.0}, {"profit": -1.0, "actual": float("nan"), "season": None, "clv_cents": None}, {"selected": False, "profit": -5.0, "model_mean": float("inf"), "week": 9}, {"profit": 2.0, "actual": None, "selected": None})
    got = values(E.report(rows, ["id"], key=["id"]))
    assert got["aggregate", "all", "n"] == 5 and got["early_weeks", "all", "n"] == 3 and got["late_weeks", "all", "n"] == 1
    assert got["by_season", "unknown", "n"] == 1 and got["by_season", "2020", "n"] == 4
    assert (got["trading", "all", "bets"], got["trading", "all", "max_drawdown"], got["trading", "all", "close_missing"]) == (3, 2, 1)
    assert abs(got["trading", "all", "roi"] + 1 / 3) < 1e-9 and got["trading", "all", "n_clv_cents"] == 1 and got["trading", "all", "mean_clv_cents"] == 2
    assert (got["distributional", "all", "n"], got["distributional", "all", "mae"], got["distributional", "all", "median_ae"], got["distributional", "all", "mean_wis"]) == (3, 1, 1, None)
    assert got["reliability", "6", "rate"] == 0.8


def test_report_where_a_profit_is_not_finite_or_nothing_is_there(spark):
    got = values(E.report(bets(spark, {}, {"profit": float("inf")}), ["id"]))
    assert got["trading", "all", "roi"] is None and got["trading", "all", "max_drawdown"] is None and got["trading", "all", "bets"] == 2
    none = values(E.report(bets(spark, {}).limit(0), ["id"], bets(spark, {}).limit(0).withColumn("reason", F.lit("x"))))
    assert none["trading", "all", "bets"] == 0 and none["trading", "all", "roi"] is None and none["distributional", "all", "n"] == 0


@pytest.mark.parametrize("change", [{"p": None}, {"p": 1.5}, {"q": -0.1}, {"q": None}, {"y": 2}, {"y": None}, {"close_available": None}])
def test_report_refuses(spark, change):
    with pytest.raises(PySparkException):
        E.report(bets(spark, {}, change), ["id"]).collect()


def test_report_refuses_repeated_keys_and_missing_columns(spark):
    with pytest.raises(ValueError, match="repeat"):
        E.report(bets(spark, {}).union(bets(spark, {})), ["id"], key=["id"])
    with pytest.raises(ValueError, match="actual"):
        E.report(bets(spark, {}).drop("actual"), ["id"])
    with pytest.raises(ValueError, match="reason"):
        E.report(bets(spark, {}), ["id"], bets(spark, {}))


QUOTE = "player int, prop string, market_type string, line double, over_odds int, under_odds int, hit_odds int, received timestamp_ntz, vendor string"


def quote(*, player=1, prop="receptions", market="over_under", line=1.5, over=100, under=-110, hit=None, day=1, vendor="v"):
    return player, prop, market, line, over, under, hit, datetime(2020, 1, day), vendor


def test_board(spark):
    quotes = spark.createDataFrame([quote(), quote(), quote(prop="anytime_td", market="milestone", line=0.5, hit=200), quote(prop="anytime_td", market="milestone", line=None, hit=200), quote(prop="anytime_td", market="milestone", line=1.5, hit=200), quote(prop="first_td"), quote(player=2), quote(prop=None), quote(line=None)], QUOTE)
    marked = B.supported(quotes)
    assert sorted((r["prop"] or "", r["reason"], r["n"]) for r in B.exclusion_counts(marked).collect()) == [("", "UNSUPPORTED_PROP_TYPE", 1), ("anytime_td", "UNSUPPORTED_COUNT_MILESTONE", 1)]
    dist = spark.createDataFrame([(1, "receptions", 1, 0.25), (1, "receptions", 2, 0.75), (1, "anytime_td", 0, 0.5), (1, "anytime_td", 1, 0.25), (1, "anytime_td", 2, 0.25), (2, "receptions", 2, 1.0), (1, "first_td", 1, 1.0)], "player int, prop string, outcome long, p double")
    cutoff, drawn = F.expr("TIMESTAMP_NTZ'2020-01-02 00:00:00'"), spark.createDataFrame([(1,), (1,)], "player int")
    got = B.board(quotes, dist, ["player", "prop"], cutoff, "received", 2, drawn).collect()
    assert sorted((r["prop"], r["side"], r["p_win"], r["tier"], r["line"], r["quote_age_seconds"]) for r in got) == [("anytime_td", "HIT", 0.5, 2, None, 86400)] * 2 + [("receptions", "OVER", 0.75, 1, 1.5, 86400)] * 2 + [("receptions", "UNDER", 0.25, 1, 1.5, 86400)] * 2
    with pytest.raises(PySparkException, match="after the cutoff"):
        B.board(spark.createDataFrame([quote(day=3)], QUOTE), dist, ["player", "prop"], cutoff, "received", 2).collect()


def input_tables(spark):
    day = lambda m, d=1: datetime(2020, m, d)
    games = spark.createDataFrame([(1, 2020, 1, day(1), day(1)), (2, 2020, 1, day(1, 9), day(1)), (3, 2020, 2, day(2), day(1)), (4, 2020, 3, day(3), day(9)), (5, 2020, 1, day(1), day(1)), (5, 2020, 2, day(1), day(1))], "game int, season int, week int, kickoff timestamp_ntz, available_at timestamp_ntz")
    stats = spark.createDataFrame([(g, 7, day(m), s) for g, m, s in ((1, 1, "F"), (2, 9, "F"), (2, 1, "P"), (3, 2, "F"), (4, 2, "F"), (5, 1, "F"))], "game int, player int, available_at timestamp_ntz, status string")
    roster = spark.createDataFrame([(7, 1, day(1)), (8, 2, day(1)), (8, 2, day(9))], "player int, team int, available_at timestamp_ntz")
    weekly = spark.createDataFrame([(7, 1, 2020, 2, "ACT"), (8, 2, 2020, 2, "RES"), (9, 1, 2020, 2, "ACT"), (9, 2, 2020, 2, "ACT")], "player int, team int, season int, week int, status string")
    other = roster.select("player", "available_at")
    return {"games": games, "stats": stats, "roster": roster, "odds": other, "injuries": other}, weekly


def test_model_inputs(spark):
    tables, weekly = input_tables(spark)
    at, final = F.expr("TIMESTAMP_NTZ'2020-02-15 00:00:00'"), F.col("status") == "F"
    ids = lambda df: sorted(r["game"] for r in df.collect())
    live = I.model_inputs(I.ENHANCED, I.LIVE, tables, at, 202002, final)
    assert ids(live["stats"]) == [1, 2, 3, 4, 5] and live["roster"].count() == 2 and live["odds"].count() == 2
    assert {r["game"]: r["event_time"] for r in live["stats"].collect()}[4] is None
    core = I.model_inputs(I.CORE, I.LIVE, tables, at, 202002, final)
    assert ids(core["stats"]) == [1, 2] and core["roster"].count() == core["odds"].count() == core["injuries"].count() == 0 and core["membership"].count() == 2
    past = I.model_inputs(I.CORE, I.HISTORICAL, {**tables, "weekly": weekly}, at, 202002, final, (2020, 2))
    assert [(r["game"], r["event_time"]) for r in past["stats"].orderBy("game").collect()] == [(1, datetime(2020, 1, 9)), (2, datetime(2020, 1, 9))]
    assert [tuple(r) for r in past["membership"].collect()] == [(7, 1)]
    assert I.last_times(live, "player", at).collect()[0]["available_at"] == datetime(2020, 2, 1)
    early = I.model_inputs(I.CORE, I.HISTORICAL, {**tables, "weekly": weekly}, F.expr("TIMESTAMP_NTZ'2020-01-05 00:00:00'"), 202002, final, (2020, 2))
    assert ids(early["stats"]) == []  # the slate had not ended


def test_model_inputs_refuse(spark):
    tables, weekly = input_tables(spark)
    at, final = F.current_timestamp(), F.lit(True)
    for profile, mode, given, week in [(I.ENHANCED, I.HISTORICAL, tables, None), ("X", I.LIVE, tables, None), (I.CORE, "X", tables, None), (I.CORE, I.LIVE, {**tables, "weekly": weekly}, None), (I.CORE, I.HISTORICAL, tables, (2020, 2)), (I.CORE, I.HISTORICAL, {**tables, "weekly": weekly}, None)]:
        with pytest.raises(ValueError):
            I.model_inputs(profile, mode, given, at, 202002, final, week)


FOLD = "experiment_id string, place int, fold_id string, train_start timestamp_ntz, train_end timestamp_ntz, selection_end timestamp_ntz, score_start timestamp_ntz, score_end timestamp_ntz"
EXPERIMENT = "experiment_id string, evidence_class string, protocol_version string, source_sha256 string, config_sha256 string, data_manifest_sha256 string"


def fold(place, name=None, start=2000, **times):
    day = lambda m: datetime(2010 + place, m, 1)
    own = {"train_start": datetime(start, 1, 1), "train_end": day(1), "selection_end": day(2), "score_start": day(3), "score_end": day(9), **times}
    return ("e", place, name or f"f{place}", *own.values())


def test_manifest_is_the_digest_of_canonical_json(spark):
    one = ("e", "HISTORICAL", "1", "a" * 64, "b" * 64, "c" * 64)
    got = P.manifests(spark.createDataFrame([one], EXPERIMENT), spark.createDataFrame([fold(1), fold(0)], FOLD)).collect()
    plain = {"experiment_id": "e", "evidence_class": "HISTORICAL", "protocol_version": "1", "source_sha256": "a" * 64, "config_sha256": "b" * 64, "data_manifest_sha256": "c" * 64}
    plain["folds"] = [dict(zip(["fold_id", *P.TIMES], [f[2], *(t.isoformat() + "+00:00" for t in f[3:])], strict=True)) for f in (fold(0), fold(1))]
    assert got[0]["sha256"] == hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize("change, folds", [({"config_sha256": "b"}, 2), ({"protocol_version": " "}, 2), ({"source_sha256": None}, 2), ({}, 0), ({}, -1)])
def test_manifest_refuses(spark, change, folds):
    one = {"experiment_id": "e", "evidence_class": "H", "protocol_version": "1", "source_sha256": "a" * 64, "config_sha256": "b" * 64, "data_manifest_sha256": "c" * 64, **change}
    rows = [fold(i, start=2000 + (folds < 0) * i) for i in range(abs(folds) + (folds < 0))]
    with pytest.raises(PySparkException, match="experiment"):
        P.manifests(spark.createDataFrame([one], EXPERIMENT), spark.createDataFrame(rows, FOLD)).collect()


def test_folds_with_a_null_time_or_overlapping_scores(spark):
    late = {"score_end": datetime(2012, 1, 1)}
    rows = [fold(0, **late), fold(1), fold(2, train_end=None), fold(3, score_start=datetime(2013, 2, 1)), fold(4, "f0")]
    got = {r["place"]: r["fault"] for r in P.judged_folds(spark.createDataFrame(rows, FOLD), "experiment_id", "place").collect()}
    assert got == {0: "REPEATED_ID", 1: "SCORES_OVERLAP", 2: "NO_TIME", 3: "SCORE_BEFORE_SELECTION_END", 4: "REPEATED_ID"}


RECEIPT = "sha256 string, payload binary, encoding string, http_status int, received_at timestamp_ntz"
RECORD = "id: bigint, season: int"


def receipt(ids, day=1, status=200, body=None, address=None):
    body = json.dumps({"data": [{"id": i, "season": 1} for i in ids]}).encode() if body is None else body
    return address or hashlib.sha256(body).hexdigest(), body, "plain", status, datetime(2020, 1, day)


def filled(spark, rows, stored=(), expected=(1, 2), now="2020-02-01"):
    held = spark.createDataFrame(list(stored), "id bigint, season int, available_at timestamp_ntz")
    asked = spark.createDataFrame([(i,) for i in expected], "id bigint")
    return C.backfill(C.compressed(spark.createDataFrame(rows, RECEIPT)).drop("fault"), RECORD, held, asked, "id", "available_at", F.expr(f"TIMESTAMP_NTZ'{now} 00:00:00'"), F.col("season") == 1)


def test_backfill_adds_what_is_lost_once(spark):
    rows = [receipt([1, 2]), receipt([2], day=2), receipt([2, 2], day=2), receipt([9], status=503)]
    got = filled(spark, rows)
    assert sorted((r["id"], r["available_at"].day) for r in got.collect()) == [(1, 1), (2, 1), (2, 2)]
    again = filled(spark, rows, [(r["id"], r["season"], r["available_at"]) for r in got.collect()])
    assert again.count() == 0
    assert filled(spark, rows, [(1, 1, datetime(2020, 1, 1)), (77, 1, datetime(2001, 1, 1))]).count() == 2


@pytest.mark.parametrize(
    "rows, more, reason",
    [
        ([receipt([1, 2, 3])], {}, "found and expected"),
        ([receipt([1])], {}, "found and expected"),
        ([receipt([1, 2])], {"stored": [(1, 1, datetime(2019, 1, 1))]}, "did not come"),
        ([receipt([1, 2], day=9)], {"now": "2020-01-05"}, "after now"),
        ([receipt([1, 2]), receipt([], body=b"[oops")], {}, "list of records"),
        ([receipt([1, 2]), receipt([], body=b'{"error": 1}')], {}, "list of records"),
        ([receipt([1, 2]), receipt([1], address="0" * 64)], {}, "address"),
    ],
)
def test_backfill_refuses(spark, rows, more, reason):
    with pytest.raises((ValueError, PySparkException), match=reason):
        filled(spark, rows, **more).collect()


def test_compressed_receipts_open_to_the_same_bytes(spark):
    rows = [receipt([], body=b""), receipt([], body=b"\x00\xff" * 100_000), receipt([1]), receipt([2], address="0" * 64), ("1" * 64, None, "plain", 200, None), receipt([3], address=None)]
    before = spark.createDataFrame(rows, RECEIPT)
    done = C.compressed(before)
    assert sorted((r["encoding"], r["fault"]) for r in done.select("encoding", F.coalesce("fault", F.lit("")).alias("fault")).collect()) == [("plain", "ADDRESS")] * 2 + [("zstd", "")] * 4
    assert C.compressed(done.drop("fault")).where("encoding = 'zstd'").count() == 4
    back = {r["sha256"]: bytes(r["payload"]) for r in C.opened(done.where("encoding = 'zstd'")).collect()}
    assert back == {r[0]: r[1] for r in rows if r[0] not in ("0" * 64, "1" * 64)}


def test_parts_replace_only_what_they_supersede(spark):
    at = tempfile.mkdtemp(prefix="spark-") + "/t"
    rows = lambda *r: spark.createDataFrame(list(r), "a int, b int, v string")
    got = lambda: sorted(((r["a"], r["b"], r["v"]) for r in S.live_parts(spark, at).collect()), key=str)
    with pytest.raises(ValueError, match="no parts"):
        S.live_parts(spark, at)
    assert S.append_part(rows((1, None, "x"), (2, 2, "x"), (2, 2, "y")), at, ["a", "b"]) == 2
    assert S.append_part(rows((3, 3, "x")), at, ["a", "b"]) == 1
    first, second = S._live(spark, at)[1]
    assert S.append_part(rows((1, None, "z")), at, ["a", "b"]) == 1
    kept = S._live(spark, at)[1]
    assert second in kept and first not in kept and got() == [(1, None, "z"), (2, 2, "y"), (3, 3, "x")]
    assert S.append_part(rows((1, None, "no"), (4, 4, "new")), at, ["a", "b"], keep="first") == 1
    assert S.append_part(rows((4, 4, "no")), at, ["a", "b"], keep="first") == 0
    whole = spark.createDataFrame([(5, 5, "x", 1.5)], "a long, b int, v string, w double")
    S.append_part(whole, at, ["a", "b"])
    before = got()
    assert S.compact_parts(spark, at, small_parts=9) == 0 and S.compact_parts(spark, at, small_parts=3) == len(kept) + 2
    assert got() == before and len(S._live(spark, at)[1]) == 1 and dict(S.live_parts(spark, at).dtypes)["a"] == "bigint"


def test_union_of_exactly_equal_columns(spark):
    one, other = spark.range(2), spark.range(3).withColumn("id", F.col("id").cast("int"))
    assert S.union_exact(one, one).count() == 4
    with pytest.raises(ValueError, match="int"):
        S.union_exact(one, other)


def test_player_crosswalk_rules_and_refusals(spark):
    from tidemark.operators.resolution import player_crosswalk

    roster = "season int, week int, team int, id string, full_name string, football_name string, last_name string, college string"
    seen = "player int, season int, week int, team int, name string, last_name string, college string"
    rows = [(1, 1, 1, "a", "Al Bo", "Al", "Bo", "X"), (1, 1, 1, "b", "Cy Do", None, "Do", "X"), (1, 1, 1, "c", "Cy Do", None, "Do", "Y"), (1, 1, 1, "d", None, "Ed", "Fo", "Z"), (1, 1, 1, "e", None, None, "Go", "W"), (1, 1, 2, "f", None, None, "Go", "V"), (1, 1, 1, "h", None, None, None, None), (1, 1, 3, "i", "Jo Ko", None, "Ko", "X")]
    apps = [(1, 1, 1, 1, "al bo", "bo", None), (1, 1, 1, 9, "al bo", "bo", None), (2, 1, 1, 1, "Cy Do Jr.", "Do", "Y"), (3, 1, 1, 1, "Cy Do", "Do", None), (4, 1, 1, 1, "Ed Fo", "Fo", None), (5, 1, 1, 1, "Gi Go", "Go", "w"), (6, 1, 1, 2, "Gi Go", "Go", "W"), (7, 1, 1, 1, None, None, None), (8, 1, 1, 3, "Jo Ko", "Ko", "X"), (9, 1, 1, 3, "Jo Ko", "Ko", "X")]
    got = {r["player"]: (r["id"], r["match_class"], r["n_appearances"]) for r in player_crosswalk(spark.createDataFrame(apps, seen), spark.createDataFrame(rows, roster)).collect()}
    assert got == {1: ("a", "MATCHED_EXACT", 2), 2: ("c", "MATCHED_CORROBORATED", 1), 3: (None, "AMBIGUOUS", 1), 4: ("d", "MATCHED_EXACT", 1), 5: ("e", "MATCHED_CORROBORATED", 1), 6: (None, "UNMATCHED", 1), 7: (None, "UNMATCHED", 1), 8: (None, "AMBIGUOUS", 1), 9: (None, "AMBIGUOUS", 1)}


def versions(spark, *rows):
    return spark.createDataFrame([(k, x, datetime(2020, 1, s) if s else None, datetime(2020, 1, a), True) for k, x, s, a in rows], "k int, x int, first_seen_at timestamp_ntz, available_at timestamp_ntz, estimated boolean")


def test_outcomes_are_corrected_from_when_they_were_seen(spark):
    stored = versions(spark, (1, 1, 1, 1), (1, 2, 2, 2), (2, 5, 1, 1), (None, 7, 1, 1))
    batch = versions(spark, (1, 1, 5, 3), (2, 5, 5, 3), (None, 8, 5, 9), (4, 1, 5, 3), (4, 1, 5, 3), (4, 1, 6, 2))
    got = S.append_outcomes(stored, batch, ["k"], ["x"], estimated="estimated").collect()
    assert sorted(((r["k"], r["x"], r["first_seen_at"].day, r["available_at"].day, r["estimated"]) for r in got), key=str) == [(1, 1, 5, 5, False), (4, 1, 5, 3, True), (None, 8, 5, 9, False)]
    assert S.append_outcomes(stored, batch.limit(0), ["k"], ["x"]).count() == 0 and S.append_outcomes(stored.limit(0), batch, ["k"], ["x"]).count() == 4


@pytest.mark.parametrize("rows, reason", [([(1, 3, 2, 2)], "no later"), ([(9, 3, None, 2)], "when it was seen"), ([(9, 3, 2, 2), (9, 4, 2, 2)], "two contents"), ([(None, 3, 2, 2), (None, 4, 2, 2)], "two contents")])
def test_outcomes_refuse(spark, rows, reason):
    with pytest.raises((ValueError, PySparkException), match=reason):
        S.append_outcomes(versions(spark, (1, 1, 1, 1), (1, 2, 2, 2)), versions(spark, *rows), ["k"], ["x"]).collect()


def test_moments_of_groups_with_nulls_no_rows_or_no_weight(spark):
    from tidemark.operators.state import moments_or_default

    rows = spark.createDataFrame([(1, 2.0, 1.0), (1, None, 1.0), (2, 5.0, 0.0), (None, 3.0, 2.0)], "g int, x double, weight double")
    got = {r["g"]: (r["mean"], r["variance"]) for r in moments_or_default(rows, spark.createDataFrame([(1,), (2,), (3,), (None,), (1,)], "g int"), ["g"], "x", 7.0, 8.0).collect()}
    assert got == {1: (1.0, 1.0), 2: (7.0, 8.0), 3: (7.0, 8.0), None: (3.0, 1e-9)}


def test_totals_of_folds_are_those_of_copied_rows(spark):
    from tidemark.operators.calibration import fold_totals, walk_forward

    rows = spark.createDataFrame([(s, float(i) if i % 3 else None) for i, s in enumerate([2001, 2001, 2003, 2004, 2004, 2004, None])], "season int, x double")
    want = walk_forward(rows, "season").groupBy("fold", "role").agg(F.count("*").alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("sum_x"), F.count("x").alias("n_x"))
    assert sorted(map(tuple, fold_totals(rows, "season", ["x"]).collect())) == sorted(map(tuple, want.collect()))
    assert fold_totals(rows.where("season = 2001"), "season", ["x"]).count() == 0


def test_event_times_need_their_column(spark):
    from tidemark.operators.timing import event_time_known

    with pytest.raises(ValueError, match="event_at"):
        event_time_known(spark.range(1), "event_at")
