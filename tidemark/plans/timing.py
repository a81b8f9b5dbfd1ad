"""What was known when: quotes are lineitems received at l_shipdate, games are parts or orders, weeks come from dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import timing as T
from tidemark.plans.common import Registry, table, text_time

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
CUTOFF = "TIMESTAMP '1998-01-01 00:00:00'"
BLOCKED = ["Supplier#000000003", " supplier#000000007 "]


def _cutoff():
    return F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@R.add(f"""
    WITH q AS (SELECT l.*, lower(trim(CASE WHEN s_suppkey % 5 = 0 THEN '  ' ELSE upper(s_name) END)) AS vendor FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey),
         r AS (SELECT l_suppkey, CASE WHEN vendor = '' OR vendor IN ('supplier#000000003', 'supplier#000000007') THEN 'vendor' WHEN l_shipdate > {CUTOFF} THEN 'future_receipt' WHEN l_shipdate < {CUTOFF} - INTERVAL 900 DAY THEN 'stale'
                    WHEN l_discount = 0 AND l_tax = 0 THEN 'placeholder' WHEN l_quantity = 1 THEN 'missing_line' END AS reason FROM q)
    SELECT l_suppkey, coalesce(reason, 'published') AS reason, count(*) AS n FROM r GROUP BY 1, 2""")
def quote_publication(spark, sf_dir):
    """The first reason to leave a quote out, of all rules in their order, counted by book."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 5 == 0, "  ").otherwise(F.upper("s_name")).alias("vendor"))
    quotes = _lines(spark, sf_dir).withColumn("collector_received_at", F.col("l_shipdate")).join(names, "l_suppkey")
    known = T.knowledge_time(quotes, "live")
    reason = T.exclusion_reason([
        ("vendor", ~T.vendor_allowed(F.col("vendor"), BLOCKED)), ("future_receipt", F.col("known_at") > _cutoff()), ("stale", F.col("known_at") < _cutoff() - F.expr("INTERVAL 900 DAYS")),
        ("placeholder", (F.col("l_discount") == 0) & (F.col("l_tax") == 0)), ("missing_line", F.col("l_quantity") == 1),
    ])
    return known.groupBy("l_suppkey", F.coalesce(reason, F.lit("published")).alias("reason")).agg(F.count("*").alias("n"))


@R.add(f"SELECT l_orderkey, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS known_at FROM lineitem WHERE l_shipdate <= {CUTOFF} GROUP BY 1")
def game_market_knowledge(spark, sf_dir):
    quotes = _lines(spark, sf_dir).withColumn("collector_received_at", F.col("l_shipdate"))
    return T.game_knowledge_time(quotes, "l_orderkey", _cutoff(), "live").select("l_orderkey", text_time("known_at").alias("known_at"))


@R.add(f"""
    SELECT l_partkey, l_orderkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC, l_suppkey DESC) AS n FROM lineitem WHERE l_shipdate <= {CUTOFF}) WHERE n = 1 AND l_returnflag IN ('N', 'R')""")
def games_as_of(spark, sf_dir):
    """The last row of each game first, then the filter by status."""
    rows = _lines(spark, sf_dir).withColumn("version", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_suppkey"))
    return T.games_as_of(rows, ["l_partkey"], _cutoff(), "l_shipdate", "version", "l_returnflag", ["N", "R"]).select("l_partkey", "l_orderkey", "l_returnflag")


@R.add("SELECT year(o_orderdate) AS season, count(*) AS n FROM orders WHERE CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CASE o_orderstatus WHEN 'F' THEN 'Final/OT' WHEN 'O' THEN 'In Progress' ELSE 'Final' END END IS NULL OR o_orderstatus <> 'O' GROUP BY 1")
def final_games(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 11 != 0, F.when(F.col("o_orderstatus") == "F", "Final/OT").when(F.col("o_orderstatus") == "O", "In Progress").otherwise("Final"))
    games = table(spark, sf_dir, "orders").withColumn("status", status)
    return games.where(T.final_or_unknown(F.col("status"))).groupBy(F.year("o_orderdate").cast("long").alias("season")).agg(F.count("*").alias("n"))


@R.add("""
    SELECT l_partkey, strftime(arg_max(l_shipdate, (l_linestatus = 'F', l_shipdate)), '%Y-%m-%d %H:%M:%S') AS kickoff FROM lineitem GROUP BY 1""")
def game_kickoffs(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("final", F.col("l_linestatus") == "F")
    return T.kickoffs(rows, "l_partkey", "final", "l_shipdate").select("l_partkey", text_time("kickoff").alias("kickoff"))


@R.add("SELECT l_orderkey, count(DISTINCT l_shipdate) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_shipdate) <> 1")
def kickoff_conflicts(spark, sf_dir):
    return T.conflicting(_lines(spark, sf_dir), ["l_orderkey"], "l_shipdate")


@R.add("""
    WITH w AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, min(l_returnflag) OVER v <> max(l_returnflag) OVER v AS conflict FROM lineitem WINDOW v AS (PARTITION BY l_partkey, year(l_shipdate), month(l_shipdate)))
    SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE conflict) AS n_conflict FROM w GROUP BY 1""")
def weekly_conflicts(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumns({"season": F.year("l_shipdate"), "week": F.month("l_shipdate")})
    return T.conflict_flag(rows, ["l_partkey", "season", "week"], "l_returnflag").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if("conflict").alias("n_conflict"))


@R.add(f"""
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS n FROM lineitem WHERE l_shipdate <= {CUTOFF}) WHERE n = 1""")
def known_versions(spark, sf_dir):
    """The version known at the cutoff, ties decided by four columns and more."""
    out = T.known_version(_lines(spark, sf_dir), ["l_partkey", "l_suppkey"], _cutoff(), "l_shipdate", ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    return out.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


@R.add("""
    SELECT l_partkey, year(l_shipdate) AS season, month(l_shipdate) AS week, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_returnflag IN ('N', 'A') GROUP BY 1, 2, 3 HAVING count(DISTINCT l_suppkey) = 1""")
def historical_membership(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_partkey", F.year("l_shipdate").cast("long").alias("season"), F.month("l_shipdate").cast("long").alias("week"), "l_suppkey", "l_returnflag")
    return T.members_of_week(rows, "l_partkey", "l_suppkey", ["season", "week"], ["N", "A"], "l_returnflag")


@R.add(f"SELECT l_suppkey, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS available_at FROM lineitem WHERE l_shipdate <= {CUTOFF} GROUP BY 1")
def entity_availability(spark, sf_dir):
    return T.latest_available(_lines(spark, sf_dir), "l_suppkey", _cutoff(), "l_shipdate").select("l_suppkey", text_time("available_at").alias("available_at"))


@R.add("""
    WITH s AS (SELECT l_orderkey, max(l_shipdate) FILTER (WHERE l_linestatus = 'F') AS given FROM lineitem GROUP BY 1)
    SELECT o_orderkey, strftime(coalesce(given, o_orderdate + INTERVAL 12 HOUR), '%Y-%m-%d %H:%M:%S') AS available_at, given IS NULL AS available_at_is_estimated FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def result_availability(spark, sf_dir):
    """When results were known: as stated, or else 12 hours after the game, flagged as an estimate."""
    given = _lines(spark, sf_dir).where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("given"))
    at, estimated = T.availability_of_result(F.col("o_orderdate"), 12, F.col("given"))
    return table(spark, sf_dir, "orders").join(given, "o_orderkey", "left").select("o_orderkey", text_time(at).alias("available_at"), estimated.alias("available_at_is_estimated"))


@R.add("""
    WITH r AS (SELECT l_suppkey, CASE WHEN l_quantity = 50 THEN NULL ELSE l_shipdate END AS seen, o_orderdate + INTERVAL 45 DAY AS cutoff, o_orderstatus <> 'P' AS final, l_returnflag <> 'N' AS genuine FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_suppkey, CASE WHEN seen IS NULL THEN 'UNDATED' WHEN seen > cutoff THEN 'LATE' WHEN NOT final THEN 'NOT_FINAL' WHEN genuine THEN 'OBSERVED' ELSE 'ESTIMATED' END AS evidence, count(*) AS n FROM r GROUP BY 1, 2""")
def evidence_classes(spark, sf_dir):
    """What each row proves before its game, counted by book."""
    games = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderdate") + F.expr("INTERVAL 45 DAYS")).alias("cutoff"), (F.col("o_orderstatus") != "P").alias("final"))
    rows = _lines(spark, sf_dir).join(games, "l_orderkey")
    label = T.evidence_class(F.col("l_returnflag") != "N", F.when(F.col("l_quantity") != 50, F.col("l_shipdate")), F.col("cutoff"), F.col("final"))
    return rows.groupBy("l_suppkey", label.alias("evidence")).agg(F.count("*").alias("n"))


@R.add("""
    WITH s AS (SELECT year(o_orderdate) AS season, o_orderkey % 2 AS half, min(o_orderdate) AS first_kickoff, max(o_orderdate) AS last_kickoff FROM orders GROUP BY 1, 2),
         n AS (SELECT *, lead(first_kickoff) OVER (ORDER BY first_kickoff, half) AS following FROM s)
    SELECT season, half FROM n WHERE last_kickoff >= following""")
def slate_overlaps(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("season"), (F.col("o_orderkey") % 2).alias("half"))
    slates = by.agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last_kickoff"))
    slates = slates.withColumns({"first_kickoff": F.struct("first", "half"), "last_kickoff": F.struct("last_kickoff", F.lit(-1).cast("long"))})
    return T.overlapping_slates(slates).select("season", "half")


@R.add(f"""
    WITH c AS (SELECT o_orderkey, o_orderdate AS scheduled, o_orderstatus = 'F' AS done FROM orders)
    SELECT o_orderkey, CASE WHEN done THEN 'DONE' WHEN {CUTOFF} < scheduled THEN 'PENDING' WHEN {CUTOFF} <= scheduled + INTERVAL 30 DAY THEN 'DUE' WHEN {CUTOFF} <= scheduled + INTERVAL 365 DAY THEN 'CATCH_UP' ELSE 'MISSED' END AS state FROM c""")
def checkpoint_states(spark, sf_dir):
    state = T.checkpoint_state(F.col("o_orderdate"), _cutoff(), F.col("o_orderstatus") == "F", "30 DAYS", "365 DAYS")
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"))


@R.add("""
    WITH l AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'click') AS last FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
    SELECT user_id, last IS NULL OR epoch_ms(now) // 1000 - epoch_ms(last) // 1000 >= 3600 * (1 + user_id % 40) AS due FROM l, n""")
def due_collections(spark, sf_dir):
    """Whether each source's next collection is due, by its own cadence."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("last"))
    now = events.agg(F.max("ts").alias("now"))
    return last.crossJoin(F.broadcast(now)).select("user_id", T.due(F.col("last"), F.col("now"), F.lit(3600) * (F.lit(1) + F.col("user_id") % 40)).alias("due"))


@R.add("""
    WITH g AS (SELECT year(o_orderdate) AS season, month(o_orderdate) > 10 AS postseason, week(o_orderdate) % 18 + 1 AS week, o_totalprice, CASE WHEN o_custkey % 10 = 0 THEN '__team' ELSE 'p' || o_custkey END AS player FROM orders)
    SELECT season, postseason, count(*) AS n, count(*) FILTER (WHERE week BETWEEN 1 AND 4) AS n_early, count(*) FILTER (WHERE week >= 14) AS n_late, count(DISTINCT week) AS weeks, round(sum(o_totalprice), 2) AS total FROM g WHERE NOT starts_with(player, '__') GROUP BY 1, 2""")
def season_slices(spark, sf_dir):
    """Games by slate (season, postseason, week), early and late weeks, without synthetic players."""
    player = F.when(F.col("o_custkey") % 10 == 0, "__team").otherwise(F.concat(F.lit("p"), F.col("o_custkey")))
    slate = F.struct(F.year("o_orderdate").cast("long").alias("season"), (F.month("o_orderdate") > 10).alias("postseason"), (F.weekofyear("o_orderdate") % 18 + 1).alias("week"))
    rows = table(spark, sf_dir, "orders").where(~player.startswith("__")).select(slate.alias("slate"), "o_totalprice")
    week = F.col("slate.week")
    return rows.groupBy("slate.season", "slate.postseason").agg(F.count("*").alias("n"), F.count_if(week.between(1, 4)).alias("n_early"), F.count_if(week >= 14).alias("n_late"), F.count_distinct(week).alias("weeks"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add("""
    WITH v AS (SELECT l_orderkey, l_linenumber, count(*) AS n_versions, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1, 2)
    SELECT year(o_orderdate) AS season, month(o_orderdate) AS week, count(*) AS n_outcomes, sum(n_versions)::BIGINT AS n_versions, count(*) FILTER (WHERE n_versions > 1) AS n_corrected, count(*) FILTER (WHERE first_seen <= o_orderdate + INTERVAL 30 DAY) AS visible_30, count(*) FILTER (WHERE first_seen <= o_orderdate + INTERVAL 90 DAY) AS visible_90
    FROM v JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def outcome_report(spark, sf_dir):
    """Versions of each outcome and how many were visible at probe times, by the game's week."""
    versions = _lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_seen"))
    games = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", F.year("o_orderdate").cast("long").alias("season"), F.month("o_orderdate").cast("long").alias("week"))
    seen = lambda days: F.count_if(F.col("first_seen") <= F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAYS")).alias(f"visible_{days}")
    return versions.join(games, "l_orderkey").groupBy("season", "week").agg(F.count("*").alias("n_outcomes"), F.sum("n").alias("n_versions"), F.count_if(F.col("n") > 1).alias("n_corrected"), seen(30), seen(90))
