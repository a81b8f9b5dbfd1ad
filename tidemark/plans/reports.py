"""Reports: closing line value, trading, interval scores, first scorers, prior games, feeds, settlement rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import odds
from tidemark.operators import reports as P
from tidemark.plans import market as M
from tidemark.plans.common import Registry, rounded, table, text_time
from tidemark.plans.snapshots import SQL_CUTOFF, cutoff

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.add(f"""
    WITH {M.CLOSE}, e AS (SELECT l_suppkey, l_partkey % 20 AS prop, l_quantity AS line, l_returnflag, l_shipmode FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem)),
         j AS (SELECT l_returnflag AS flag, l_shipmode AS status, CASE WHEN n_variants = 1 THEN q - line END AS v FROM e LEFT JOIN c USING (l_suppkey, prop))
    SELECT flag, status, grouping(flag) * 2 + grouping(status) AS slice, count(*) AS bets, count(v) AS with_close, round(avg(v), 6) AS mean_value, round(avg((v > 0)::INT), 6) AS share_positive FROM j GROUP BY GROUPING SETS ((), (flag), (status))""")
def line_value_summary(spark, sf_dir):
    entry = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 20).alias("prop"), F.col("l_quantity").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    joined = entry.join(M._close(spark, sf_dir).select("l_suppkey", "prop", F.col("l_quantity").alias("close")), ["l_suppkey", "prop"], "left").withColumn("v", F.col("close") - F.col("line"))
    out = P.line_value_summary(joined, ["flag", "status"], "v")
    return out.select("flag", "status", "slice", "bets", "with_close", rounded("mean_value").alias("mean_value"), rounded("share_positive").alias("share_positive"))


@R.add(f"""
    WITH {M.QUOTES}, {M.SETTLED}, e AS (SELECT *, l_quantity / 60.0 * under_odds / 100.0 - (1 - l_quantity / 60.0) AS ev FROM f)
    SELECT l_suppkey, count(*) AS bets, round(sum(ev), 4) AS expected, round(sum(profit), 4) AS profit, round(avg(profit), 6) AS roi, round(avg((profit > 0)::INT), 6) AS hit_rate FROM e GROUP BY 1""")
def trading_summary(spark, sf_dir):
    rows = M._settled(spark, sf_dir).withColumn("ev", odds.expected_value(F.col("l_quantity") / 60.0, F.lit(0.0), F.col("under_odds")))
    out = P.trading(rows, ["l_suppkey"], ["l_shipdate"], "profit", "ev")
    return out.select("l_suppkey", "bets", F.round("expected", 4).alias("expected"), F.round("profit", 4).alias("profit"), rounded("roi").alias("roi"), rounded("hit_rate").alias("hit_rate"))


@R.add("""
    WITH q AS (SELECT l_returnflag, quantile_disc(l_quantity, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q FROM lineitem GROUP BY 1),
         r AS (SELECT l_returnflag, l_quantity AS y, q[1] AS q05, q[2] AS q10, q[3] AS q25, q[4] AS q50, q[5] AS q75, q[6] AS q90, q[7] AS q95 FROM lineitem JOIN q USING (l_returnflag)),
         s AS (SELECT *, (0.5 * abs(y - q50)
               + 0.25 * (q75 - q25 + greatest(q25 - y, 0) * 4 + greatest(y - q75, 0) * 4)
               + 0.1 * (q90 - q10 + greatest(q10 - y, 0) * 10 + greatest(y - q90, 0) * 10)
               + 0.05 * (q95 - q05 + greatest(q05 - y, 0) * 20 + greatest(y - q95, 0) * 20)) / 3.5 AS w FROM r)
    SELECT l_returnflag, count(*) AS n, round(avg(abs(y - q50)), 6) AS mae, round(avg(w), 6) AS wis, round(avg((y BETWEEN q25 AND q75)::INT), 6) AS cover50, round(avg((y BETWEEN q10 AND q90)::INT), 6) AS cover80, round(avg((y BETWEEN q05 AND q95)::INT), 6) AS cover90 FROM s GROUP BY 1""")
def interval_scores(spark, sf_dir):
    """Each line's count against the percentiles of its return flag."""
    from tidemark.operators.distributions import order_statistics

    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    qs = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
    joined = rows.join(order_statistics(rows, ["l_returnflag"], "l_quantity", qs), "l_returnflag")
    out = P.interval_scores(joined, ["l_returnflag"], F.col("l_quantity"), {q: F.col(f"p{round(q * 100):02d}") for q in qs})
    return out.select("l_returnflag", "n", *[rounded(c).alias(c) for c in ("mae", "wis", "cover50", "cover80", "cover90")])


@R.add("""
    WITH f AS (SELECT l_orderkey, arg_min(CASE WHEN l_returnflag = 'R' THEN l_suppkey END, CASE WHEN l_returnflag = 'R' THEN (l_linenumber, l_suppkey) END) AS l_suppkey FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round(count(*) / (SELECT count(*) FROM f), 6) AS p FROM f GROUP BY 1""")
def first_scorers(spark, sf_dir):
    """Draws are orders; the first returned line scores."""
    out = P.first_scorer(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey", F.struct("l_linenumber", "l_suppkey"), F.col("l_returnflag") == "R")
    return out.withColumn("p", rounded("p"))


@R.add("""
    WITH g AS (SELECT o_orderkey, o_custkey, o_orderstatus, year(o_orderdate) * 100 + month(o_orderdate) AS slate FROM orders)
    SELECT o_orderkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey ORDER BY slate RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_prior FROM g""")
def prior_slate_games(spark, sf_dir):
    games = table(spark, sf_dir, "orders").withColumn("slate", F.year("o_orderdate") * 100 + F.month("o_orderdate"))
    return P.prior_games(games, "o_custkey", "slate", F.col("o_orderstatus") == "F").select("o_orderkey", "n_prior")


@R.add(f"""
    SELECT r.event_type, strftime(max(e.ts) FILTER (WHERE e.ts <= {SQL_CUTOFF} AND e.value > 10), '%Y-%m-%d %H:%M:%S') AS last_good
    FROM (SELECT DISTINCT event_type FROM events UNION SELECT 'injuries') r LEFT JOIN events e USING (event_type) GROUP BY 1""")
def feed_status(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    required = events.select("event_type").union(spark.createDataFrame([("injuries",)], "event_type string"))
    return P.feed_status(events, required, "event_type", "ts", cutoff(), F.col("value") > 10).select("event_type", text_time("last_good").alias("last_good"))


@R.add("""
    WITH r(prop, vendor, rule) AS (VALUES ('A', NULL, 'void'), ('N', NULL, 'action'), ('R', NULL, 'half'), ('A', 3, 'action'), ('R', 5, 'void'))
    SELECT l_orderkey, l_linenumber, coalesce(s.rule, d.rule) AS rule FROM lineitem l LEFT JOIN r s ON s.prop = l_returnflag AND s.vendor = l_suppkey % 10 LEFT JOIN r d ON d.prop = l_returnflag AND d.vendor IS NULL""")
def settlement_rules(spark, sf_dir):
    rules = spark.createDataFrame([("A", None, "void"), ("N", None, "action"), ("R", None, "half"), ("A", 3, "action"), ("R", 5, "void")], "prop string, vendor long, rule string")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_suppkey") % 10).alias("book"))
    return P.settle_by_rules(rows, rules, "l_returnflag", "book").select("l_orderkey", "l_linenumber", "rule")
