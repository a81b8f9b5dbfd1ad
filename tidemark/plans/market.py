"""Odds, quotes, closing lines and settlement; quotes are lineitems with odds made from discount and tax."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import odds
from tidemark.operators import evaluation, pit
from tidemark.operators.clv import line_units
from tidemark.plans.common import Registry, rounded, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
OVER, UNDER = "CAST(-110 - 1000 * l_discount AS INTEGER)", "CAST(100 + 1000 * l_tax AS INTEGER)"
QUOTES = f"q AS (SELECT *, {OVER} AS over_odds, {UNDER} AS under_odds, -({OVER}) / (100.0 - ({OVER})) AS qo, 100.0 / (100.0 + ({UNDER})) AS qu FROM lineitem)"


def _quotes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumns({"over_odds": F.round(F.lit(-110) - F.col("l_discount") * 1000).cast("int"), "under_odds": F.round(F.lit(100) + F.col("l_tax") * 1000).cast("int")})


@R.add(f"WITH {QUOTES} SELECT l_orderkey, l_linenumber, over_odds, under_odds, round(qo / (qo + qu), 6) AS fair_over, round(qo + qu, 6) AS overround, round((qo + qu - 1) / (qo + qu), 6) AS hold FROM q")
def two_sided_devig(spark, sf_dir):
    o, u = F.col("over_odds"), F.col("under_odds")
    return _quotes(spark, sf_dir).select("l_orderkey", "l_linenumber", o, u, rounded(odds.fair(o, u)).alias("fair_over"), rounded(odds.overround(o, u)).alias("overround"), rounded(odds.hold(o, u)).alias("hold"))


@R.add(f"""WITH {QUOTES} SELECT l_orderkey, l_linenumber, round(qo, 6) AS implied, round(1 + 100.0 / -over_odds, 6) AS decimal_odds, round(CASE WHEN qu >= 0.5 THEN -100 * qu / (1 - qu) ELSE 100 * (1 - qu) / qu END, 4) AS american FROM q""")
def odds_conversions(spark, sf_dir):
    return _quotes(spark, sf_dir).select("l_orderkey", "l_linenumber", rounded(odds.implied(F.col("over_odds"))).alias("implied"), rounded(odds.decimal(F.col("over_odds"))).alias("decimal_odds"), F.round(odds.american(odds.implied(F.col("under_odds"))), 4).alias("american"))


@R.add(f"""
    WITH {QUOTES}, e AS (SELECT l_orderkey, l_linenumber, l_quantity / 60.0 AS p, CASE WHEN l_linenumber = 3 THEN 0.05 ELSE 0 END AS push, under_odds / 100.0 AS gain FROM q)
    SELECT l_orderkey, l_linenumber, round(p * gain - (1 - p - push), 6) AS ev, round(greatest(0, (p / (1 - push) * gain - (1 - p / (1 - push))) / gain), 6) AS kelly FROM e""")
def expected_value_and_stake(spark, sf_dir):
    p, push = F.col("l_quantity") / 60.0, F.when(F.col("l_linenumber") == 3, 0.05).otherwise(0.0)
    return _quotes(spark, sf_dir).select("l_orderkey", "l_linenumber", rounded(odds.expected_value(p, push, F.col("under_odds"))).alias("ev"), rounded(odds.kelly(p, push, F.col("under_odds"))).alias("kelly"))


@R.add("""
    WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS n FROM lineitem) WHERE n = 1)
    SELECT l_orderkey, round(median(l_quantity), 6) AS total, round(median(l_discount), 6) AS spread, count(*) AS books FROM l GROUP BY 1""")
def median_consensus(spark, sf_dir):
    from tidemark.sources.tables import keep_one

    last = keep_one(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], [F.col("l_shipdate").desc(), F.col("l_linenumber").desc(), F.col("l_partkey").desc()])
    return last.groupBy("l_orderkey").agg(rounded(F.median("l_quantity")).alias("total"), rounded(F.median("l_discount")).alias("spread"), F.count("*").alias("books"))


@R.add("""
    WITH c AS (SELECT CASE WHEN l_quantity IS NULL THEN 'missing_line' WHEN l_shipdate > TIMESTAMP '1998-06-01' THEN 'future_receipt' WHEN l_discount = 0 THEN 'placeholder' WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 'stale' ELSE 'supported' END AS reason, l_suppkey FROM lineitem)
    SELECT reason, count(*) AS n, count(DISTINCT l_suppkey) AS books FROM c GROUP BY 1""")
def quote_exclusions(spark, sf_dir):
    """Each quote's first reason to leave it out, counted."""
    at = F.col("l_shipdate")
    reason = F.when(F.col("l_quantity").isNull(), "missing_line").when(at > F.expr("TIMESTAMP_NTZ'1998-06-01 00:00:00'"), "future_receipt").when(F.col("l_discount") == 0, "placeholder").when(at < F.expr("TIMESTAMP_NTZ'1993-01-01 00:00:00'"), "stale").otherwise("supported")
    return table(spark, sf_dir, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("books"))


CLOSE = """c AS (SELECT l_suppkey, l_partkey % 20 AS prop, count(DISTINCT (l_quantity, l_discount)) AS n_variants, min(l_quantity) AS q, min(l_discount) AS d FROM (
        SELECT *, rank() OVER (PARTITION BY l_suppkey, l_partkey % 20 ORDER BY l_shipdate DESC) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate + INTERVAL 60 DAY - INTERVAL 10 MINUTE) WHERE n = 1 GROUP BY 1, 2)"""


@R.add(f"WITH {CLOSE} SELECT l_suppkey, prop, n_variants, CASE WHEN n_variants = 1 THEN q END AS l_quantity, CASE WHEN n_variants = 1 THEN d END AS l_discount FROM c")
def closing_lines(spark, sf_dir):
    """The last quote of each book and prop that came in time; quotes that contradict each other at that time are flagged."""
    return _close(spark, sf_dir).drop("l_shipdate")


def _close(spark, sf_dir):
    quotes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), "l_suppkey", (F.col("l_partkey") % 20).alias("prop"), "l_shipdate", "l_quantity", "l_discount")
    kickoffs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("kickoff"))
    return pit.close_of(quotes, kickoffs, "game", ["l_suppkey", "prop"], "l_shipdate", "kickoff", "10 MINUTES", ["l_quantity", "l_discount"])


@R.add(f"""
    WITH {CLOSE}, e AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey % 20 AS prop, l_quantity AS line FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN n_variants = 1 THEN CASE WHEN l_linenumber % 3 = 1 THEN line - q ELSE q - line END END AS line_value, n_variants IS NULL OR n_variants > 1 AS closing_line_missing, coalesce(n_variants = 1 AND abs(q - line) <= 1e-12, false) AS same_line FROM e LEFT JOIN c USING (l_suppkey, prop)""")
def closing_line_value(spark, sf_dir):
    entry = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") % 20).alias("prop"), F.col("l_quantity").alias("line"))
    joined = entry.join(_close(spark, sf_dir).select("l_suppkey", "prop", F.col("l_quantity").alias("close")), ["l_suppkey", "prop"], "left")
    moved = line_units(F.when(F.col("l_linenumber") % 3 == 1, "UNDER").otherwise("OVER"), F.col("line"), F.col("close"))
    return joined.select("l_orderkey", "l_linenumber", moved.alias("line_value"), F.col("close").isNull().alias("closing_line_missing"), F.coalesce(odds.same_line(F.col("close"), F.col("line")), F.lit(False)).alias("same_line"))


SETTLED = f"""s AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'OVER' WHEN l_linenumber % 3 = 1 THEN 'UNDER' ELSE 'HIT' END AS side FROM q),
    r AS (SELECT *, CASE WHEN side <> 'HIT' AND l_quantity = 25 THEN NULL WHEN side = 'OVER' THEN (l_quantity > 25)::INT WHEN side = 'UNDER' THEN (l_quantity < 25)::INT ELSE (l_quantity >= 25)::INT END AS won FROM s),
    f AS (SELECT *, CASE won WHEN 1 THEN under_odds / 100.0 WHEN 0 THEN -1 ELSE 0 END AS profit FROM r)"""


def _settled(spark, sf_dir):
    side = F.when(F.col("l_linenumber") % 3 == 0, "OVER").when(F.col("l_linenumber") % 3 == 1, "UNDER").otherwise("HIT")
    rows = _quotes(spark, sf_dir).withColumn("side", side).withColumn("won", odds.outcome(F.col("side"), F.col("l_quantity"), F.lit(25.0)))
    return rows.withColumn("profit", odds.profit(F.col("won"), F.col("under_odds")))


@R.add(f"WITH {QUOTES}, {SETTLED} SELECT l_orderkey, l_linenumber, side, won, round(profit, 6) AS profit FROM f")
def settlement(spark, sf_dir):
    return _settled(spark, sf_dir).select("l_orderkey", "l_linenumber", "side", "won", rounded("profit").alias("profit"))


@R.add(f"""
    WITH {QUOTES}, {SETTLED},
         w AS (SELECT l_suppkey, profit, sum(profit) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS i FROM f),
         p AS (SELECT *, greatest(max(run) OVER (PARTITION BY l_suppkey ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS peak FROM w)
    SELECT l_suppkey, count(*) AS bets, round(sum(profit), 6) AS profit, round(max(peak - run), 6) AS max_drawdown FROM p GROUP BY 1""")
def running_drawdown(spark, sf_dir):
    out = evaluation.drawdown(_settled(spark, sf_dir), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "profit")
    return out.select("l_suppkey", "bets", rounded("profit").alias("profit"), rounded("max_drawdown").alias("max_drawdown"))


@R.add(f"""
    WITH {QUOTES}, e AS (SELECT l_orderkey, l_linenumber, round(l_quantity / 60.0 * under_odds / 100.0 - (1 - l_quantity / 60.0), 6) AS ev FROM q)
    SELECT l_orderkey, arg_max(l_linenumber, (ev, l_linenumber)) AS l_linenumber, max(ev) AS ev FROM e GROUP BY 1""")
def best_side(spark, sf_dir):
    p = F.col("l_quantity") / 60.0
    rows = _quotes(spark, sf_dir).select("l_orderkey", "l_linenumber", rounded(odds.expected_value(p, F.lit(0.0), F.col("under_odds"))).alias("ev"))
    return rows.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("ev", "l_linenumber")).alias("l_linenumber"), F.max("ev").alias("ev"))


@R.add("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def top_by_value(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


@R.add("""
    WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity / 51.0 AS p, 0.2 + l_tax * 5 AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.3 * ln(p / (1 - p)) + 0.7 * ln(q / (1 - q))))), 6) AS blended FROM b""")
def blended_probability(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rounded(odds.logit_blend(F.col("l_quantity") / 51.0, F.lit(0.2) + F.col("l_tax") * 5, 0.3)).alias("blended"))


@R.add("""
    SELECT o_orderkey, round((o_totalprice / 5000 - 3.5) / 2, 6) AS home_points, round((o_totalprice / 5000 + 3.5) / 2, 6) AS visitor_points FROM orders""")
def implied_points(spark, sf_dir):
    total = F.col("o_totalprice") / 5000
    return table(spark, sf_dir, "orders").select("o_orderkey", rounded(odds.implied_points(total, F.lit(3.5), F.lit(True))).alias("home_points"), rounded(odds.implied_points(total, F.lit(3.5), F.lit(False))).alias("visitor_points"))
