"""Closing line value of every line: books are suppliers, props are parts modulo 20, sides follow the line number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import odds
from tidemark.operators import clv, pit
from tidemark.plans.common import Registry, rounded, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
OVER, UNDER = "CAST(round(-110 - 1000 * l_discount) AS INTEGER)", "CAST(round(100 + 1000 * l_tax) AS INTEGER)"
VALUED = f"""
    q AS (SELECT *, l_partkey % 20 AS prop, {OVER} AS o, {UNDER} AS u FROM lineitem),
    k AS (SELECT l_suppkey, prop, l_quantity, o, u, rank() OVER (PARTITION BY l_suppkey, prop ORDER BY l_shipdate DESC) AS n FROM q JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate + INTERVAL 60 DAY - INTERVAL 10 MINUTE),
    c AS (SELECT l_suppkey, prop, min(l_quantity) AS cl, min(o) AS co, min(u) AS cu FROM k WHERE n = 1 GROUP BY 1, 2 HAVING count(DISTINCT (l_quantity, o, u)) = 1),
    e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, prop, CASE l_linenumber % 3 WHEN 0 THEN 'OVER' WHEN 1 THEN 'UNDER' ELSE 'HIT' END AS side, l_quantity AS line, CASE WHEN l_linenumber % 3 = 1 THEN u ELSE o END AS odds,
            CASE WHEN l_quantity <> 30 THEN l_quantity / 60 END AS fair FROM q),
    j AS (SELECT e.*, cl, cl IS NULL AS missing, CASE side WHEN 'UNDER' THEN cu ELSE co END AS closing, co / (co - 100.0) AS io, 100.0 / (100.0 + cu) AS iu,
            coalesce(cl IS NOT NULL AND (side = 'HIT' OR abs(cl - line) <= 1e-12), false) AS comparable FROM e LEFT JOIN c USING (l_suppkey, prop)),
    v AS (SELECT *, CASE WHEN side = 'OVER' THEN io / (io + iu) WHEN side = 'UNDER' THEN iu / (io + iu) END AS close_fair,
            CASE WHEN missing THEN 'MISSING_AT_CLOSE' WHEN side = 'HIT' THEN 'QUOTED_ONE_SIDED' WHEN comparable THEN 'QUOTED_SAME_LINE' ELSE 'QUOTED_MOVED_LINE' END AS close_availability FROM j),
    w AS (SELECT *, CASE WHEN comparable THEN close_fair - fair END AS p, CASE WHEN comparable THEN 100 * ((CASE WHEN odds < 0 THEN 100.0 / -odds ELSE odds / 100.0 END) - (CASE WHEN closing < 0 THEN 100.0 / -closing ELSE closing / 100.0 END)) END AS cents,
            CASE WHEN side = 'OVER' THEN cl - line WHEN side = 'UNDER' THEN line - cl END AS units FROM v)"""


def _valued(spark, sf_dir):
    quotes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 20).alias("prop"), "l_shipdate", F.col("l_quantity").alias("line"), F.expr(OVER).alias("over"), F.expr(UNDER).alias("under"))
    kickoffs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("kickoff"))
    close = pit.close_of(quotes, kickoffs, "l_orderkey", ["l_suppkey", "prop"], "l_shipdate", "kickoff", "10 MINUTES", ["line", "over", "under"]).where("n_variants = 1")
    close = close.select("l_suppkey", "prop", F.col("line").alias("close_line"), F.col("over").alias("close_over"), F.col("under").alias("close_under"), F.col("over").alias("close_milestone"))
    side = F.when(F.col("l_linenumber") % 3 == 0, "OVER").when(F.col("l_linenumber") % 3 == 1, "UNDER").otherwise("HIT")
    fair = F.when(F.col("line") != 30, F.col("line") / 60)
    entries = quotes.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "prop", side.alias("side"), "line", F.when(side == "UNDER", F.col("under")).otherwise(F.col("over")).alias("odds"), fair.alias("fair"))
    return clv.value(entries, close, ["l_suppkey", "prop"])


@R.add(f"""
    WITH {VALUED}
    SELECT l_orderkey, l_linenumber, l_partkey, side, missing AS closing_line_missing, close_availability, cl AS closing_line, closing AS closing_odds, round(close_fair, 6) AS closing_market_fair, comparable AS price_clv_comparable,
        round(p, 6) AS clv_probability, round(cents, 4) AS clv_cents, units AS clv_line_units FROM w""")
def closing_value_fields(spark, sf_dir):
    """Line units with the sign of the side, price value in cents and probability where the event is the same, and how the close was quoted."""
    return _valued(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "side", "closing_line_missing", "close_availability", "closing_line", "closing_odds", rounded("closing_market_fair").alias("closing_market_fair"), "price_clv_comparable", rounded("clv_probability").alias("clv_probability"), F.round("clv_cents", 4).alias("clv_cents"), "clv_line_units")


@R.add(f"""
    WITH {VALUED}
    SELECT prop, l_suppkey, close_availability, grouping(prop) * 4 + grouping(l_suppkey) * 2 + grouping(close_availability) AS slice, count(*) AS bets, count(*) FILTER (WHERE missing) AS n_missing, count(*) FILTER (WHERE comparable) AS n_comparable,
        count(p) AS n_clv_probability, round(avg(p), 6) AS mean_clv_probability, count(cents) AS n_clv_cents, round(avg(cents), 4) AS mean_clv_cents, count(units) AS n_clv_line_units, round(avg(units), 6) AS mean_clv_line_units
    FROM w GROUP BY GROUPING SETS ((), (prop), (l_suppkey), (close_availability))""")
def closing_value_summary(spark, sf_dir):
    """Counts and means by prop, book and availability in one pass."""
    out = clv.summary(_valued(spark, sf_dir), ["prop", "l_suppkey", "close_availability"])
    return out.select("prop", "l_suppkey", "close_availability", "slice", "bets", "n_missing", "n_comparable", "n_clv_probability", rounded("mean_clv_probability").alias("mean_clv_probability"), "n_clv_cents", F.round("mean_clv_cents", 4).alias("mean_clv_cents"), "n_clv_line_units", rounded("mean_clv_line_units").alias("mean_clv_line_units"))


@R.add(f"""
    WITH {VALUED}, b AS (SELECT *, line > 25 AS won FROM w WHERE line <> 25),
         r AS (SELECT l_suppkey, p, CASE WHEN won THEN CASE WHEN odds < 0 THEN 100.0 / -odds ELSE odds / 100.0 END ELSE -1 END AS profit, missing FROM b)
    SELECT l_suppkey, count(*) AS bets, round(avg(profit), 6) AS roi, count(p) AS n_clv, round(avg(p), 6) AS mean_clv, round(avg((p > 0)::INT), 6) AS share_positive FROM r GROUP BY 1""")
def trading_with_clv(spark, sf_dir):
    """Return on bets, and closing value over those bets only that have a close."""
    rows = _valued(spark, sf_dir).where("line <> 25")
    profit = F.when(F.col("line") > 25, odds.decimal(F.col("odds")) - 1.0).otherwise(-1.0)
    clv_ = F.col("clv_probability")
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("bets"), rounded(F.avg(profit)).alias("roi"), F.count(clv_).alias("n_clv"), rounded(F.avg(clv_)).alias("mean_clv"), rounded(F.avg((clv_ > 0).cast("double"))).alias("share_positive"))
