"""Point-in-time selection over events: entity user_id, source event_type, receipt ts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.plans.common import Registry, rounded, table, text_time

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
CUTOFF = "TIMESTAMP_NTZ'2024-01-15 00:00:00'"
SQL_CUTOFF = "TIMESTAMP '2024-01-15 00:00:00'"
KEY = ["user_id", "event_type"]


def cutoff():
    return F.expr(CUTOFF)


@R.add(f"SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts <= {SQL_CUTOFF}) WHERE n = 1")
def latest_as_of(spark, sf_dir):
    return pit.latest(table(spark, sf_dir, "events"), KEY, cutoff(), "ts", "event_id").select(*KEY, "event_id", "value")


@R.add(f"SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS received FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events WHERE ts <= {SQL_CUTOFF}) WHERE n = 1")
def latest_with_ties(spark, sf_dir):
    return pit.latest_with_ties(table(spark, sf_dir, "events"), ["user_id"], cutoff(), "ts").select("user_id", "event_id", text_time("ts").alias("received"))


@R.add("SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, count(*) AS n_versions FROM events GROUP BY ALL")
def first_and_last_versions(spark, sf_dir):
    return pit.first_and_last(table(spark, sf_dir, "events"), KEY, ["ts", "event_id"], "value")


@R.add(f"SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE ts > {SQL_CUTOFF}) AS n_future, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY event_type")
def point_in_time_audit(spark, sf_dir):
    return pit.audit(table(spark, sf_dir, "events"), ["event_type"], cutoff(), "ts").withColumn("last_seen", text_time("last_seen"))


@R.add(f"SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts <= {SQL_CUTOFF} AND event_id % 7 <> 0 GROUP BY event_type")
def genuine_rows_only(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("estimated", F.col("event_id") % 7 == 0)
    return pit.known_at(rows, cutoff(), "ts", "estimated").groupBy("event_type").agg(F.count("*").alias("n"), rounded(F.sum("value")).alias("total"))


@R.add(f"""
    WITH e AS (SELECT user_id, event_type, date_trunc('day', ts) AS d FROM events WHERE ts <= {SQL_CUTOFF}),
         b AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY d DESC) AS n FROM e) WHERE n = 1),
         l AS (SELECT DISTINCT user_id, event_type FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY d DESC) AS m FROM b) WHERE m = 1)
    SELECT user_id, min(event_type) AS event_type FROM l GROUP BY user_id HAVING count(*) = 1""")
def sole_membership(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("ts") <= cutoff()).withColumn("day", F.date_trunc("day", "ts"))
    return pit.sole_membership(rows, "user_id", "event_type", "day", F.expr(CUTOFF).cast("timestamp"))


@R.add("""
    WITH s AS (SELECT year(o_orderdate) AS season, week(o_orderdate) AS week, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY ALL),
         n AS (SELECT *, lead(a) OVER (ORDER BY season, week) AS c FROM s)
    SELECT season, week, strftime(a, '%Y-%m-%d %H:%M:%S') AS first_kickoff, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_kickoff,
           CAST(floor((epoch_us(b) + epoch_us(c)) / 2) AS BIGINT) AS boundary_us FROM n""")
def slate_boundaries(spark, sf_dir):
    games = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"), F.weekofyear("o_orderdate").alias("week"), F.col("o_orderdate").cast("timestamp").alias("kickoff"))
    out = pit.slate_boundaries(games, ["season", "week"], "kickoff")
    return out.select(F.col("season").cast("long"), F.col("week").cast("long"), text_time("first_kickoff").alias("first_kickoff"), text_time("last_kickoff").alias("last_kickoff"), F.unix_micros("boundary").alias("boundary_us"))


@R.add("""
    SELECT o_orderkey, 'schedule' AS kind, strftime(o_orderdate - INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS available, NULL::DOUBLE AS score FROM orders
    UNION ALL SELECT o_orderkey, 'final', strftime(o_orderdate + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S'), o_totalprice FROM orders""")
def schedule_and_final(spark, sf_dir):
    """Each game as a row without score a week before it, and as a final row half a day after."""
    games = table(spark, sf_dir, "orders")
    kinds = F.array(F.struct(F.lit("schedule").alias("kind"), (F.col("o_orderdate") - F.expr("INTERVAL 7 DAYS")).alias("at")), F.struct(F.lit("final").alias("kind"), (F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")).alias("at")))
    each = games.select("o_orderkey", "o_totalprice", F.explode(kinds).alias("k"))
    return each.select("o_orderkey", "k.kind", text_time("k.at").alias("available"), F.when(F.col("k.kind") == "final", F.col("o_totalprice")).alias("score"))


@R.add("""
    SELECT year(ts) AS season, week(ts) AS week, event_type, strftime(max(ts) + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS available, true AS estimated
    FROM events GROUP BY ALL""")
def weekly_availability(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.year("ts").cast("long").alias("season"), F.weekofyear("ts").cast("long").alias("week"), "event_type").agg((F.max("ts") + F.expr("INTERVAL 24 HOURS")).alias("at"))
    return rows.select("season", "week", "event_type", text_time("at").alias("available"), F.lit(True).alias("estimated"))


@R.add("""
    SELECT o_orderkey, c.name AS checkpoint, strftime(o_orderdate - to_minutes(c.minutes), '%Y-%m-%d %H:%M:%S') AS due
    FROM orders, (VALUES ('T-24h', 1440), ('T-6h', 360), ('T-90m', 90), ('T-30m', 30), ('T-5m', 5)) AS c(name, minutes)
    WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND l_quantity > 40 AND c.name = 'T-24h')""")
def checkpoint_plan(spark, sf_dir):
    """Games that are not over, by each checkpoint before them, less what is already claimed."""
    names = [("T-24h", 1440), ("T-6h", 360), ("T-90m", 90), ("T-30m", 30), ("T-5m", 5)]
    games = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    each = games.select("o_orderkey", "o_orderdate", F.explode(F.array(*[F.struct(F.lit(n).alias("checkpoint"), F.lit(m).alias("minutes")) for n, m in names])).alias("c")).select("o_orderkey", "o_orderdate", "c.*")
    claimed = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("T-24h").alias("checkpoint"))
    due = F.date_format(F.col("o_orderdate") - F.make_dt_interval(mins=F.col("minutes")), "yyyy-MM-dd HH:mm:ss")
    return each.join(claimed, ["o_orderkey", "checkpoint"], "left_anti").select("o_orderkey", "checkpoint", due.alias("due"))


@R.add(f"""
    WITH t AS (SELECT event_id, (epoch_us({SQL_CUTOFF}) - epoch_us(ts)) / 3600000000.0 AS h FROM events)
    SELECT event_id, CASE WHEN h <= 1 THEN 5 WHEN h <= 6 THEN 15 WHEN h <= 24 THEN 60 WHEN h <= 168 THEN 360 ELSE 1440 END AS cadence_minutes FROM t""")
def cadence(spark, sf_dir):
    """How often to look, by bands of the time that is left; the near edge belongs to the band."""
    hours = (F.unix_micros(F.expr(CUTOFF).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600_000_000.0
    bands = F.when(hours <= 1, 5).when(hours <= 6, 15).when(hours <= 24, 60).when(hours <= 168, 360).otherwise(1440)
    return table(spark, sf_dir, "events").select("event_id", bands.alias("cadence_minutes"))
