"""Values as providers write them, made from the columns of parts, customers, orders and events, and what they are read as."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parsing as P, text as T
from tidemark.plans.common import Registry, rounded, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
#: The same text in both engines.
HEIGHT = "CASE p_size % 6 WHEN 0 THEN concat(p_size + 40) WHEN 1 THEN concat(p_size % 3 + 5, chr(39), ' ', p_size % 12, chr(34)) WHEN 2 THEN concat(p_size % 3 + 5, '-', p_size % 12) WHEN 3 THEN concat(p_size, '.5 in') WHEN 4 THEN 'tall' END"
WEIGHT = "CASE p_size % 4 WHEN 0 THEN concat(p_size + 150, ' lbs') WHEN 1 THEN concat('about ', p_size, '.25') WHEN 2 THEN concat('-', p_size) ELSE 'heavy' END"
SERVED = "CASE p_size % 4 WHEN 0 THEN 'R' WHEN 1 THEN ' Rookie ' WHEN 2 THEN concat(p_size, 'th season') ELSE 'unknown' END"


@R.add(f"""
    WITH r AS (SELECT p_partkey, {HEIGHT} AS h, {WEIGHT} AS w, {SERVED} AS e FROM part)
    SELECT p_partkey, CASE WHEN regexp_full_match(h, '[0-9]+([.][0-9]+)?( *in)?') THEN regexp_extract(h, '^[0-9]+([.][0-9]+)?')::DOUBLE
               WHEN regexp_full_match(h, '[0-9]+[-''] *[0-9]+"?') THEN regexp_extract(h, '^([0-9]+)', 1)::DOUBLE * 12 + regexp_extract(h, '[-''] *([0-9]+)', 1)::DOUBLE END AS inches,
           CASE WHEN try_cast(regexp_extract(w, '-?[0-9]+([.][0-9]+)?') AS DOUBLE) > 0 THEN try_cast(regexp_extract(w, '-?[0-9]+([.][0-9]+)?') AS DOUBLE) END AS pounds,
           CASE WHEN lower(trim(e)) IN ('r', 'rookie', 'rook') THEN 0 ELSE try_cast(regexp_extract(e, '[0-9]+') AS INT) END AS experience FROM r""")
def body_measures(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select("p_partkey", F.expr(HEIGHT).alias("h"), F.expr(WEIGHT).alias("w"), F.expr(SERVED).alias("e"))
    return raw.select("p_partkey", P.inches(F.col("h")).alias("inches"), P.pounds(F.col("w")).alias("pounds"), P.experience(F.col("e")).alias("experience"))


CODE = "CASE p_size % 9 WHEN 0 THEN 'QB' WHEN 1 THEN 'hb' WHEN 2 THEN ' TB' WHEN 3 THEN 'FB' WHEN 4 THEN 'wr ' WHEN 5 THEN 'TE' WHEN 6 THEN 'pk' WHEN 7 THEN 'LB' END"
STATUS = "CASE p_size % 8 WHEN 0 THEN 'Questionable' WHEN 1 THEN 'NFI-A' WHEN 2 THEN 'pup_r' WHEN 3 THEN ' Healthy ' WHEN 4 THEN 'Injured Reserve' WHEN 5 THEN 'day to day' WHEN 6 THEN 'd' END"


@R.add(f"""
    WITH r AS (SELECT p_partkey, upper(trim({CODE})) AS c, replace(replace(lower(trim({STATUS})), '-', ' '), '_', ' ') AS s FROM part)
    SELECT p_partkey, CASE WHEN c IN ('QB', 'FB', 'WR', 'TE') THEN c WHEN c IN ('RB', 'HB', 'TB') THEN 'RB' WHEN c IN ('K', 'PK') THEN 'K' ELSE 'OTHER' END AS position_group,
        CASE s WHEN 'questionable' THEN 'QUESTIONABLE' WHEN 'nfi a' THEN 'NFI' WHEN 'pup r' THEN 'PUP' WHEN 'healthy' THEN 'ACTIVE' WHEN 'injured reserve' THEN 'IR' WHEN 'd' THEN 'DOUBTFUL' ELSE 'UNKNOWN_PROVIDER_STATUS' END AS injury_status FROM r""")
def positions_and_injuries(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select("p_partkey", F.expr(CODE).alias("c"), F.expr(STATUS).alias("s"))
    return raw.select("p_partkey", P.position_group(F.col("c")).alias("position_group"), P.injury_status(F.col("s")).alias("injury_status"))


PLAY = "CASE l_linenumber WHEN 1 THEN 'Rush Penalty' WHEN 2 THEN 'pass' WHEN 3 THEN 'QB Kneel rush' WHEN 4 THEN 'field_goal good' WHEN 5 THEN 'kickoff return' WHEN 6 THEN 'Sack of pass' WHEN 7 THEN 'timeout' END"


@R.add(f"""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, lower(concat_ws(' ', {PLAY}, CASE WHEN l_quantity > 45 THEN 'Punt' END)) AS t FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN t LIKE '%kneel%' THEN 'KNEEL' WHEN t LIKE '%spike%' THEN 'SPIKE' WHEN t LIKE '%sack%' THEN 'SACK' WHEN contains(t, 'field goal') OR contains(t, 'field_goal') THEN 'FIELD_GOAL'
        WHEN t LIKE '%punt%' THEN 'PUNT' WHEN t LIKE '%kickoff%' THEN 'KICKOFF' WHEN t LIKE '%penalty%' THEN 'PENALTY' WHEN t LIKE '%rush%' OR t LIKE '%run%' THEN 'RUN' WHEN t LIKE '%pass%' THEN 'PASS' ELSE 'OTHER' END AS family FROM r""")
def play_families(spark, sf_dir):
    kind = F.when(F.col("l_quantity") > 45, "Punt")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", P.play_family(F.expr(PLAY), kind).alias("family"))


@R.add("""
    SELECT o_orderkey, (o_custkey % 45) * 60 + o_orderkey % 60 AS seconds, CASE WHEN o_orderkey % 7 > 0 THEN round(o_totalprice / 1000, 1)::DECIMAL(18,1) END::DOUBLE AS line, epoch_us(o_orderdate) AS at_micros FROM orders""")
def clocks_lines_and_times(spark, sf_dir):
    """Possession clocks, decimal lines and times without a zone, as texts and back."""
    clock = F.format_string("%d:%02d", F.col("o_custkey") % 45, F.col("o_orderkey") % 60)
    text = F.when(F.col("o_orderkey") % 7 > 0, F.format_string(" %.1f ", F.round(F.col("o_totalprice") / 1000, 1)))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.possession_seconds(clock).cast("long").alias("seconds"), P.line(text).cast("double").alias("line"), P.utc_micros(F.col("o_orderdate").cast("timestamp")).alias("at_micros"))


NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@R.add(f"""
    WITH d AS (SELECT s_suppkey, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(concat_ws(':', 'team', 'provider', s_suppkey))) AS h, sha256(concat_ws('|', s_suppkey, s_name)) AS k FROM supplier)
    SELECT s_suppkey, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS id,
        substr(k, 1, 32) AS prediction_id, ('0x' || substr(k, 1, 15))::BIGINT AS key60, round(('0x' || substr(k, 1, 13))::BIGINT / 4503599627370496.0, 6) AS uniform FROM d""")
def canonical_ids(spark, sf_dir):
    """UUIDs of teams, ids of predictions, and the 60-bit key and uniform number that come from a digest."""
    digest = T.stable_id(F.col("s_suppkey"), F.col("s_name"))
    at = P.canonical_id(NAMESPACE, F.lit("team"), F.lit("provider"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", at.alias("id"), F.substring(digest, 1, 32).alias("prediction_id"), T.key60(digest).alias("key60"), rounded(T.uniform(digest)).alias("uniform"))


@R.add("SELECT c_custkey, json_object('c_custkey', c_custkey, 'c_mktsegment', c_mktsegment, 'c_nationkey', c_nationkey)::VARCHAR AS doc, sha256(json_object('c_custkey', c_custkey, 'c_mktsegment', c_mktsegment, 'c_nationkey', c_nationkey)::VARCHAR) AS sha256 FROM customer")
def canonical_documents(spark, sf_dir):
    doc = P.canonical_json("c_nationkey", "c_custkey", "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", doc.alias("doc"), F.sha2(doc, 256).alias("sha256"))


@R.add("""
    WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN 'soon' END AS opened, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS updated, ts FROM events)
    SELECT event_id, epoch_us(date_trunc('second', CASE WHEN event_id % 3 = 0 THEN ts ELSE ts + INTERVAL 1 HOUR END)) AS opened_at FROM r""")
def opening_times(spark, sf_dir):
    form = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    opened = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", form)).when(F.col("event_id") % 3 == 1, "soon")
    updated = F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), form)
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(P.opened(opened, updated).cast("timestamp")).alias("opened_at"))
