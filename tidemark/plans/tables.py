"""Sets, keyed writes, checks and lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import quality, resolution
from tidemark.plans.common import Registry, rounded, table
from tidemark.sources import tables as src
from tidemark.streaming import snapshots

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
VERSIONS = ["o_orderkey", "o_orderstatus", "o_totalprice"]


def _scratch(spark) -> str:
    """A folder that driver and executors share; without spark.checkpoint.dir, a temporary one in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{at}/tidemark-{uuid.uuid4().hex}" if at else tempfile.mkdtemp(prefix="spark-")


def _event_stream(spark, sf_dir):
    """The events as a stream of files; the pattern lets the table be one file or a folder."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


URGENT = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
UPSERT = f"SELECT o_orderkey, o_orderstatus, CASE WHEN {{}} THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'O' OR {URGENT}"


def _stored_and_batch(spark, sf_dir):
    """Stored: what is not open; batch: what is urgent, with other prices."""
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderstatus <> 'O'").select(*VERSIONS), orders.where(URGENT).withColumn("o_totalprice", F.col("o_totalprice") + 1).select(*VERSIONS)


@R.add(UPSERT.format(URGENT))
def keyed_upsert(spark, sf_dir):
    return src.upsert(*_stored_and_batch(spark, sf_dir), ["o_orderkey"])


@R.add(UPSERT.format("o_orderstatus = 'O'"))
def first_observation_wins(spark, sf_dir):
    return src.upsert(*_stored_and_batch(spark, sf_dir), ["o_orderkey"], keep="first")


@R.add(f"SELECT o_orderkey, CASE WHEN {URGENT} THEN 'X' ELSE o_orderstatus END AS o_orderstatus, 2 AS seen FROM orders WHERE o_orderstatus = 'O' OR {URGENT}")
def versioned_append(spark, sf_dir):
    """Stored: what is not open; batch: all rows, the urgent ones changed; what is appended is new or changed."""
    orders = table(spark, sf_dir, "orders")
    stored = orders.where("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus", F.lit(1).alias("seen"))
    batch = orders.select("o_orderkey", F.when(F.expr(URGENT), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.lit(2).alias("seen"))
    return src.append_versions(stored, batch, ["o_orderkey"], ["o_orderstatus"], "seen")


@R.add("SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 6) AS total FROM part GROUP BY p_brand")
def stored_and_compacted(spark, sf_dir):
    """Written, replaced, compacted and read again."""
    root = _scratch(spark)
    part = table(spark, sf_dir, "part")
    src.replace(part.where("p_size < 10"), root)
    src.replace(part, root, ["p_partkey"])
    src.compact(spark, root)
    return src.current(spark, root).groupBy("p_brand").agg(F.count("*").alias("n"), rounded(F.sum("p_retailprice")).alias("total"))


@R.add("""
    SELECT s_suppkey::DOUBLE AS id, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
    UNION ALL SELECT c_custkey + 0.5, c_name, NULL, c_mktsegment FROM customer""")
def union_by_name(spark, sf_dir):
    """Columns by name; a whole number and a double become a double, absent columns null."""
    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    right = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") + F.lit(0.5).cast("double")).alias("id"), F.col("c_name").alias("name"))
    return src.union_wide(left, right)


@R.add("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) WHERE n = 1")
def distinct_keep_last(spark, sf_dir):
    return src.keep_one(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_linenumber").desc(), F.col("l_partkey").desc(), F.col("l_suppkey").desc()]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@R.add("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def whole_row_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@R.add("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def fit_and_score_overlap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderstatus = 'F'").select("o_custkey").intersect(orders.where("o_orderstatus = 'O'").select("o_custkey"))


@R.add("""
    SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey IS NOT DISTINCT FROM CASE WHEN c.c_nationkey % 5 = 0 THEN NULL ELSE c.c_nationkey END AND (s.s_suppkey % 2) IS NOT DISTINCT FROM (c.c_custkey % 2))""")
def null_safe_anti_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("nation"), (F.col("c_custkey") % 2).alias("parity"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 2).alias("parity"))
    return src.absent(customers, suppliers, ["nation", "parity"]).select("c_custkey", "c_name")


@R.add("""
    SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)""")
def membership_semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return src.present(table(spark, sf_dir, "customer"), big, ["c_custkey"]).select("c_custkey", "c_name")


@R.add("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@R.add("SELECT count(*) FILTER (WHERE c_acctbal < 0) AS c_acctbal, count(*) FILTER (WHERE c_nationkey < 0) AS c_nationkey FROM customer")
def negative_counts(spark, sf_dir):
    return quality.negative_counts(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F' AND o_totalprice > 200000)")
def missing_statistics(spark, sf_dir):
    """Customers without a large order that is final."""
    final = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000")
    return quality.orphans(table(spark, sf_dir, "customer"), final, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@R.add("SELECT event_type, sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_surplus FROM (SELECT event_type, user_id, props, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def exact_duplicate_rows(spark, sf_dir):
    return quality.exact_duplicates(table(spark, sf_dir, "events"), ["event_type"], ["user_id", "props"])


@R.add("""
    WITH l AS (SELECT c_custkey, c_nationkey AS nation, c_custkey % 7 AS tag, c_custkey % 50 AS name FROM customer),
         r AS (SELECT s_suppkey, s_nationkey AS nation, s_suppkey % 7 AS tag, s_suppkey % 50 AS name FROM supplier),
         f AS (SELECT c_custkey, 1 AS rule, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS id FROM l JOIN r USING (nation, name) GROUP BY 1
               UNION ALL SELECT c_custkey, 2, count(DISTINCT s_suppkey), min(s_suppkey) FROM l JOIN r USING (nation, tag) GROUP BY 1),
         b AS (SELECT c_custkey, min(rule) AS rule, arg_min(n, rule) AS n, arg_min(id, rule) AS id FROM f GROUP BY 1)
    SELECT l.c_custkey, CASE WHEN n = 1 THEN id END AS s_suppkey, CASE WHEN n IS NULL THEN 'UNMATCHED' WHEN n = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status, rule
    FROM l LEFT JOIN b USING (c_custkey)""")
def entity_resolution(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 7).alias("tag"), (F.col("c_custkey") % 50).alias("name"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("tag"), (F.col("s_suppkey") % 50).alias("name"))
    return resolution.resolve(left, right, "c_custkey", "s_suppkey", [["nation", "name"], ["nation", "tag"]])


@R.add("""
    SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' O''Neil, Jr.'), '[^a-z0-9 ]', '', 'g'), ' (jr|sr|ii|iii|iv|v)$', ''), ' +', ' ', 'g')) AS name FROM part""")
def person_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.person_name(F.concat("p_name", F.lit(" O'Neil, Jr."))).alias("name"))


@R.add("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 15) * 60 + event_id % 60 END::INTEGER AS seconds FROM events""")
def clock_seconds(spark, sf_dir):
    clock = F.when(F.col("event_id") % 3 == 0, F.lit("late")).otherwise(F.format_string("%d:%02d", F.col("event_id") % 15, F.col("event_id") % 60))
    return table(spark, sf_dir, "events").select("event_id", text.clock_seconds(clock).alias("seconds"))


@R.add("SELECT event_id, sha256(concat_ws('|', user_id, event_type, coalesce(props, ''))) AS id FROM events")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.stable_id(F.col("user_id"), F.col("event_type"), F.col("props")).alias("id"))


@R.add("SELECT event_type, user_id, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE value > 50 AND event_type <> 'none' GROUP BY ALL")
def registered_sql(spark, sf_dir):
    """SQL over registered views with a parameter."""
    src.register_views(spark, sf_dir, ["events"])
    return src.query(spark, "SELECT event_type, user_id, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE value > :least AND event_type <> 'none' GROUP BY event_type, user_id", least=50)


@R.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def pushed_scan(spark, sf_dir):
    return src.scan(spark, f"{sf_dir}/orders.parquet", "o_totalprice > 300000 AND o_orderstatus = 'F'", ["o_orderkey", "o_totalprice"])


@R.add("""
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def streamed_windows(spark, sf_dir):
    """Events as a stream of files, counted by hour: windows are appended as they close behind the watermark, and the open ones in the end."""
    rows, root = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), _scratch(spark)
    shape = ("ts", ["event_type"], "value", "1 hour")
    counted = snapshots.windowed(rows.withWatermark("ts", "1 day"), *shape)
    snapshots.run_available(counted, f"{root}/out", f"{root}/checkpoint")
    history = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = snapshots.flushed(spark.read.schema(counted.schema).parquet(f"{root}/out"), history, *shape)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", rounded("total").alias("total"))


@R.add("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def streamed_versions(spark, sf_dir):
    """Events as a stream into a versioned store; the last version of each user."""
    root = _scratch(spark)
    rows = _event_stream(spark, sf_dir).withColumn("seen", F.struct("ts", "event_id"))
    snapshots.keep_versions(rows, f"{root}/store", f"{root}/checkpoint", ["user_id"], ["value"], "seen")
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/store")
    return stored.groupBy("user_id").agg(F.max_by("value", "seen").alias("value"))


@R.add("""
    WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 4 < 3), b AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 4 > 1)
    SELECT user_id, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM (SELECT * FROM s UNION SELECT * FROM b) GROUP BY 1""")
def appended_snapshots(spark, sf_dir):
    """Snapshots appended by key and time: those that are stored already are not stored twice."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    out = src.append_snapshot(events.where("event_id % 4 < 3"), events.where("event_id % 4 > 1"), ["event_id"], "ts")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


@R.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0")
def appended_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return src.append_new(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 3 = 0"), ["o_orderkey"])


@R.add("SELECT s_suppkey AS id, s_acctbal AS amount FROM supplier UNION ALL SELECT p_partkey, p_size FROM part")
def positional_union(spark, sf_dir):
    """Columns by position, types widened; a part without rows adds none."""
    suppliers, parts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("amount")), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return src.by_position(suppliers, parts, src.empty_like(parts))


@R.add("""
    SELECT s_suppkey, strftime(TIMESTAMP '2024-01-01', '%Y-%m-%d') AS first_seen, sha256(json_object('s_name', s_name, 's_nationkey', s_nationkey)::VARCHAR) AS content_sha256,
        sha256(concat_ws('|', s_suppkey, sha256(json_object('s_name', s_name, 's_nationkey', s_nationkey)::VARCHAR))) AS version_id FROM supplier WHERE s_suppkey % 3 <> 0""")
def migrated_versions(spark, sf_dir):
    """Rows of old given version columns, of those that the store does not hold yet."""
    suppliers = table(spark, sf_dir, "supplier")
    legacy = src.translated(suppliers, suppliers.where("s_suppkey % 3 = 0").select("s_suppkey"), ["s_suppkey"], {c: F.col(c) for c in ("s_suppkey", "s_name", "s_nationkey")})
    out = src.with_versions(legacy.withColumn("seen", F.lit("2024-01-01")), ["s_suppkey"], "seen", ["s_name", "s_nationkey"])
    return out.select("s_suppkey", F.col("first_seen_at").alias("first_seen"), "content_sha256", "version_id")
