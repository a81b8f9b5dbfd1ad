"""Gates over the shared tables: quality, reconciliation, leakage, promotion, reproduction, and the joins behind them."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.operators import gates as G, products as P, quality as Q
from tidemark.plans.common import Registry, rounded, table, text_time
from tidemark.plans.evaluation import FORECASTS, _forecasts
from tidemark.plans.products import CONTENT, HASHED

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
CUTOFF = "TIMESTAMP '1998-01-01 00:00:00'"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def _cutoff():
    return F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'")


@R.add("""
    WITH d AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1), u AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) <> 2),
         e AS (SELECT l_orderkey, sum(l_quantity) - any_value(o_custkey % 200) AS excess FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING excess > 0),
         m AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)), n AS (SELECT 1 FROM customer WHERE c_acctbal < 0),
         a AS (SELECT 'duplicate_keys' AS code, 'BLOCK' AS severity, count(*) AS n FROM d UNION ALL SELECT 'unpaired_games', 'BLOCK', count(*) FROM u UNION ALL SELECT 'targets_beyond_attempts', 'BLOCK', count(*) FROM e WHERE excess > 1
               UNION ALL SELECT 'targets_one_beyond_attempts', 'WARN', count(*) FROM e WHERE excess = 1 UNION ALL SELECT 'missing_statistics', 'BLOCK', count(*) FROM m UNION ALL SELECT 'negative_balance', 'BLOCK', count(*) FROM n)
    SELECT * FROM a WHERE n > 0""")
def quality_issues(spark, sf_dir):
    lines, orders = _lines(spark, sf_dir), table(spark, sf_dir, "orders")
    over = G.excess(lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("targets")), orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 200).alias("attempts")), ["l_orderkey"], "targets", "attempts")
    return G.issues(
        ("duplicate_keys", G.BLOCK, Q.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])), ("unpaired_games", G.BLOCK, G.unpaired(lines, "l_orderkey", "l_suppkey")),
        ("targets_beyond_attempts", G.BLOCK, over.where("excess > 1")), ("targets_one_beyond_attempts", G.WARN, over.where("excess = 1")),
        ("missing_statistics", G.BLOCK, Q.orphans(orders.where("o_orderstatus = 'F'"), lines, "o_orderkey", "l_orderkey")), ("negative_balance", G.BLOCK, table(spark, sf_dir, "customer").where("c_acctbal < 0")),
    )


@R.add("""
    WITH s AS (SELECT l_orderkey, sum(l_linenumber) AS summed FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, summed = o_custkey % 20 AS ok FROM s JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
    SELECT l_orderkey, count(*) AS n, coalesce(any_value(ok), false) AS reconciled FROM lineitem LEFT JOIN r USING (l_orderkey) GROUP BY 1""")
def reconciled_games(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    official = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 20).alias("stated"))
    sums = lines.groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("summed"))
    return G.reconciled(lines, sums, official, ["l_orderkey"], "summed", "stated").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_and("reconciled").alias("reconciled"))


@R.add("SELECT l_orderkey, l_suppkey, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS latest, bool_or(l_returnflag = 'R') AS any_flag, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS opportunity FROM lineitem GROUP BY 1, 2")
def team_opportunity(spark, sf_dir):
    out = G.opportunity(_lines(spark, sf_dir), ["l_orderkey", "l_suppkey"], "l_shipdate", F.col("l_returnflag") == "R", F.col("l_quantity"), F.col("l_linestatus") == "F")
    return out.withColumn("latest", text_time("latest"))


@R.add("""
    WITH r AS (SELECT l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_linenumber * 8.0 END AS targets, CASE WHEN l_linestatus = 'F' THEN l_quantity END AS attempts, power(0.5, l_linenumber) AS w FROM lineitem)
    SELECT l_suppkey, count(*) FILTER (WHERE ok) AS n_valid, round(sum(coalesce(targets, 0) * w) FILTER (WHERE ok), 6) AS targets, round(sum(attempts * w) FILTER (WHERE ok), 6) AS attempts FROM (SELECT *, coalesce(attempts IS NOT NULL AND coalesce(targets, 0) <= attempts, false) AS ok FROM r) GROUP BY 1""")
def directed_targets(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_suppkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") * 8.0).alias("targets"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("attempts"))
    out = G.directed(rows, ["l_suppkey"], "targets", "attempts", F.pow(F.lit(0.5), F.col("l_linenumber")))
    return out.select("l_suppkey", "n_valid", rounded("targets").alias("targets"), rounded("attempts").alias("attempts"))


@R.add("""
    SELECT l_orderkey, l_suppkey, sum(coalesce(CASE WHEN l_returnflag <> 'N' THEN l_quantity END, 0)) AS targets, sum(coalesce(CASE WHEN l_linestatus = 'F' THEN l_linenumber END, 0) + l_linenumber % 2)::BIGINT AS offensive_tds FROM lineitem GROUP BY 1, 2""")
def team_game_sums(spark, sf_dir):
    """Sums in which an unknown part counts as nothing."""
    known = lambda c, flag: F.coalesce(F.when(flag, F.col(c)), F.lit(0))
    tds = known("l_linenumber", F.col("l_linestatus") == "F") + F.col("l_linenumber") % 2
    return _lines(spark, sf_dir).groupBy("l_orderkey", "l_suppkey").agg(F.sum(known("l_quantity", F.col("l_returnflag") != "N")).alias("targets"), F.sum(tds).alias("offensive_tds"))


@R.add("""
    WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderstatus = 'F')
    SELECT o_orderkey, cents AS raw_cents, cents * 9 + 10000 AS calibrated_tenths FROM c""")
def paired_predictions(spark, sf_dir):
    """Raw and calibrated values of the same predictions, each held exactly once by both; in whole cents and tenths of them, which no rounding parts."""
    final = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("raw_cents"))
    return G.joined_one_to_one(final, final.select("o_orderkey", (F.col("raw_cents") * 9 + 10000).alias("calibrated_tenths")), ["o_orderkey"])


@R.add(f"""
    WITH k AS (SELECT l_partkey, arg_max(l_returnflag, (l_shipdate, l_returnflag)) AS t FROM lineitem WHERE l_shipdate <= {CUTOFF} AND l_suppkey % 3 = 0 GROUP BY 1)
    SELECT p_partkey, coalesce(t, CASE WHEN p_size % 2 = 0 THEN p_brand END, 'OTHER') AS position, CASE WHEN t IS NOT NULL THEN 'HISTORY' WHEN p_size % 2 = 0 THEN 'CURRENT' ELSE 'NONE' END AS source FROM part LEFT JOIN k ON p_partkey = l_partkey""")
def resolved_positions(spark, sf_dir):
    """The group known at the cutoff, or the present one, or OTHER, and where it came from."""
    players = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand"))
    history = _lines(spark, sf_dir).where("l_suppkey % 3 = 0").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate", "l_returnflag")
    return G.resolved_position(players, history, "p_partkey", _cutoff(), "l_shipdate", "l_returnflag", "brand")


@R.add("""
    WITH r AS (SELECT l_partkey, l_linestatus AS pos FROM lineitem WHERE l_suppkey % 40 = l_partkey % 40)
    SELECT l_partkey, CASE WHEN min(pos) = max(pos) THEN min(pos) END AS pos, min(pos) <> max(pos) AS conflict FROM r GROUP BY 1""")
def position_reference(spark, sf_dir):
    rows = _lines(spark, sf_dir).where("l_suppkey % 40 = l_partkey % 40").select("l_partkey", F.col("l_linestatus").alias("pos"))
    return G.sole_value(rows, "l_partkey", "pos")


@R.add("""
    WITH a AS (SELECT l_partkey, l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2)
    SELECT a.l_partkey, count(*) AS appearances, max(n) AS largest, (SELECT count(DISTINCT l_suppkey) FROM lineitem l WHERE l.l_partkey = a.l_partkey) AS candidates FROM a GROUP BY 1""")
def candidate_sets(spark, sf_dir):
    return G.candidate_sets(_lines(spark, sf_dir), ["l_orderkey"], "l_partkey", "l_suppkey")


@R.add("""
    SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, c_mktsegment, n_name, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 10""")
def appearances(spark, sf_dir):
    """Each appearance with its game, team and player dimensions; Spark broadcasts those that it measures as small."""
    games, owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    places, books = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = _lines(spark, sf_dir).where("l_quantity > 10").join(games, F.col("l_orderkey") == F.col("o_orderkey")).join(owners, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(books, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "c_mktsegment", "n_name", "s_name")


@R.add("SELECT c_custkey, coalesce(c_name, 'unknown') AS name, coalesce(n_name, 'unknown') AS team FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 > 0")
def published_names(spark, sf_dir):
    teams = table(spark, sf_dir, "nation").where("n_nationkey % 5 > 0").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "customer").join(teams, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("c_name", F.lit("unknown")).alias("name"), F.coalesce("n_name", F.lit("unknown")).alias("team"))


@R.add("""
    SELECT o_orderstatus AS status, count(*) AS n, count(l.l_orderkey) AS n_triggered FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 7) l ON o_orderkey = l_orderkey GROUP BY 1""")
def triggered_runs(spark, sf_dir):
    """Runs by status, and how many have the label of what triggered them."""
    triggers = _lines(spark, sf_dir).where("l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("seventh").alias("trigger")).distinct()
    return table(spark, sf_dir, "orders").join(triggers, "o_orderkey", "left").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count("trigger").alias("n_triggered"))


@R.add(f"""
    WITH {FORECASTS} SELECT lang, count(*) AS n, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS loss, round(1 - avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) / avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)), 6) AS skill FROM f GROUP BY 1""")
def multiclass_skill(spark, sf_dir):
    given = lambda c: F.when(F.col("y") == 1, F.col(c)).otherwise(1.0 - F.col(c))
    rows = _forecasts(spark, sf_dir).withColumns({"tp": given("p"), "tq": given("q")})
    out = G.multiclass_loss(rows, ["lang"], "tp").join(G.multiclass_loss(rows, ["lang"], "tq").select("lang", F.col("loss").alias("base")), "lang")
    return out.select("lang", "n", rounded("loss").alias("loss"), rounded(G.skill(F.col("loss"), F.col("base"))).alias("skill"))


@R.add("""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_shipdate, (l_quantity > 25)::INT AS y FROM lineitem),
         a AS (SELECT *, count(*) OVER n AS n0, sum(y) OVER n AS s0, count(*) OVER m AS n1, sum(y) OVER m AS s1, count(*) OVER g AS n2, sum(y) OVER g AS s2 FROM r
               WINDOW n AS (PARTITION BY l_suppkey, l_returnflag ORDER BY epoch_us(l_shipdate) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m AS (PARTITION BY l_returnflag ORDER BY epoch_us(l_shipdate) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (ORDER BY epoch_us(l_shipdate) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n0 >= 50 THEN 0 WHEN n1 >= 50 THEN 1 WHEN n2 >= 50 THEN 2 END AS level, round(CASE WHEN n0 >= 50 THEN s0 / n0 WHEN n1 >= 50 THEN s1 / n1 WHEN n2 >= 50 THEN s2 / n2 END, 6) AS rate FROM a""")
def prequential_fallback(spark, sf_dir):
    """The rate of outcomes strictly before each row, of the narrowest of prop, position and all that has 50 of them."""
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", (F.col("l_quantity") > 25).cast("int").alias("y"))
    out = G.fallback_rate(rows, [["l_suppkey", "l_returnflag"], ["l_returnflag"], []], "l_shipdate", "y", 50)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "level", rounded("rate").alias("rate"))


@R.add("""
    WITH l AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber <= 4 AND l_shipdate > o_orderdate + INTERVAL 80 DAY) AS features, count(*) FILTER (WHERE l_linenumber > 5 AND l_shipdate > o_orderdate + INTERVAL 80 DAY) AS injuries,
                   count(*) FILTER (WHERE l_partkey % 100 = o_custkey % 100) AS same, count(*) FILTER (WHERE l_suppkey % 10 > o_custkey % 10 OR l_shipdate > o_orderdate + INTERVAL 80 DAY) AS history, count(*) FILTER (WHERE l_shipdate > o_orderdate + INTERVAL 80 DAY) AS season,
                   count(*) FILTER (WHERE l_returnflag = 'R' AND (l_quantity = 50 OR (l_suppkey % 7 = o_custkey % 7 AND l_linenumber % 3 = o_orderkey % 3))) AS price, any_value(o_orderstatus) AS st, any_value(o_custkey) AS c, any_value(o_orderdate) AS d, max(l_shipdate) AS last, min(l_shipdate) AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
         f AS (SELECT l_orderkey, unnest([{'rule': 'feature_after_asof', 'n': features}, {'rule': 'injury_after_asof', 'n': injuries}, {'rule': 'predicted_game_result', 'n': same}, {'rule': 'future_game_in_history', 'n': history}, {'rule': 'future_game_in_season_aggregate', 'n': season},
                   {'rule': 'target_price_in_fundamental', 'n': price}, {'rule': 'closing_odds_at_open', 'n': (st = 'O' AND c % 2 = 0)::INT}, {'rule': 'calibration_overlap', 'n': (c % 50 = 0)::INT + (first >= d + INTERVAL 80 DAY)::INT}, {'rule': 'state_after_asof', 'n': (last > d + INTERVAL 80 DAY)::INT}], recursive := true) FROM l)
    SELECT rule, count(*) AS predictions, sum(n)::BIGINT AS findings FROM f WHERE n > 0 GROUP BY 1""")
def leakage_rules(spark, sf_dir):
    """All nine rules over the lineage of every order, and how often each is broken."""
    orders = table(spark, sf_dir, "orders").withColumn("as_of", F.col("o_orderdate") + F.expr("INTERVAL 80 DAYS"))
    rows = _lines(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.col("l_linenumber")
    game = F.struct((F.col("l_partkey") % 100).alias("game"), F.lit(1).alias("season"), (F.col("l_suppkey") % 10).alias("week"), F.col("l_shipdate").alias("at"), F.lit(True).alias("used"))
    source = F.struct(F.when(F.col("l_returnflag") == "R", G.MARKET_PRICE).otherwise("non_market").alias("kind"), F.when(F.col("l_quantity") != 50, F.col("l_suppkey") % 7).alias("player"), (line % 3).alias("prop"))
    lineage = rows.groupBy("l_orderkey", "as_of", (F.col("o_custkey") % 100).alias("game"), (F.col("o_custkey") % 7).alias("player"), (F.col("o_orderkey") % 3).alias("prop"), F.lit(1).alias("season"), (F.col("o_custkey") % 10).alias("week"), (F.col("o_orderstatus") == "O").alias("opening"), (F.col("o_custkey") % 2 == 0).alias("closing_used"), (F.col("o_custkey") % 50 == 0).alias("in_training")).agg(
        F.collect_list(F.when(line <= 4, F.col("l_shipdate"))).alias("features"), F.collect_list(F.when(line > 5, F.col("l_shipdate"))).alias("injuries"), F.collect_list(game).alias("history"),
        F.collect_list(F.struct((F.col("l_partkey") % 100).alias("game"), F.col("l_shipdate").alias("at"))).alias("season_games"), F.min("l_shipdate").alias("calibration_max"), F.max("l_shipdate").alias("state_as_of"), F.collect_list(source).alias("inputs"),
    )
    return G.leakage(lineage, "l_orderkey").groupBy("rule").agg(F.count("*").alias("predictions"), F.sum("n").alias("findings"))


CHANGED = "(SELECT * REPLACE (CASE WHEN l_quantity = 50 THEN 'X' ELSE l_returnflag END AS l_returnflag) FROM lineitem WHERE l_orderkey % 100 <> 3)"


@R.add(f"""
    WITH a AS (WITH {HASHED.format(rows="lineitem")} SELECT * FROM s), z AS (WITH {HASHED.format(rows=CHANGED)} SELECT * FROM s)
    SELECT coalesce(a.run, z.run) AS run, coalesce(a.n_rows = z.n_rows AND a.a = z.a AND a.b = z.b, false) AS equal FROM a FULL JOIN z ON a.run = z.run""")
def reproduced_runs(spark, sf_dir):
    """Two builds of every run compared by header: some rows differ, some runs are missing in the second."""
    rows = _lines(spark, sf_dir).withColumnRenamed("l_orderkey", "run")
    again = rows.where("run % 100 <> 3").withColumn("l_returnflag", F.when(F.col("l_quantity") == 50, "X").otherwise(F.col("l_returnflag"))).repartition("l_partkey")
    return G.reproduced(P.header(rows, "run", CONTENT), P.header(again, "run", CONTENT), "run")


@R.add("""
    SELECT o_orderkey, o_totalprice AS value FROM orders""")
def either_store(spark, sf_dir):
    """Values from a compact store and a legacy one that overlap and agree."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    return G.read_either(orders.where("o_orderkey % 3 > 0"), orders.where("o_orderkey % 3 < 2"), ["o_orderkey"], "value")


@R.add("""
    WITH s AS (SELECT l_orderkey, sha256(count(*) || '|' || sum(l_linenumber)) AS source_hash, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS max_available_at FROM lineitem GROUP BY 1)
    SELECT o_orderkey, source_hash, max_available_at FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def row_provenance(spark, sf_dir):
    sources = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum("l_linenumber")), 256).alias("source_hash"), text_time(F.max("l_shipdate")).alias("max_available_at"))
    return G.with_provenance(table(spark, sf_dir, "orders").select("o_orderkey"), sources, ["o_orderkey"])


@R.add("""
    SELECT year(o_orderdate) AS season, count(*) AS total, count(*) FILTER (WHERE l.l_orderkey IS NOT NULL) AS replayable, count(*) FILTER (WHERE l.l_orderkey IS NULL) AS skipped FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') l ON o_orderkey = l_orderkey GROUP BY 1""")
def replay_coverage(spark, sf_dir):
    ready = _lines(spark, sf_dir).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("ready")).distinct()
    rows = table(spark, sf_dir, "orders").join(ready, "o_orderkey", "left")
    return rows.groupBy(F.year("o_orderdate").cast("long").alias("season")).agg(F.count("*").alias("total"), F.count("ready").alias("replayable"), F.count_if(F.col("ready").isNull()).alias("skipped"))


@R.add("""
    SELECT lang, count(*) AS n, count(quality) AS labelled, count(*) - count(quality) AS unlabelled, round(count(quality) / count(*), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def label_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), rounded(F.count("quality") / F.count("*")).alias("coverage"))


#: Keys of a range whose places are counted together.
RANGE = 4096
NAMES = ("orders", "lineitem", "customer", "supplier", "part", "events")


@R.add(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in NAMES))
def table_coverage(spark, sf_dir):
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in NAMES]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@R.add("""
    WITH c AS (SELECT l_orderkey, count(*) AS n, max(l_suppkey) AS top, list_sort(list_distinct(list(l_suppkey))) AS a FROM lineitem GROUP BY 1)
    SELECT l_orderkey, n, len(a) AS n_distinct, a[1] AS first, list_aggregate(a, 'sum')::BIGINT AS total, row_number() OVER (ORDER BY CASE WHEN n > 3 THEN top END NULLS LAST, l_orderkey) AS place FROM c""")
def list_columns(spark, sf_dir):
    """Lists made, sorted, made distinct, measured and added up; places in an order with nulls last. The window takes one row a game, range by range."""
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_suppkey").alias("top"), F.array_sort(F.collect_set("l_suppkey")).alias("a"))
    rows = rows.withColumn("key", F.when(F.col("n") > 3, F.col("top")))
    rows = rows.withColumn("_range", F.floor(F.col("l_orderkey") / RANGE))  # so that games with one key, or none, are parted too
    ranges = rows.groupBy("key", "_range").agg(F.count("*").alias("_n"))
    before = ranges.select(F.col("key").alias("_key"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(Window.orderBy(F.asc_nulls_last("key"), "_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("key", "_range").orderBy("l_orderkey"))
    placed = rows.withColumn("_i", own).join(before, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    total = F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x)
    return placed.select("l_orderkey", "n", F.size("a").alias("n_distinct"), F.get("a", F.lit(0)).alias("first"), total.alias("total"), (F.col("_before") + F.col("_i")).alias("place"))
