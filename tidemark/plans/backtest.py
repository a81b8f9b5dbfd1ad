"""The whole report of a backtest, boards by tier, what a forecast may read, folds and manifests, receipts, tables of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import boards as B, inputs as I, protocol as P, report as E, resolution as N, state as T, timing as K
from tidemark.plans.common import Registry, rounded, scaled, table
from tidemark.plans.tables import _scratch
from tidemark.sources import receipts as C, tables as S

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "actual"]
#: Rows of a backtest from lines: dyadic probabilities, wagers of one unit. The same text is read by both engines.
ROWS = {
    "prop_type": "concat('prop', l_linenumber)", "season": "year(l_shipdate)", "week": "l_orderkey % 18 + 1", "p": "l_quantity / 64", "q": "l_discount * 4", "y": "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END", "actual": "l_quantity",
    "model_mean": "l_linenumber * 7.5", "crps": "CASE WHEN l_returnflag = 'N' THEN l_tax END", "pit": "CASE WHEN l_returnflag = 'N' THEN (l_orderkey % 101) / 101 END", **{f"p{q}": f"CAST(l_linenumber * {i} AS DOUBLE)" for i, q in ((1, "05"), (2, "10"), (4, "25"), (7, "50"), (9, "75"), (11, "90"), (12, "95"))},
    "selected": "l_quantity / 64 > l_discount * 4", "ev": "l_quantity / 64 - l_discount * 4", "profit": "CASE WHEN l_linestatus = 'F' THEN 1.25 ELSE -1.0 END", "close_available": "l_returnflag <> 'R'", "clv_probability": "l_discount - 0.05", "clv_cents": "l_tax * 100",
}
PER_SLICE = ("n", "brier_model", "brier_market", "log_loss_model", "log_loss_market", "ece_model", "ece_market")
DISTRIBUTIONAL = ("n", "mae", "mean_crps", "mean_wis", "coverage_50", "coverage_80", "coverage_90", "median_ae", "pit_ks")
TRADING = ("bets", "mean_ev", "roi", "max_drawdown", "close_available", "close_missing", "n_clv_probability", "mean_clv_probability", "n_clv_cents", "mean_clv_cents")


def _unpivot(names) -> str:
    return f"unnest([{', '.join(repr(n) for n in names)}]) AS metric, unnest([{', '.join(f'{n}::DOUBLE' for n in names)}]) AS value"


def _clip(c: str) -> str:
    return f"least(greatest({c}, 1e-6), 1 - 1e-6)"


@R.add(f"""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {", ".join(f"{v} AS {k}" for k, v in ROWS.items())} FROM lineitem),
         s AS (SELECT 'aggregate' AS section, 'all' AS slice, * FROM r UNION ALL SELECT 'by_prop_type', prop_type, * FROM r UNION ALL SELECT 'by_season', season::VARCHAR, * FROM r UNION ALL SELECT 'early_weeks', 'all', * FROM r WHERE week <= 4 UNION ALL SELECT 'late_weeks', 'all', * FROM r WHERE week >= 14),
         b AS (SELECT section, slice, count(*) AS n, avg((p - y) ** 2) AS brier_model, avg((q - y) ** 2) AS brier_market, -avg(y * ln({_clip("p")}) + (1 - y) * ln(1 - {_clip("p")})) AS log_loss_model, -avg(y * ln({_clip("q")}) + (1 - y) * ln(1 - {_clip("q")})) AS log_loss_market FROM s GROUP BY ALL),
         g AS (SELECT section, slice, which, least(floor(x * 10), 9) AS bin, abs(sum(x) - sum(y)) AS gap, count(*) AS m FROM (SELECT section, slice, y, unnest(['p', 'q']) AS which, unnest([{_clip("p")}, {_clip("q")}]) AS x FROM s) GROUP BY ALL),
         e AS (SELECT section, slice, sum(gap) FILTER (WHERE which = 'p') / sum(m) FILTER (WHERE which = 'p') AS ece_model, sum(gap) FILTER (WHERE which = 'q') / sum(m) FILTER (WHERE which = 'q') AS ece_market FROM g GROUP BY ALL),
         k AS (SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM r GROUP BY 1),
         w AS (SELECT *, (0.5 * abs(actual - p50) + 0.25 * (p75 - p25 + 4 * (greatest(p25 - actual, 0) + greatest(actual - p75, 0))) + 0.1 * (p90 - p10 + 10 * (greatest(p10 - actual, 0) + greatest(actual - p90, 0))) + 0.05 * (p95 - p05 + 20 * (greatest(p05 - actual, 0) + greatest(actual - p95, 0)))) / 3.5 AS wis FROM r),
         u AS (SELECT pit, row_number() OVER (ORDER BY pit) AS i, count(*) OVER () AS m FROM r WHERE pit IS NOT NULL),
         d AS (SELECT count(actual) AS n, avg(abs(model_mean - actual)) AS mae, avg(crps) AS mean_crps, avg(wis) AS mean_wis, avg((actual BETWEEN p25 AND p75)::INT) AS coverage_50, avg((actual BETWEEN p10 AND p90)::INT) AS coverage_80, avg((actual BETWEEN p05 AND p95)::INT) AS coverage_90, median(abs(model_mean - actual)) AS median_ae, (SELECT max(greatest(i / m - pit, pit - (i - 1) / m)) FROM u) AS pit_ks FROM w),
         c AS (SELECT sum(profit) OVER (ORDER BY {", ".join(ORDER)} ROWS UNBOUNDED PRECEDING) AS run, {", ".join(ORDER)} FROM r WHERE selected),
         f AS (SELECT greatest(max(run) OVER (ORDER BY {", ".join(ORDER)} ROWS UNBOUNDED PRECEDING), 0) - run AS fall FROM c),
         t AS (SELECT count(*) AS bets, avg(ev) AS mean_ev, avg(profit) AS roi, (SELECT max(fall) FROM f) AS max_drawdown, count(*) FILTER (WHERE close_available) AS close_available, count(*) FILTER (WHERE NOT close_available) AS close_missing, count(*) FILTER (WHERE close_available) AS n_clv_probability, avg(clv_probability) FILTER (WHERE close_available) AS mean_clv_probability,
               count(*) FILTER (WHERE close_available) AS n_clv_cents, avg(clv_cents) FILTER (WHERE close_available) AS mean_clv_cents FROM r WHERE selected),
         x AS (SELECT CASE WHEN l_discount < 0.02 THEN 'NO_MARKET' WHEN l_tax > 0.06 THEN 'STALE' END AS reason, count(*) AS n FROM lineitem WHERE l_discount < 0.02 OR l_tax > 0.06 GROUP BY 1),
         a AS (SELECT section, slice, {_unpivot(PER_SLICE)} FROM b JOIN e USING (section, slice) UNION ALL SELECT 'reliability', bin::VARCHAR, {_unpivot(("n", "mean_p", "rate"))} FROM k UNION ALL SELECT 'distributional', 'all', {_unpivot(DISTRIBUTIONAL)} FROM d UNION ALL SELECT 'trading', 'all', {_unpivot(TRADING)} FROM t UNION ALL SELECT 'exclusions', reason, 'n', n FROM x)
    SELECT section, slice, metric, round(value, 6) AS value FROM a""")
def evaluation_report(spark, sf_dir):
    """Everything a backtest is judged by, in one table."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.expr(v).alias(k) for k, v in ROWS.items()])
    left_out = lines.where("l_discount < 0.02 OR l_tax > 0.06").select(F.when(F.col("l_discount") < 0.02, "NO_MARKET").otherwise("STALE").alias("reason"))
    return E.report(rows, ORDER, left_out).select("section", "slice", "metric", rounded("value").alias("value"))


QUOTES = """q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'v' || (l_suppkey % 5) AS vendor, CASE l_orderkey % 8 WHEN 0 THEN 'milestone' WHEN 1 THEN 'milestone' WHEN 2 THEN 'alternate' WHEN 3 THEN NULL ELSE 'over_under' END AS market_type,
        CASE l_partkey % 6 WHEN 0 THEN 'receptions' WHEN 1 THEN 'anytime_td' WHEN 2 THEN 'longest_rush' WHEN 3 THEN 'first_td' WHEN 4 THEN 'field_position' ELSE 'targets_2h' END AS prop, CASE WHEN l_quantity < 46 THEN l_linenumber - 0.5 END AS line, round(100 + l_tax * 100)::INT AS over_odds, CASE WHEN l_returnflag <> 'A' THEN -110 END AS under_odds, l_shipdate, row_number() OVER () AS i FROM lineitem)"""
REASON = """CASE WHEN market_type IS NULL OR market_type NOT IN ('over_under', 'milestone') THEN 'UNSUPPORTED_MARKET_TYPE' WHEN prop NOT IN ('receptions', 'anytime_td', 'longest_rush', 'first_td') THEN 'UNSUPPORTED_PROP_TYPE'
        WHEN market_type = 'milestone' AND (prop NOT IN ('anytime_td', 'first_td') OR coalesce(line <> 0.5, false)) THEN 'UNSUPPORTED_COUNT_MILESTONE' END"""


def _tier_quotes(spark, sf_dir):
    order, part = F.col("l_orderkey") % 8, F.col("l_partkey") % 6
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("v"), F.col("l_suppkey") % 5).alias("vendor"), F.when(order < 2, "milestone").when(order == 2, "alternate").when(order > 3, "over_under").alias("market_type"),
        F.when(part == 0, "receptions").when(part == 1, "anytime_td").when(part == 2, "longest_rush").when(part == 3, "first_td").when(part == 4, "field_position").otherwise("targets_2h").alias("prop"),
        F.when(F.col("l_quantity") < 46, F.col("l_linenumber") - 0.5).alias("line"), F.round(100 + F.col("l_tax") * 100).cast("int").alias("over_odds"), F.when(F.col("l_returnflag") != "A", -110).alias("under_odds"), F.lit(150).alias("hit_odds"), "l_shipdate",
    )


@R.add(f"WITH {QUOTES} SELECT vendor AS book, prop, market_type, {REASON} AS reason, count(*) AS n FROM q WHERE {REASON} IS NOT NULL GROUP BY ALL")
def unsupported_quotes(spark, sf_dir):
    """How many quotes of each book, prop and kind of market have no price, by reason."""
    return B.exclusion_counts(B.supported(_tier_quotes(spark, sf_dir)))


@R.add(f"""
    WITH {QUOTES}, o AS (SELECT *, {REASON} AS reason FROM q),
         m AS (SELECT l_suppkey, prop, x, n / sum(n) OVER (PARTITION BY l_suppkey, prop) AS p FROM (SELECT l_suppkey, prop, x, count(*) AS n FROM (SELECT l_suppkey, unnest(['receptions', 'anytime_td', 'longest_rush', 'first_td']) AS prop, unnest([l_quantity::BIGINT % 9, l_quantity::BIGINT % 3, l_quantity::BIGINT, (l_quantity > 40)::BIGINT]) AS x FROM lineitem) GROUP BY 1, 2, 3)),
         s AS (SELECT *, unnest(['OVER', 'UNDER']) AS side FROM o WHERE reason IS NULL AND market_type = 'over_under' AND prop <> 'first_td' UNION ALL SELECT *, 'HIT' FROM o WHERE reason IS NULL AND market_type = 'milestone' AND prop <> 'first_td'),
         t AS (SELECT s.*, CASE side WHEN 'OVER' THEN over_odds WHEN 'UNDER' THEN under_odds ELSE 150 END AS odds, CASE WHEN prop = 'receptions' THEN 1 ELSE 2 END AS tier FROM s WHERE l_shipdate <= TIMESTAMP '1996-01-01' AND l_suppkey % 7 > 0 AND (side = 'HIT' OR line IS NOT NULL)),
         w AS (SELECT t.i, t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, t.prop, side, tier, odds, t.l_shipdate, sum(CASE WHEN (side = 'OVER' AND x > line) OR (side = 'UNDER' AND x < line) OR (side = 'HIT' AND x >= 1) THEN p ELSE 0 END) AS p_win FROM t JOIN m ON m.l_suppkey = t.l_suppkey AND m.prop = t.prop WHERE odds IS NOT NULL GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, prop, side, tier, round(p_win, 6) AS p_win, round(p_win * CASE WHEN odds < 0 THEN 100.0 / -odds ELSE odds / 100.0 END - (1 - p_win), 6) AS ev, (epoch(TIMESTAMP '1996-01-01') - epoch(l_shipdate))::BIGINT AS quote_age_seconds FROM w""")
def tiered_board(spark, sf_dir):
    """Both sides or the hit of every quote of the first two tiers, for suppliers that were drawn, priced under their distributions."""
    cutoff = F.expr("TIMESTAMP_NTZ'1996-01-01 00:00:00'")
    count = F.col("l_quantity").cast("long")
    values = {"receptions": count % 9, "anytime_td": count % 3, "longest_rush": count, "first_td": (F.col("l_quantity") > 40).cast("long")}
    lines = table(spark, sf_dir, "lineitem")
    draws = lines.select("l_suppkey", F.inline(F.array(*[F.struct(F.lit(k).alias("prop"), v.alias("value")) for k, v in values.items()])))
    from tidemark.operators.stats import pmf

    drawn = lines.where("l_suppkey % 7 > 0").select("l_suppkey")
    quotes = _tier_quotes(spark, sf_dir).where(F.col("l_shipdate") <= cutoff)
    out = B.board(quotes, pmf(draws, ["l_suppkey", "prop"]), ["l_suppkey", "prop"], cutoff, "l_shipdate", 2, drawn)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "prop", "side", "tier", scaled("p_win").alias("p_win"), scaled("ev").alias("ev"), "quote_age_seconds")


AS_OF, TARGET = "1995-07-01", 199506


def _input_tables(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    games = orders.select(F.col("o_orderkey").alias("game"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.col("o_orderdate").alias("kickoff"), (F.col("o_orderdate") - F.expr("INTERVAL 10 DAYS")).alias("available_at"))
    stats = lines.select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("player"), F.col("l_quantity").alias("yards"), F.col("l_shipdate").alias("available_at"), F.col("l_linestatus").alias("status"))
    received = lambda flag: lines.where(f"l_returnflag = '{flag}'").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("player"), F.col("l_shipdate").alias("available_at"))
    roster = orders.select((F.col("o_orderkey") % 500).alias("player"), (F.col("o_custkey") % 32).alias("team"), F.col("o_orderdate").alias("available_at"))
    weekly = orders.select((F.col("o_orderkey") % 5000).alias("player"), (F.col("o_custkey") % 32).alias("team"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.when(F.col("o_orderstatus") == "P", "RES").otherwise("ACT").alias("status"))
    return {"games": games, "stats": stats, "odds": received("R"), "roster": roster, "injuries": received("A")}, weekly


@R.add(f"""
    WITH g AS (SELECT o_orderkey AS game, year(o_orderdate) * 100 + month(o_orderdate) AS slate, o_orderdate AS kickoff, o_orderdate - INTERVAL 10 DAY AS seen FROM orders),
         h AS (SELECT *, max(kickoff) OVER (PARTITION BY slate) AS boundary FROM g), s AS (SELECT l_orderkey AS game, l_quantity AS yards, l_shipdate AS seen, l_linestatus AS status, l_returnflag AS flag FROM lineitem), t AS (SELECT TIMESTAMP '{AS_OF}' AS t),
         b AS (SELECT o_orderkey % 500 AS player, o_custkey % 32 AS team, o_orderdate AS ts FROM orders, t WHERE o_orderdate <= t), b1 AS (SELECT * FROM b QUALIFY ts = max(ts) OVER (PARTITION BY team)), b2 AS (SELECT DISTINCT player, team FROM (SELECT * FROM b1 QUALIFY ts = max(ts) OVER (PARTITION BY player))), m AS (SELECT player FROM b2 GROUP BY 1 HAVING count(*) = 1),
         w AS (SELECT o_orderkey % 5000 AS player FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 6 AND o_orderstatus <> 'P' GROUP BY 1 HAVING count(DISTINCT o_custkey % 32) = 1),
         a AS (SELECT 'live_enhanced' AS profile, 'stats' AS input, count(*) AS n, sum(yards) AS total, count(g.game) AS n_dated FROM t, s LEFT JOIN g ON g.game = s.game AND g.seen <= TIMESTAMP '{AS_OF}' WHERE s.seen <= t
               UNION ALL SELECT 'structural_core_live', 'stats', count(*), sum(yards), count(*) FROM t, s JOIN g USING (game) WHERE s.seen <= t AND g.seen <= t AND slate < {TARGET}
               UNION ALL SELECT 'structural_core_past', 'stats', count(*), sum(yards), count(*) FROM t, s JOIN h USING (game) WHERE status = 'F' AND slate < {TARGET} AND boundary <= t
               UNION ALL SELECT 'live_enhanced', 'odds', count(*), NULL, NULL FROM s, t WHERE flag = 'R' AND seen <= t UNION ALL SELECT 'live_enhanced', 'injuries', count(*), NULL, NULL FROM s, t WHERE flag = 'A' AND seen <= t UNION ALL SELECT 'live_enhanced', 'roster', count(*), NULL, NULL FROM b
               UNION ALL SELECT p, i, 0, NULL, NULL FROM (SELECT unnest(['structural_core_live', 'structural_core_past']) AS p), (SELECT unnest(['odds', 'injuries', 'roster']) AS i)
               UNION ALL SELECT p, 'membership', (SELECT count(*) FROM m), NULL, NULL FROM (SELECT unnest(['live_enhanced', 'structural_core_live']) AS p) UNION ALL SELECT 'structural_core_past', 'membership', (SELECT count(*) FROM w), NULL, NULL)
    SELECT profile, input, n, round(total, 4) AS total, n_dated FROM a""")
def profile_inputs(spark, sf_dir):
    """Rows that each profile may read for the slate of June 1995, by input."""
    tables, weekly = _input_tables(spark, sf_dir)
    as_of, final, parts = F.expr(f"TIMESTAMP_NTZ'{AS_OF} 00:00:00'"), F.col("status") == "F", []
    runs = {"live_enhanced": (I.ENHANCED, I.LIVE, tables, None), "structural_core_live": (I.CORE, I.LIVE, tables, None), "structural_core_past": (I.CORE, I.HISTORICAL, {**tables, "weekly": weekly}, (1995, 6))}
    for name, (profile, mode, given, week) in runs.items():
        for kind, rows in I.model_inputs(profile, mode, given, as_of, TARGET, final, week).items():
            total, dated = (F.round(F.sum("yards"), 4), F.count("event_time")) if kind == "stats" else (F.lit(None).cast("double"), F.lit(None).cast("long"))
            parts.append(rows.agg(F.count("*").alias("n"), total.alias("total"), dated.alias("n_dated")).select(F.lit(name).alias("profile"), F.lit(kind).alias("input"), "n", "total", "n_dated"))
    return S.union_exact(*parts)


FOLDS = """
    y AS (SELECT o_custkey AS c, year(o_orderdate) AS place FROM orders GROUP BY 1, 2),
    f AS (SELECT 'e' || c AS experiment_id, place, CASE WHEN (c + place) % 37 = 0 THEN ' ' WHEN (c + place) % 41 = 0 THEN 'f' ELSE 'f' || place END AS fold_id, make_timestamp(CASE WHEN (c + place) % 43 = 0 THEN 1990 ELSE 1991 END, 1, 1, 0, 0, 0) AS train_start,
          make_timestamp(place - CASE WHEN (c + place) % 47 = 0 THEN 9 ELSE 0 END, 1, 1, 0, 0, 0) AS train_end, make_timestamp(place, CASE WHEN (c + place) % 53 = 0 THEN 4 ELSE 2 END, 1, 0, 0, 0) AS selection_end, make_timestamp(place, 3, 1, 0, 0, 0) AS score_start, make_timestamp(place + CASE WHEN (c + place) % 59 = 0 THEN 1 ELSE 0 END, 11, 1, 0, 0, 0) AS score_end FROM y),
    j AS (SELECT *, CASE WHEN trim(fold_id) = '' THEN 'NO_ID' WHEN train_start > train_end THEN 'TRAIN_ORDER' WHEN train_end > selection_end THEN 'SELECTION_BEFORE_TRAIN_END' WHEN selection_end >= score_start THEN 'SCORE_BEFORE_SELECTION_END' WHEN score_start > score_end THEN 'SCORE_ORDER' WHEN count(*) OVER (PARTITION BY experiment_id, fold_id) > 1 THEN 'REPEATED_ID'
          WHEN train_start <> first(train_start) OVER w THEN 'ORIGIN_MOVED' WHEN train_end < lag(train_end) OVER w THEN 'TRAIN_SHRINKS' WHEN selection_end < lag(selection_end) OVER w THEN 'SELECTION_SHRINKS' WHEN score_start <= lag(score_end) OVER w THEN 'SCORES_OVERLAP' END AS fault FROM f WINDOW w AS (PARTITION BY experiment_id ORDER BY place))"""


def _folds(spark, sf_dir):
    mark = lambda n: (F.col("c") + F.col("place")) % n == 0
    day = lambda y, m: F.make_timestamp_ntz(y, m, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    seasons, place, one = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("place")).distinct(), F.col("place"), F.lit(1)
    return seasons.select(
        F.concat(F.lit("e"), "c").alias("experiment_id"), "place", F.when(mark(37), " ").when(mark(41), "f").otherwise(F.concat(F.lit("f"), "place")).alias("fold_id"), day(F.when(mark(43), 1990).otherwise(1991), one).alias("train_start"), day(place - F.when(mark(47), 9).otherwise(0), one).alias("train_end"),
        day(place, F.when(mark(53), 4).otherwise(2)).alias("selection_end"), day(place, F.lit(3)).alias("score_start"), day(place + F.when(mark(59), 1).otherwise(0), F.lit(11)).alias("score_end"),
    )


@R.add(f"WITH {FOLDS} SELECT experiment_id, place, fault FROM j WHERE fault IS NOT NULL")
def fold_faults(spark, sf_dir):
    """Folds of experiments that break a rule."""
    return P.judged_folds(_folds(spark, sf_dir), "experiment_id", "place").where("fault IS NOT NULL").select("experiment_id", "place", "fault")


@R.add(f"""
    WITH {FOLDS}, k AS (SELECT experiment_id, string_agg('{{"fold_id":"' || fold_id || '","score_end":"' || strftime(score_end, '%Y-%m-%dT%H:%M:%S') || '+00:00","score_start":"' || strftime(score_start, '%Y-%m-%dT%H:%M:%S') || '+00:00","selection_end":"' || strftime(selection_end, '%Y-%m-%dT%H:%M:%S') || '+00:00","train_end":"' || strftime(train_end, '%Y-%m-%dT%H:%M:%S')
               || '+00:00","train_start":"' || strftime(train_start, '%Y-%m-%dT%H:%M:%S') || '+00:00"}}', ',' ORDER BY place) AS folds FROM j GROUP BY 1 HAVING count(fault) = 0)
    SELECT experiment_id, sha256('{{"config_sha256":"' || sha256('c' || experiment_id) || '","data_manifest_sha256":"' || sha256('d') || '","evidence_class":"HISTORICAL","experiment_id":"' || experiment_id || '","folds":[' || folds || '],"protocol_version":"1","source_sha256":"' || sha256('s') || '"}}') AS sha256 FROM k""")
def experiment_manifests(spark, sf_dir):
    """The digest of every experiment whose folds are in order."""
    folds = _folds(spark, sf_dir)
    bad = P.judged_folds(folds, "experiment_id", "place").where("fault IS NOT NULL").select("experiment_id")
    good = folds.join(bad, "experiment_id", "left_anti")
    experiments = good.select("experiment_id").distinct().select("experiment_id", F.lit("HISTORICAL").alias("evidence_class"), F.lit("1").alias("protocol_version"), F.sha2(F.lit("s"), 256).alias("source_sha256"), F.sha2(F.concat(F.lit("c"), "experiment_id"), 256).alias("config_sha256"), F.sha2(F.lit("d"), 256).alias("data_manifest_sha256"))
    return P.manifests(experiments, good).select("experiment_id", "sha256")


def _receipts(spark, sf_dir):
    """A receipt for each customer and year: its orders of that year as records; every 97th customer's payloads are not what their address says."""
    orders = table(spark, sf_dir, "orders").withColumns({"season": F.year("o_orderdate"), "customer": F.col("o_custkey")})
    record = F.struct(F.col("o_orderkey").alias("id"), "season", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    bodies = orders.groupBy("customer", "season").agg(F.to_json(F.struct(F.array_sort(F.collect_list(record)).alias("data"))).alias("body"), F.max("o_orderdate").alias("received_at"))
    damaged = F.col("customer") % 97 == 0
    return bodies.select("customer", "season", F.sha2(F.when(damaged, "lost").otherwise(F.col("body")), 256).alias("sha256"), F.col("body").cast("binary").alias("payload"), F.lit("plain").alias("encoding"), F.when(F.col("customer") % 89 == 0, 503).otherwise(200).alias("http_status"), "received_at")


@R.add("""
    WITH r AS (SELECT o_custkey AS customer, year(o_orderdate) AS season, '{"data":[' || string_agg('{"id":' || o_orderkey || ',"season":' || year(o_orderdate) || ',"status":"' || o_orderstatus || '","owner":' || o_custkey || '}', ',' ORDER BY o_orderkey) || ']}' AS body FROM orders GROUP BY 1, 2)
    SELECT customer, season, CASE WHEN customer % 97 = 0 THEN 'ADDRESS' END AS fault, CASE WHEN customer % 97 = 0 THEN 'plain' ELSE 'zstd' END AS encoding, CASE WHEN customer % 97 > 0 THEN sha256(body) END AS opened_sha256 FROM r""")
def converted_receipts(spark, sf_dir):
    """Payloads compressed, those at a wrong address left alone; the compressed ones opened again."""
    done = C.compressed(_receipts(spark, sf_dir))
    again = C.opened(done.where("encoding = 'zstd'")).select("customer", "season", F.sha2("payload", 256).alias("opened_sha256"))
    return done.select("customer", "season", "fault", "encoding").join(again, ["customer", "season"], "left")


@R.add("""
    WITH s AS (SELECT o_custkey AS customer, year(o_orderdate) AS season, max(o_orderdate) AS ts FROM orders GROUP BY 1, 2)
    SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS owner, strftime(ts, '%Y-%m-%d') AS day FROM orders JOIN s ON customer = o_custkey AND season = year(o_orderdate) WHERE season = 1995 AND o_custkey % 97 > 0 AND o_custkey % 89 > 0 AND o_orderstatus <> 'P' AND o_orderkey % 3 > 0""")
def backfilled_orders(spark, sf_dir):
    """Orders of 1995 that a table has lost, read back from compressed receipts; it still holds a third of them."""
    at = _scratch(spark)
    C.compressed(_receipts(spark, sf_dir)).where("fault IS NULL").drop("fault").write.parquet(at)
    receipts = spark.read.parquet(at)
    orders = table(spark, sf_dir, "orders").withColumn("season", F.year("o_orderdate"))
    times = receipts.select(F.col("customer").alias("o_custkey"), "season", F.col("received_at").alias("available_at"))
    asked = orders.where("season = 1995 AND o_custkey % 97 > 0 AND o_custkey % 89 > 0 AND o_orderstatus <> 'P'")
    stored = asked.where("o_orderkey % 3 = 0").join(times, ["o_custkey", "season"]).select("available_at", F.col("o_orderkey").alias("id"), F.col("season").cast("int").alias("season"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    added = C.backfill(receipts, "id: bigint, season: int, status: string, owner: bigint", stored, asked.select(F.col("o_orderkey").alias("id")), "id", "available_at", F.expr("TIMESTAMP_NTZ'1999-01-01 00:00:00'"), F.expr("season = 1995 AND status <> 'P'"))
    return added.select("id", "status", "owner", F.date_format("available_at", "yyyy-MM-dd").alias("day"))


@R.add("""
    WITH n AS (SELECT *, CASE WHEN o_custkey % 10 > 0 THEN o_custkey END AS owner FROM orders)
    SELECT o_orderkey, owner, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'X' ELSE o_orderstatus END AS status FROM n WHERE o_orderstatus <> 'O' OR o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderkey % 4 = 0""")
def appended_parts(spark, sf_dir):
    """A table of parts: one a status, then urgent rows that replace what is stored, then rows that are only added, then compaction."""
    at = _scratch(spark)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 > 0, F.col("o_custkey")).alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("urgent"))
    for status in ("F", "P"):
        S.append_part(rows.where(F.col("status") == status).drop("urgent"), at, ["o_orderkey", "owner"])
    S.append_part(rows.where("urgent").withColumn("status", F.lit("X")).drop("urgent"), at, ["o_orderkey", "owner"])
    S.append_part(rows.where("o_orderkey % 4 = 0").drop("urgent"), at, ["o_orderkey", "owner"], keep="first")
    S.compact_parts(spark, at, small_parts=3)
    return S.live_parts(spark, at)


#: A player's name as it is spelled here and on rosters; c is the customer. The same text is read by both engines.
SPELLED = {"name": "CASE WHEN c % 12 = 4 THEN concat('f l', c % 90) ELSE concat('n', c % 200) END", "last_name": "concat('l', c % 90)", "college": "CASE WHEN c % 11 > 0 THEN concat('k', c % 3) END"}
LISTED = {"full_name": "CASE WHEN c % 4 = 1 THEN concat('z', c) WHEN c % 4 > 1 THEN concat('n', c % 200) END", "football_name": "CASE WHEN c % 6 > 0 THEN 'f' END", "last_name": "CASE WHEN c % 17 > 0 THEN concat('l', c % 90) END", "college": "CASE WHEN c % 7 > 0 THEN concat('k', c % 3) ELSE 'other' END"}
SLOTS = "year(o_orderdate) AS season, month(o_orderdate) AS week, c % 8 AS team"


@R.add(f"""
    WITH o AS (SELECT *, o_custkey AS c FROM orders), a AS (SELECT c AS player, o_orderkey AS app, {SLOTS}, {", ".join(f"{v} AS {k}" for k, v in SPELLED.items())} FROM o),
         r AS (SELECT 'g' || CASE WHEN c % 13 = 0 THEN c - 8 ELSE c END AS id, {SLOTS}, {", ".join(f"{v} AS {k}" for k, v in LISTED.items())} FROM o),
         n AS (SELECT season, week, team, id, college, full_name AS name FROM r WHERE full_name IS NOT NULL UNION SELECT season, week, team, id, college, football_name || ' ' || last_name FROM r WHERE football_name IS NOT NULL AND last_name IS NOT NULL),
         j1 AS (SELECT a.player, a.app, n.id, a.college = n.college AS same FROM a JOIN n ON a.season = n.season AND a.week = n.week AND a.team = n.team AND a.name = n.name),
         j3 AS (SELECT a.player, a.app, r.id, a.college = r.college AS same FROM a JOIN r ON a.season = r.season AND a.week = r.week AND a.team = r.team AND a.last_name = r.last_name),
         r1 AS (SELECT player, count(DISTINCT id) AS n1, min(id) AS i1, count(DISTINCT id) FILTER (WHERE same) AS n2, min(id) FILTER (WHERE same) AS i2 FROM j1 GROUP BY 1),
         m3 AS (SELECT player, max(k) AS k FROM (SELECT player, app, count(DISTINCT id) AS k FROM j3 GROUP BY 1, 2) GROUP BY 1),
         r3 AS (SELECT player, count(DISTINCT id) FILTER (WHERE same) AS n3, min(id) FILTER (WHERE same) AS i3 FROM j3 GROUP BY 1),
         b AS (SELECT p.player, p.n, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3, coalesce(k, 0) AS k, i1, i2, i3 FROM (SELECT player, count(*) AS n FROM a GROUP BY 1) p LEFT JOIN r1 ON p.player = r1.player LEFT JOIN r3 ON p.player = r3.player LEFT JOIN m3 ON p.player = m3.player),
         u AS (SELECT *, CASE WHEN n1 = 1 THEN '{N.BY_NAME}' WHEN n1 > 1 AND n2 = 1 THEN '{N.BY_NAME_AND_COLLEGE}' WHEN n1 = 0 AND n3 = 1 AND k <= 1 THEN '{N.BY_LAST_NAME}' END AS rule FROM b),
         v AS (SELECT *, CASE rule WHEN '{N.BY_NAME}' THEN i1 WHEN '{N.BY_NAME_AND_COLLEGE}' THEN i2 WHEN '{N.BY_LAST_NAME}' THEN i3 END AS id FROM u), w AS (SELECT *, CASE WHEN id IS NOT NULL THEN count(*) OVER (PARTITION BY id) END AS claims FROM v)
    SELECT player, CASE WHEN claims = 1 THEN id END AS id, CASE WHEN claims > 1 THEN 'AMBIGUOUS' WHEN rule = '{N.BY_NAME}' THEN 'MATCHED_EXACT' WHEN rule IS NOT NULL THEN 'MATCHED_CORROBORATED' WHEN n1 > 1 OR n3 > 0 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS match_class, CASE WHEN claims = 1 THEN rule END AS match_rule, n AS n_appearances FROM w""")
def player_crosswalk(spark, sf_dir):
    """Players of box scores and who they are on the weekly rosters, by three rules."""
    orders = table(spark, sf_dir, "orders").withColumn("c", F.col("o_custkey"))
    slots = [F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), (F.col("c") % 8).alias("team")]
    appearances = orders.select(F.col("c").alias("player"), *slots, *[F.expr(v).alias(k) for k, v in SPELLED.items()])
    rosters = orders.select(F.concat(F.lit("g"), F.when(F.col("c") % 13 == 0, F.col("c") - 8).otherwise(F.col("c"))).alias("id"), *slots, *[F.expr(v).alias(k) for k, v in LISTED.items()])
    return N.player_crosswalk(appearances, rosters)


@R.add("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN o_totalprice + 1 ELSE o_totalprice END AS price, strftime(CASE WHEN o_orderkey % 3 > 0 THEN greatest(o_orderdate + to_days((o_orderkey % 4 * 3)::INT), o_orderdate + INTERVAL 5 DAY) ELSE o_orderdate + to_days((o_orderkey % 4 * 3)::INT) END, '%Y-%m-%d') AS day, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS estimated
    FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 < 2""")
def corrected_outcomes(spark, sf_dir):
    """Orders of which two thirds are stored come again five days later, two fifths at another price: what is new, and corrections, visible from when they were seen."""
    orders = table(spark, sf_dir, "orders")
    stored = orders.where("o_orderkey % 3 > 0").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("first_seen_at"))
    known = (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 4 * 3).cast("int"))).alias("available_at")
    batch = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 < 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("price"), (F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("first_seen_at"), known, (F.col("o_orderkey") % 2 == 0).alias("estimated"))
    out = S.append_outcomes(stored, batch.unionAll(batch.where("o_orderkey % 7 = 0")), ["o_orderkey"], ["price"], estimated="estimated")
    return out.select("o_orderkey", "price", F.date_format("available_at", "yyyy-MM-dd").alias("day"), "estimated")


@R.add("""
    WITH r AS (SELECT l_suppkey, CASE WHEN l_returnflag <> 'A' THEN l_quantity ELSE 0 END AS x, l_linenumber / 8 AS w FROM lineitem WHERE l_suppkey % 9 > 0), m AS (SELECT l_suppkey, sum(x * w) / sum(w) AS mean, count(*) AS n FROM r GROUP BY 1),
         v AS (SELECT l_suppkey, any_value(mean) AS mean, greatest(sum((x - mean) ** 2 * w) / sum(w), 1e-9) AS variance, any_value(n) AS n FROM r JOIN m USING (l_suppkey) GROUP BY 1),
         s AS (SELECT s_suppkey, coalesce(mean, 20.0) AS mean, coalesce(variance, 99.0) AS variance, coalesce(n, 0) AS n FROM supplier LEFT JOIN v ON s_suppkey = l_suppkey),
         p AS (SELECT *, CASE WHEN n = 0 THEN 20.0 ELSE n / (n + 40.0) * mean + (1 - n / (n + 40.0)) * 20.0 END AS posterior, CASE WHEN n = 0 THEN 50.0 ELSE 1 / (n / variance + 1 / 50.0) END AS left_over FROM s)
    SELECT s_suppkey, round(mean, 6) AS mean, round(variance, 6) AS variance, round(posterior, 6) AS posterior, round(0.9 * posterior + 0.1 * 20, 6) AS carried, round(left_over, 6) AS posterior_variance, round(30 / (1 + 4 * left_over), 6) AS concentration FROM p""")
def posterior_states(spark, sf_dir):
    """Every supplier's mean and variance, defaults where it has no rows, and the posterior after as many observations as it has lines."""
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey % 9 > 0").select(F.col("l_suppkey").alias("s_suppkey"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("x"), (F.col("l_linenumber") / 8).alias("weight"))
    states = T.moments_or_default(rows, table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], "x", 20.0, 99.0)
    out = states.join(rows.groupBy("s_suppkey").agg(F.count("*").alias("n")), "s_suppkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumns({"posterior": scoring.updated(F.col("mean"), F.col("n"), 20.0, 40.0), "posterior_variance": scoring.posterior_variance(F.col("variance"), F.col("n"), 50.0)})
    out = out.withColumns({"carried": scoring.carried(F.col("posterior"), 20.0, 0.9), "concentration": scoring.concentration(F.col("posterior_variance"), 30.0, 4.0)})
    return out.select("s_suppkey", *[rounded(c).alias(c) for c in ("mean", "variance", "posterior", "carried", "posterior_variance", "concentration")])


@R.add("SELECT l_suppkey, l_returnflag = 'N' AS estimated, count(*) AS n, strftime(max(CASE WHEN l_returnflag = 'N' THEN l_shipdate ELSE l_shipdate - INTERVAL 7 DAY END), '%Y-%m-%d') AS last FROM lineitem GROUP BY 1, 2")
def event_times(spark, sf_dir):
    """Lines known from their event on, a week before they were shipped; those without an event keep their time, as an estimate."""
    event = F.when(F.col("l_returnflag") != "N", F.col("l_shipdate") - F.expr("INTERVAL 7 DAYS")).alias("event_at")
    rows = K.event_time_known(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("available_at"), event), "event_at", estimated="estimated")
    return rows.groupBy("l_suppkey", "estimated").agg(F.count("*").alias("n"), F.date_format(F.max("available_at"), "yyyy-MM-dd").alias("last"))
