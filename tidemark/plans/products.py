"""Calibration, immutable products, lineage and raw payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calibration as C, evaluation as E, products as P
from tidemark.operators.prequential import prequential
from tidemark.plans.common import Registry, rounded, table
from tidemark.plans.evaluation import FORECASTS, _forecasts
from tidemark.sources import raw

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.add()
def logistic_calibration(spark, sf_dir):
    """Weights of a logistic map of the forecast's log odds."""
    w = C.fit_logistic(_forecasts(spark, sf_dir), [C.logit(F.col("p"))], "y")
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in zip(("intercept", "slope"), w, strict=True)], "name string, weight double")


@R.add(f"""
    WITH {FORECASTS}, e AS (SELECT p, sum(y) AS s, count(*) AS n FROM f GROUP BY 1), c AS (SELECT p, row_number() OVER o AS i, sum(s) OVER o AS s, sum(n) OVER o AS n FROM e WINDOW o AS (ORDER BY p)),
         z AS (SELECT 0 AS i, 0.0 AS s, 0 AS n UNION ALL SELECT i, s, n FROM c),
         lows AS (SELECT a.i AS a, c.i, min((b.s - a.s) / (b.n - a.n)) AS low FROM z a JOIN c ON a.i < c.i JOIN c b ON b.i >= c.i GROUP BY 1, 2), v AS (SELECT i, max(low) AS fitted FROM lows GROUP BY 1)
    SELECT doc_id, round(fitted, 6) AS fitted FROM f JOIN c USING (p) JOIN v USING (i)""")
def isotonic_calibration(spark, sf_dir):
    """Each labelled document's forecast, calibrated by a rising function."""
    rows = _forecasts(spark, sf_dir)
    return C.apply_isotonic(rows, C.fit_isotonic(rows, "p", "y"), "p").select("doc_id", rounded("fitted").alias("fitted"))


@R.add()
def fitted_calibrators(spark, sf_dir):
    """Each labelled document's forecast under three calibrators, and which of them has the least loss."""
    out, name = C.choose_calibrator(_forecasts(spark, sf_dir), "p", "y")
    return out.select("doc_id", *[rounded(m).alias(m) for m in C.METHODS]).withColumn("chosen", F.lit(name))


@R.add()
def prequential_methods(spark, sf_dir):
    """Every line's probability, calibrated by what was known before its month: by return flag, else by line status, else by all lines."""
    at = F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = table(spark, sf_dir, "lineitem").select(*key, "l_returnflag", "l_linestatus", (F.lit(0.05) + F.lit(0.9) * ((F.col("l_partkey") * 7 + F.col("l_quantity").cast("long")) % 100) / 100).alias("p"), (F.col("l_quantity") > 25).cast("int").alias("y"), at.alias("asked"), (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(days=F.col("l_linenumber"))).alias("known"))
    return prequential(rows, key, {"prop": "l_returnflag", "position": "l_linestatus", "global": None}, "p", "y", "asked", "known", 200)


@R.add(f"""
    WITH {FORECASTS}, b AS (SELECT lang, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS a, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS b FROM f GROUP BY 1)
    SELECT lang, CASE WHEN a <= b THEN 'p' ELSE 'q' END AS choice FROM b""")
def calibrator_choice(spark, sf_dir):
    return C.choose(_forecasts(spark, sf_dir), ["lang"], ["p", "q"], "y")


@R.add("""
    SELECT l_orderkey, l_linenumber, round((coalesce(sum((l_returnflag = 'R')::INT) OVER w, 0) + 0.25 * 10) / (count(*) OVER w + 10), 6) AS prequential
    FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY epoch_us(l_shipdate) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prequential_rate(spark, sf_dir):
    """Each supplier's rate of returns before the line's own date."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return C.prior_rate(rows, ["l_suppkey"], "at", "y", 0.25, 10.0).select("l_orderkey", "l_linenumber", rounded("prequential").alias("prequential"))


@R.add("""
    WITH o AS (SELECT year(o_orderdate) AS season, o_totalprice AS x FROM orders), s AS (SELECT DISTINCT season AS fold FROM o WHERE season > (SELECT min(season) FROM o))
    SELECT fold, CASE WHEN season = fold THEN 'score' ELSE 'fit' END AS role, count(*) AS n, round(avg(x), 4) AS mean FROM o JOIN s ON season <= fold GROUP BY ALL""")
def walk_forward_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("season"), "o_totalprice")
    return C.fold_totals(rows, "season", ["o_totalprice"]).select("fold", "role", "n", F.round(F.col("sum_o_totalprice") / F.col("n_o_totalprice"), 4).alias("mean"))


BENCHMARK = """
    c AS (SELECT lang, y, p, q, 0 AS one FROM f),
    g AS (SELECT lang, grouping(lang) AS slice, count(*) AS n, avg((p - y) ** 2) AS bm, avg((q - y) ** 2) AS bq, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS lm, -avg(y * ln(q) + (1 - y) * ln(1 - q)) AS lq FROM c GROUP BY GROUPING SETS ((), (lang))),
    m AS (SELECT lang, slice, sum(gap) / sum(k) AS em FROM (SELECT lang, grouping(lang) AS slice, least(floor(p * 10), 9) AS b, count(*) AS k, abs(sum(p) - sum(y)) AS gap FROM c GROUP BY GROUPING SETS ((least(floor(p * 10), 9)), (lang, least(floor(p * 10), 9)))) GROUP BY 1, 2),
    w AS (SELECT lang, slice, sum(gap) / sum(k) AS eq FROM (SELECT lang, grouping(lang) AS slice, least(floor(q * 10), 9) AS b, count(*) AS k, abs(sum(q) - sum(y)) AS gap FROM c GROUP BY GROUPING SETS ((least(floor(q * 10), 9)), (lang, least(floor(q * 10), 9)))) GROUP BY 1, 2),
    b AS (SELECT g.*, em, eq FROM g JOIN m ON g.slice = m.slice AND g.lang IS NOT DISTINCT FROM m.lang JOIN w ON g.slice = w.slice AND g.lang IS NOT DISTINCT FROM w.lang)"""


@R.add(f"""
    WITH {FORECASTS}, {BENCHMARK}
    SELECT lang, n, round(em, 6) AS ece_model, round(eq, 6) AS ece_market, n >= 500 AND lm < lq AND bm < bq AND em <= eq + 0.01 AS promoted,
        concat_ws(', ', CASE WHEN n < 500 THEN 'sample too small' END, CASE WHEN lm >= lq THEN 'log loss not better' END, CASE WHEN bm >= bq THEN 'Brier score not better' END, CASE WHEN em > eq + 0.01 THEN 'calibration error worse' END) AS reasons FROM b""")
def promotion_gate(spark, sf_dir):
    """Both scores strictly better, 500 rows, and calibration no worse than 0.01 beyond the market's."""
    out = P.promotion(E.full_benchmark(_forecasts(spark, sf_dir), ["lang"]))
    return out.select("lang", "n", rounded("ece_model").alias("ece_model"), rounded("ece_market").alias("ece_market"), "promoted", F.concat_ws(", ", "reasons").alias("reasons"))


HASHED = """
    j AS (SELECT l_orderkey AS run, sha256(json_object('l_linenumber', l_linenumber, 'l_partkey', l_partkey, 'l_returnflag', l_returnflag)::VARCHAR) AS h FROM {rows}),
    s AS (SELECT run, count(*) AS n_rows, sum(('0x' || substr(h, 1, 15))::BIGINT::DECIMAL(38,0)) AS a, sum(('0x' || substr(h, 16, 15))::BIGINT::DECIMAL(38,0)) AS b FROM j GROUP BY 1)"""
CONTENT = ["l_linenumber", "l_partkey", "l_returnflag"]


@R.add(f"WITH {HASHED.format(rows='lineitem')} SELECT run, n_rows, sha256(concat_ws('|', n_rows, a, b)) AS content_hash FROM s")
def product_headers(spark, sf_dir):
    """The header of each run and its hash, the same however the rows are dealt out."""
    return P.header(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "run"), "run", CONTENT)


@R.add("SELECT l_orderkey AS run, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_quantity = 50) > 0")
def product_conflicts(spark, sf_dir):
    """Runs that are stored and come again with another row; those that come again unchanged are no conflict."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "run")
    again = rows.repartition("l_partkey").withColumn("l_partkey", F.when(F.col("l_quantity") == 50, -1).otherwise(F.col("l_partkey")))
    return P.conflicts(P.header(rows, "run", CONTENT), P.header(again, "run", CONTENT), "run").select("run", "n_rows")


@R.add("""
    WITH r AS (SELECT l_orderkey % 997 AS grid, l_linenumber FROM lineitem WHERE l_partkey % 50 = 0)
    SELECT grid, (SELECT count(DISTINCT l_linenumber) FROM r) - count(DISTINCT l_linenumber) AS n_missing FROM r GROUP BY 1 HAVING n_missing > 0""")
def incomplete_grids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_partkey % 50 = 0").withColumn("grid", F.col("l_orderkey") % 997)
    return P.missing_grid(rows, ["grid"], "l_linenumber")


@R.add("""
    SELECT l_orderkey, l_linenumber, 'shipped' AS clock, 'future' AS rule FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 90 DAY""")
def leakage_audit(spark, sf_dir):
    """Facts that became known only after their cutoff, 90 days behind the order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("cutoff"), F.col("o_orderdate").alias("ordered"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("shipped")).join(orders, "l_orderkey")
    return P.leaks(rows, "cutoff", ["shipped", "ordered"]).select("l_orderkey", "l_linenumber", "clock", "rule")


@R.add("SELECT sha256(props) AS sha256, any_value(props) AS props, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_received, count(*) AS n_received FROM events WHERE props IS NOT NULL GROUP BY props")
def raw_landing(spark, sf_dir):
    out = raw.landing(table(spark, sf_dir, "events").where("props IS NOT NULL"), "props", "ts")
    return out.withColumn("first_received", F.date_format("first_received", "yyyy-MM-dd HH:mm:ss"))
