"""Scores of forecasts: the outcome is labels.quality, probabilities are bounded functions of the document's length."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.plans.common import Registry, rounded, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
FORECASTS = "f AS (SELECT d.doc_id, lang, quality::DOUBLE AS y, 0.05 + 0.9 * (n_chars % 1000) / 1000.0 AS p, 0.05 + 0.9 * (n_chars % 77) / 77.0 AS q FROM documents d JOIN labels l USING (doc_id))"


def _forecasts(spark, sf_dir):
    length = lambda n: F.lit(0.05) + F.lit(0.9) * (F.col("n_chars") % n) / float(n)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", F.col("quality").cast("double").alias("y"), length(1000).alias("p"), length(77).alias("q"))


@R.add(f"""
    WITH {FORECASTS}, g AS (SELECT lang, y::INT AS outcome, grouping(lang) * 2 + grouping(y::INT) AS slice, count(*) AS n, avg((p - y) ** 2) AS brier_model, avg((q - y) ** 2) AS brier_market,
        -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss_model, -avg(y * ln(q) + (1 - y) * ln(1 - q)) AS log_loss_market FROM f GROUP BY GROUPING SETS ((), (lang), (y::INT)))
    SELECT lang, outcome, slice, n, round(brier_model, 6) AS brier_model, round(brier_market, 6) AS brier_market, round(log_loss_model, 6) AS log_loss_model, round(log_loss_market, 6) AS log_loss_market FROM g""")
def market_benchmark(spark, sf_dir):
    """Model and market over all rows and by slices, in one pass."""
    out = E.benchmark(_forecasts(spark, sf_dir).withColumn("outcome", F.col("y").cast("int")), ["lang", "outcome"])
    return out.select("lang", "outcome", "slice", "n", *[rounded(c).alias(c) for c in ("brier_model", "brier_market", "log_loss_model", "log_loss_market")])


@R.add(f"WITH {FORECASTS} SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM f GROUP BY 1")
def reliability_curve(spark, sf_dir):
    return E.reliability(_forecasts(spark, sf_dir)).select("bin", "n", rounded("mean_p").alias("mean_p"), rounded("rate").alias("rate"))


@R.add(f"WITH {FORECASTS}, r AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS a, avg(y) AS b FROM f GROUP BY 1) SELECT round(sum(abs(a - b) * n) / sum(n), 6) AS ece FROM r")
def expected_calibration_error(spark, sf_dir):
    return E.calibration_error(_forecasts(spark, sf_dir)).select(rounded("ece").alias("ece"))


@R.add("""
    WITH r AS (SELECT l_suppkey, l_quantity AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    SELECT l_suppkey, round(avg(abs(x - 25)) - sum((2 * i - n - 1) * x) / any_value(n) / any_value(n), 5) AS crps FROM r GROUP BY 1""")
def sample_crps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", F.lit(25.0).alias("actual"))
    return E.sample_crps(rows, ["l_suppkey"], "l_quantity", "actual").select("l_suppkey", F.round("crps", 5).alias("crps"))


@R.add(f"""
    WITH {FORECASTS}, r AS (SELECT lang, p, row_number() OVER (PARTITION BY lang ORDER BY p) AS i, count(*) OVER (PARTITION BY lang) AS n FROM f)
    SELECT lang, round(max(greatest(i / n - p, p - (i - 1) / n)), 6) AS ks FROM r GROUP BY 1""")
def uniformity_distance(spark, sf_dir):
    return E.uniformity(_forecasts(spark, sf_dir), ["lang"], "p").select("lang", rounded("ks").alias("ks"))
