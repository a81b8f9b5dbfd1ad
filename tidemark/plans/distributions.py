"""Distributions: draws are lineitems, the outcome is l_quantity as a whole number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import distributions as D
from tidemark.plans.common import Registry, rounded, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
GROUP = ["l_returnflag", "l_linestatus"]
G = "l_returnflag, l_linestatus"
PMF = f"m AS (SELECT {G}, l_quantity::INT AS x, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY {G}) AS p FROM m), c AS (SELECT *, sum(p) OVER (PARTITION BY {G} ORDER BY x) AS cdf FROM p)"
QS = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
CATALOG = [1, 5, 10, 20, 30, 40, 50]
#: Draws of each game, as many as the reference makes by default.
DRAWS = 20_000


def _draws(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_quantity").cast("int"))


def _pmf(spark, sf_dir):
    return D.pmf(_draws(spark, sf_dir), GROUP, "x")


@R.add(f"WITH {PMF} SELECT {G}, x, round(p, 6) AS p FROM p")
def raw_pmf(spark, sf_dir):
    return _pmf(spark, sf_dir).withColumn("p", rounded("p"))


@R.add(f"WITH w AS (SELECT *, power(0.5, l_linenumber) AS w FROM lineitem), m AS (SELECT {G}, l_quantity::INT AS x, sum(w) AS n FROM w GROUP BY ALL) SELECT {G}, x, round(n / sum(n) OVER (PARTITION BY {G}), 6) AS p FROM m")
def weighted_pmf(spark, sf_dir):
    rows = _draws(spark, sf_dir).withColumn("w", F.pow(F.lit(0.5), F.col("l_linenumber")))
    return D.pmf(rows, GROUP, "x", "w").withColumn("p", rounded("p"))


@R.add(f"WITH {PMF} SELECT {G}, " + ", ".join(f"min(x) FILTER (WHERE cdf >= {q} - 1e-12) AS q{round(q * 100):02d}" for q in QS) + f" FROM c GROUP BY {G}")
def pmf_quantiles(spark, sf_dir):
    return D.quantiles(_pmf(spark, sf_dir), GROUP, "x", QS)


@R.add(f"WITH {PMF} SELECT {G}, round(sum(x * p), 6) AS mean, round(sum(p) FILTER (WHERE x > 25), 6) AS p_over, round(sum(p) FILTER (WHERE x < 25), 6) AS p_under, round(sum(p) FILTER (WHERE x = 25), 6) AS p_push FROM p GROUP BY {G}")
def line_probabilities(spark, sf_dir):
    out = D.line_probabilities(_pmf(spark, sf_dir), GROUP, "x", F.lit(25))
    return out.select(*GROUP, *[rounded(c).alias(c) for c in ("mean", "p_over", "p_under", "p_push")])


@R.add(f"SELECT {G}, count(*) AS n_draws, round(avg(l_extendedprice), 4) AS mean, " + ", ".join(f"quantile_disc(l_extendedprice, {q}) AS p{round(q * 100):02d}" for q in QS) + f" FROM lineitem GROUP BY {G}")
def order_statistics(spark, sf_dir):
    return D.order_statistics(table(spark, sf_dir, "lineitem"), GROUP, "l_extendedprice", QS).withColumn("mean", F.round("mean", 4))


@R.add(f"""
    SELECT {G}, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.05), 6) AS p05, round(quantile_cont(l_quantity, 0.1), 6) AS p10, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(median(l_quantity), 6) AS p50,
        round(quantile_cont(l_quantity, 0.75), 6) AS p75, round(quantile_cont(l_quantity, 0.9), 6) AS p90, round(quantile_cont(l_quantity, 0.95), 6) AS p95,
        round(avg((l_quantity > 25)::INT), 6) AS p_over, round(avg((l_quantity < 25)::INT), 6) AS p_under, round(avg((l_quantity = 25)::INT), 6) AS p_push FROM lineitem GROUP BY {G}""")
def prop_summary(spark, sf_dir):
    """Mean, seven quantiles, and the chances at a line."""
    rows, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    share = lambda test, name: rounded(F.avg(test.cast("double"))).alias(name)
    chances = rows.groupBy(*GROUP).agg(share(q > 25, "p_over"), share(q < 25, "p_under"), share(q == 25, "p_push"))
    out = D.interpolated(rows, GROUP, "l_quantity", [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]).join(chances, GROUP)
    return out.select(*GROUP, *[rounded(c).alias(c) for c in ("mean", "p05", "p10", "p25", "p50", "p75", "p90", "p95")], "p_over", "p_under", "p_push")


@R.add(f"SELECT {G}, t.threshold, round(avg((l_quantity >= t.threshold)::INT), 6) AS p_hit FROM lineitem, (VALUES {', '.join(f'({t})' for t in CATALOG)}) AS t(threshold) GROUP BY ALL")
def threshold_grid(spark, sf_dir):
    return D.thresholds(_draws(spark, sf_dir), GROUP, "x", CATALOG).withColumn("p_hit", rounded("p_hit"))


@R.add(f"""
    WITH g AS (SELECT {G}, t AS threshold, avg((l_quantity::INT >= t)::INT) + any_value(CASE WHEN t = 30 THEN 0.3 ELSE 0 END) AS p_hit FROM lineitem, (SELECT unnest([{", ".join(map(str, CATALOG))}]) AS t) GROUP BY ALL),
         b AS (SELECT *, lag(p_hit) OVER (PARTITION BY {G} ORDER BY threshold) AS before FROM g)
    SELECT {G}, threshold, round(p_hit, 6) AS p_hit, round(before, 6) AS before FROM b WHERE p_hit > before""")
def threshold_violations(spark, sf_dir):
    """A grid with a threshold whose probability was raised by 0.3."""
    grid = D.thresholds(_draws(spark, sf_dir), GROUP, "x", CATALOG).withColumn("p_hit", F.col("p_hit") + F.when(F.col("threshold") == 30, 0.3).otherwise(0.0))
    return D.rising(grid, GROUP).select(*GROUP, "threshold", rounded("p_hit").alias("p_hit"), rounded("before").alias("before"))


@R.add("SELECT l_orderkey, l_linenumber, round(coalesce((l_quantity - avg(l_quantity) OVER w) / nullif(stddev_pop(l_quantity) OVER w, 0), 0), 5) AS z FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def game_z_scores(spark, sf_dir):
    return D.z_scores(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", F.round("z", 5).alias("z"))


SOFT = "e AS (SELECT l_orderkey, l_linenumber, exp(l_quantity / 10 - max(l_quantity / 10) OVER w) AS e FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)), s AS (SELECT *, e / sum(e) OVER (PARTITION BY l_orderkey) AS weight FROM e)"


@R.add(f"WITH {SOFT} SELECT l_orderkey, l_linenumber, round(weight, 6) AS weight FROM s")
def entropy_weights(spark, sf_dir):
    return D.softmax_weights(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_quantity") / 10).select("l_orderkey", "l_linenumber", rounded("weight").alias("weight"))


@R.add(f"WITH {SOFT} SELECT l_orderkey, round(1 / sum(weight * weight), 5) AS ess, round(max(weight), 6) AS max_weight, round(-sum(CASE WHEN weight > 0 THEN weight * ln(weight) ELSE 0 END), 6) + 0.0::DOUBLE AS entropy FROM s GROUP BY 1")
def weight_diagnostics(spark, sf_dir):
    out = D.weight_diagnostics(D.softmax_weights(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_quantity") / 10), ["l_orderkey"])
    return out.select("l_orderkey", F.round("ess", 5).alias("ess"), rounded("max_weight").alias("max_weight"), rounded("entropy").alias("entropy"))


@R.add(f"""
    WITH {PMF}, s AS (SELECT {G}, cdf, x, unnest(range(0, 51)) AS k FROM c),
         f AS (SELECT {G}, k, coalesce(max(cdf) FILTER (WHERE x <= k), 0) AS cdf FROM s GROUP BY ALL)
    SELECT {G}, round(sum(power(cdf - (k >= 25)::INT, 2)), 6) AS crps FROM f GROUP BY {G}""")
def pmf_crps(spark, sf_dir):
    """Against an actual value of 25."""
    return D.pmf_crps(_pmf(spark, sf_dir), GROUP, "x", F.lit(25)).withColumn("crps", rounded("crps"))


@R.add("SELECT l_orderkey, sum(l_quantity) AS plays, sum(l_extendedprice > 30000)::BIGINT AS scores, max(l_quantity) - min(l_quantity) AS margin, bool_or(l_returnflag = 'R') AS turnover FROM lineitem GROUP BY 1")
def joint_totals(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(q).alias("plays"), F.count_if(F.col("l_extendedprice") > 30000).alias("scores"), (F.max(q) - F.min(q)).alias("margin"), F.bool_or(F.col("l_returnflag") == "R").alias("turnover"))
