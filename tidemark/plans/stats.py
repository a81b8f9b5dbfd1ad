"""Draws are orders, players suppliers; statistics come from the columns of their lines."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.operators import stats as S
from tidemark.plans.common import Registry, rounded, table, tied

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
#: Every column of a draw, from whole numbers of a line; the SQL is read by both engines.
BASE = {
    "targets": "l_linenumber + q % 8", "receptions": "l_linenumber", "receiving_yards": "q * 3", "receiving_tds": "l_linenumber % 3", "longest_reception": "q", "rush_attempts": "l_partkey % 27",
    "rushing_yards": "l_partkey % 160", "rushing_tds": "l_partkey % 2", "longest_rush": "l_partkey % 45", "passing_attempts": "15 + l_orderkey % 40", "passing_completions": "10 + l_orderkey % 25",
    "passing_yards": "l_orderkey % 420", "passing_tds": "l_orderkey % 5", "interceptions": "(l_orderkey + l_linenumber) % 4", "longest_pass": "l_orderkey % 65", "fg_attempts": "(l_orderkey + l_linenumber) % 5",
    "fg_made": "(l_orderkey + l_linenumber) % 5 * (l_partkey % 2)", "xp_made": "l_partkey % 6", "kicking_points": "(l_orderkey + l_linenumber) % 5 * (l_partkey % 2) * 3 + l_partkey % 6", "rushing_receiving_yards": "l_partkey % 160 + q * 3",
    "first_td": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
}
PARTS_OF = [*S.HALVES, "receiving_tds", "rushing_tds"]
COLUMNS = {k: f"CAST({v} AS BIGINT)" for k, v in (BASE | {f"q{i}_{s}": f"({BASE[s]} + {i}) % {i + 1}" for s in PARTS_OF for i in range(1, 6)}).items()}
STATS = [*S.NATIVE, *S.DERIVED, *S.CATALOG_STATS]
VALUES = {s: f"({S.formula(s)} >= 1)::BIGINT" if s in S.BINARY else S.formula(s) for s in STATS}
DRAWS = f"""
    b AS (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
    d AS (SELECT l_suppkey, l_orderkey, l_linenumber, {", ".join(f"{v} AS {k}" for k, v in COLUMNS.items())} FROM b)"""
LONG = f"""{DRAWS},
    x AS (SELECT l_suppkey, unnest([{", ".join(f"{{'stat': '{k}', 'value': {v}}}" for k, v in VALUES.items())}], recursive := true) FROM d),
    m AS (SELECT l_suppkey, stat, value AS outcome, count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey, stat) AS p FROM x GROUP BY 1, 2, 3)"""


def _draws(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", *[F.expr(v).alias(k) for k, v in COLUMNS.items()])


def _rows(spark, sf_dir):
    return S.long_form(_draws(spark, sf_dir), ["l_suppkey"], STATS)


def _pmf(spark, sf_dir, stats=None):
    return S.stat_pmf(_draws(spark, sf_dir), ["l_suppkey"], stats or STATS)


@R.add(f"WITH {DRAWS} SELECT l_orderkey, sum(receiving_yards)::BIGINT AS receiving_yards, count(*) AS n_draws FROM d WHERE l_linenumber < 4 GROUP BY 1")
def retained_draws(spark, sf_dir):
    """Only the first draws of each game are kept: those numbered below 4."""
    kept = S.first_draws(_draws(spark, sf_dir), "l_linenumber", 4)
    return kept.groupBy("l_orderkey").agg(F.sum("receiving_yards").alias("receiving_yards"), F.count("*").alias("n_draws"))


@R.add(f"""
    WITH {DRAWS}, x AS (SELECT l_suppkey, unnest([{", ".join(f"{{'prop': '{k}', 'value': {S.formula(k, False)}}}" for k in S.PROPS)}], recursive := true) FROM d)
    SELECT l_suppkey, prop, count(*) AS n_draws, sum(value)::BIGINT AS total, max(value) AS most FROM x GROUP BY 1, 2""")
def prop_totals(spark, sf_dir):
    """All 25 kinds of props of every draw, second halves without overtime."""
    rows = S.props(_draws(spark, sf_dir), ["l_suppkey"], overtime=False)
    return rows.groupBy("l_suppkey", "prop").agg(F.count("*").alias("n_draws"), F.sum("value").alias("total"), F.max("value").alias("most"))


@R.add(f"WITH {LONG} SELECT l_suppkey, stat, count(*) AS n_draws, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(avg((value > 0)::INT), 6) AS p_positive FROM x GROUP BY 1, 2")
def projection_product(spark, sf_dir):
    out = S.projections(_rows(spark, sf_dir), ["l_suppkey", "stat"])
    return out.select("l_suppkey", "stat", "n_draws", *[rounded(c).alias(c) for c in ("mean", "sd", "p_positive")])


@R.add(f"WITH {LONG} SELECT l_suppkey, stat, outcome, round(p, 9) AS p FROM m")
def stat_distributions(spark, sf_dir):
    """Distributions of all statistics, packed into arrays, checked and unpacked again."""
    table_ = S.unpacked(S.packed(_pmf(spark, sf_dir), ["l_suppkey", "stat"]), ["l_suppkey", "stat"])
    return table_.select("l_suppkey", "stat", "outcome", F.round("p", 9).alias("p"))


@R.add("""
    WITH d AS (SELECT l_suppkey, l_linenumber AS i, array_agg(struct_pack(o := l_quantity::BIGINT, p := 0.5) ORDER BY l_orderkey, l_quantity, l_partkey)[1:2] AS a FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, i, CASE WHEN a[1].o >= a[2].o THEN 'ORDER' WHEN i = 3 THEN 'MASS' WHEN i = 5 THEN 'SUM' END AS fault FROM d""")
def distribution_faults(spark, sf_dir):
    """What is wrong with arrays of outcomes that nobody sorted, some with a negative or a missing part."""
    order = ["l_orderkey", "l_quantity", "l_partkey"]
    place = F.row_number().over(Window.partitionBy("l_suppkey", "l_linenumber").orderBy(*order))
    two = table(spark, sf_dir, "lineitem").withColumn("place", place).where("place <= 2")
    rows = two.groupBy("l_suppkey", F.col("l_linenumber").alias("i")).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("a"))
    p = F.when(F.col("i") == 3, -0.5).when(F.col("i") == 5, 0.25).otherwise(0.5)
    return rows.select("l_suppkey", "i", S.faults(F.transform("a", lambda x: F.struct(x["l_quantity"].cast("long").alias("outcome"), p.alias("p")))).alias("fault"))


@R.add(f"""
    WITH {LONG}, c AS (SELECT *, sum(p) OVER (PARTITION BY l_suppkey, stat ORDER BY outcome) AS c FROM m)
    SELECT l_suppkey, stat, min(outcome) AS quantile FROM c WHERE c >= 0.8 - 1e-12 GROUP BY 1, 2""")
def weighted_quantiles(spark, sf_dir):
    return S.weighted_quantile(_pmf(spark, sf_dir), ["l_suppkey", "stat"], 0.8)


@R.add(f"""
    WITH {LONG}, e AS ({" UNION ALL ".join(f"SELECT '{k}' AS stat, unnest({v}) AS threshold, '{'MILESTONE_ONLY' if k in S.MILESTONES else 'STANDARD_THRESHOLD_ELIGIBLE'}' AS classification" for k, v in S.LADDERS.items())})
    SELECT l_suppkey, stat, threshold, classification, round(sum(CASE WHEN outcome >= threshold THEN p ELSE 0 END), 6) AS p_hit FROM m JOIN e USING (stat) GROUP BY 1, 2, 3, 4""")
def catalog_thresholds(spark, sf_dir):
    """Chances of at least each threshold of the whole catalog, from the distributions."""
    out = S.threshold_product(_pmf(spark, sf_dir, list(S.LADDERS)), ["l_suppkey", "stat"], S.catalog(spark))
    return out.select("l_suppkey", "stat", "threshold", "classification", tied("p_hit").alias("p_hit"))


@R.add(f"""
    WITH {LONG}, q AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN 'OVER' WHEN 1 THEN 'UNDER' ELSE 'HIT' END AS side, floor(l_quantity / 2) + CASE WHEN l_quantity > 40 THEN 0.5 ELSE 0 END AS line, CAST(round(100 + 1000 * l_tax) AS INT) AS odds FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-01-01'),
         w AS (SELECT q.*, sum(CASE WHEN (side = 'OVER' AND outcome > line) OR (side = 'UNDER' AND outcome < line) OR (side = 'HIT' AND outcome >= line) THEN p ELSE 0 END) AS w, sum(CASE WHEN side <> 'HIT' AND outcome = line THEN p ELSE 0 END) AS push
               FROM q JOIN m ON m.l_suppkey = q.l_suppkey AND stat = 'receiving_yards' GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, side, round(w, 6) AS p_win, round(push, 6) AS p_push, round(w * odds / 100.0 - (1 - w - push), 6) AS ev FROM w""")
def price_board(spark, sf_dir):
    """Every quote up to the cutoff, priced under the distribution of its player's yards."""
    cutoff = F.expr("TIMESTAMP_NTZ'1996-01-01 00:00:00'")
    side = F.when(F.col("l_linenumber") % 3 == 0, "OVER").when(F.col("l_linenumber") % 3 == 1, "UNDER").otherwise("HIT")
    line = F.floor(F.col("l_quantity") / 2) + F.when(F.col("l_quantity") > 40, 0.5).otherwise(0.0)
    quotes = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= cutoff).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", side.alias("side"), line.alias("line"), F.round(F.lit(100) + F.col("l_tax") * 1000).cast("int").alias("odds"))
    yards = _pmf(spark, sf_dir, ["receiving_yards"]).drop("stat")
    out = S.priced(quotes, yards, ["l_suppkey"], cutoff, "l_shipdate")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "side", *[tied(c).alias(c) for c in ("p_win", "p_push", "ev")])


@R.add("""
    WITH p AS (SELECT p_partkey, p_brand AS team, p_size % 7 <> 0 AS active, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size % 11 / 11 END AS share, CASE p_size % 4 WHEN 0 THEN 'QB' WHEN 1 THEN 'K' WHEN 2 THEN 'WR' END AS position, CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS depth FROM part),
         r AS (SELECT *, row_number() OVER (PARTITION BY team, position ORDER BY share DESC, depth NULLS LAST, p_partkey) AS q, row_number() OVER (PARTITION BY team, position ORDER BY depth NULLS LAST, p_partkey) AS k FROM p WHERE active)
    SELECT p_partkey, coalesce((position = 'QB' AND q = 1) OR (position = 'K' AND k = 1), false) AS starter FROM r WHERE share > 0 OR coalesce((position = 'QB' AND q = 1) OR (position = 'K' AND k = 1), false)""")
def eligible_players(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("team"), (size % 7 != 0).alias("active"), F.when(size % 3 == 0, 0.0).otherwise(size % 11 / 11).alias("share"),
        F.when(size % 4 == 0, "QB").when(size % 4 == 1, "K").when(size % 4 == 2, "WR").alias("position"), F.when(size % 5 > 0, size % 5).alias("depth"),
    )
    return S.eligible(rows, ["team"], "p_partkey", "active", "share", "position", "depth").select("p_partkey", "starter")


PARTS = "CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS a, CASE WHEN l_linestatus = 'F' THEN l_linenumber * 10.0 END AS b"


@R.add(f"""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, {PARTS}, CASE l_linenumber % 3 WHEN 0 THEN 'OVER' WHEN 1 THEN 'UNDER' ELSE 'HIT' END AS side FROM lineitem),
         v AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a + b END AS strict, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END AS lenient FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, a AS field, strict, lenient, CASE WHEN lenient IS NULL OR (side <> 'HIT' AND lenient = 40) THEN NULL WHEN side = 'OVER' THEN (lenient > 40)::INT WHEN side = 'UNDER' THEN (lenient < 40)::INT ELSE (lenient >= 40)::INT END AS result FROM v""")
def settlement_values(spark, sf_dir):
    """What each rule makes of a row with unknown parts, and the result of a bet on the lenient one."""
    from tidemark.functions import odds

    side = F.when(F.col("l_linenumber") % 3 == 0, "OVER").when(F.col("l_linenumber") % 3 == 1, "UNDER").otherwise("HIT")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", side.alias("side"), *[F.expr(p) for p in ("CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS a", "CASE WHEN l_linestatus = 'F' THEN l_linenumber * 10.0D END AS b")])
    lenient = S.actual(["a", "b"], "zero_if_any_known")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", S.actual(["a"]).alias("field"), S.actual(["a", "b"], "require_all").alias("strict"), lenient.alias("lenient"), odds.outcome(F.col("side"), lenient, F.lit(40.0)).alias("result"))


@R.add("""
    WITH b AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, CASE l_linenumber % 2 WHEN 0 THEN 'OVER' ELSE 'UNDER' END AS side, l_quantity AS line FROM lineitem),
         a AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS actual FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
    SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, actual, CASE WHEN actual = line THEN NULL WHEN side = 'OVER' THEN (actual > line)::INT ELSE (actual < line)::INT END AS result,
        CASE WHEN actual = line THEN 0 WHEN (actual > line) = (side = 'OVER') THEN round(100 / 110, 6) ELSE -1 END::DOUBLE AS profit FROM b JOIN a USING (l_orderkey, l_suppkey)""")
def settled_bets(spark, sf_dir):
    """Bets looked up in the results of their game and player; those without a result are dropped."""
    lines = table(spark, sf_dir, "lineitem")
    bets = lines.select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, "OVER").otherwise("UNDER").alias("side"), F.col("l_quantity").alias("line"), F.lit(-110).alias("odds"))
    actuals = lines.where("l_linestatus = 'F'").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("actual"))
    return S.settled(bets, actuals, ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "actual", "result", rounded("profit").alias("profit"))


@R.add("""
    WITH d AS (SELECT l_suppkey, l_returnflag, sha256(concat_ws('|', l_suppkey, l_returnflag)) AS distribution_id, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, l_partkey, distribution_id FROM lineitem JOIN d USING (l_suppkey, l_returnflag)""")
def distribution_links(spark, sf_dir):
    """Each prediction with the id of its distribution."""
    from tidemark.functions.text import stable_id

    lines = table(spark, sf_dir, "lineitem")
    stored = lines.groupBy("l_suppkey", "l_returnflag").agg(stable_id(F.col("l_suppkey"), F.col("l_returnflag")).alias("distribution_id"))
    return S.linked(lines, stored, ["l_suppkey", "l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", "distribution_id")
