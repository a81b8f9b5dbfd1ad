"""States of teams (suppliers) and players (parts) from games (orders): l_quantity counts, l_extendedprice yards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.plans.common import Registry, rounded, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
HALF_LIFE = 365.0
AGE = "greatest(date_diff('day', l_shipdate, TIMESTAMP '1998-12-01'), 0)"
WEIGHT = f"power(0.5, {AGE} / 365.0)"


def _weighted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return state.weighted(rows, F.datediff(F.lit("1998-12-01").cast("date"), F.col("l_shipdate").cast("date")).cast("double"), HALF_LIFE)


@R.add("SELECT l_orderkey, l_linenumber, l_quantity + coalesce(l_tax * 100, 0) AS dropbacks, l_quantity + coalesce(l_tax * 100, 0) + l_discount * 100 AS plays FROM lineitem")
def play_counts(spark, sf_dir):
    drop = F.coalesce(F.col("l_quantity"), F.lit(0)) + F.coalesce(F.col("l_tax") * 100, F.lit(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", drop.alias("dropbacks"), (drop + F.coalesce(F.col("l_discount") * 100, F.lit(0))).alias("plays"))


@R.add("""
    WITH t AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS plays FROM lineitem GROUP BY ALL)
    SELECT a.l_orderkey, a.l_suppkey, a.plays, b.l_suppkey AS opp_team, b.plays AS opp_plays FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey""")
def reversed_opponents(spark, sf_dir):
    totals = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("plays"))
    return state.opponents(totals, "l_orderkey", "l_suppkey", ["plays"])


@R.add(f"""
    WITH w AS (SELECT *, {WEIGHT} AS weight FROM lineitem),
         m AS (SELECT l_suppkey, sum(l_quantity * weight) / sum(weight) AS mean FROM w GROUP BY 1)
    SELECT l_suppkey, round(any_value(m.mean), 6) AS mean, round(greatest(sum((l_quantity - m.mean) ** 2 * weight) / sum(weight), 1e-9), 6) AS variance FROM w JOIN m USING (l_suppkey) GROUP BY 1""")
def weighted_moments(spark, sf_dir):
    return state.weighted_moments(_weighted(spark, sf_dir), ["l_suppkey"], "l_quantity").select("l_suppkey", rounded("mean").alias("mean"), rounded("variance").alias("variance"))


@R.add(f"""
    WITH w AS (SELECT *, {WEIGHT} AS weight FROM lineitem),
         p AS (SELECT sum(l_extendedprice * weight) / sum(l_quantity * weight) AS prior FROM w)
    SELECT l_suppkey, count(*) AS n, round(sum(l_quantity * weight), 4) AS weighted_plays,
           round((sum(l_extendedprice * weight) + any_value(prior) * 50.0) / (sum(l_quantity * weight) + 50.0), 4) AS yards_per_play FROM w, p GROUP BY 1""")
def team_state(spark, sf_dir):
    """Yards per play of each team, recency-weighted and shrunk towards the league."""
    out = state.rates(_weighted(spark, sf_dir), ["l_suppkey"], "l_extendedprice", "l_quantity", 50.0)
    return out.select("l_suppkey", "n", F.round("den", 4).alias("weighted_plays"), F.round("rate", 4).alias("yards_per_play"))


GAME_STATS = {
    "pass_attempts": "sum(l_quantity)", "sacks": "sum(l_tax * 50)", "rush_attempts": "sum(l_linenumber * 6.0)", "pass_yards": "sum(l_quantity * (3 + l_discount * 80))",
    "rush_yards": "sum(l_linenumber * l_discount * 500)", "ints": "sum(l_discount * 10)", "targets": "sum(l_quantity * (1 - l_tax) + l_tax * 20)", "off_tds": "sum(l_extendedprice / 20000.0)"}
D_ROWS = f"""
    g AS (SELECT l_orderkey, l_suppkey, power(0.5, greatest(date_diff('day', max(l_shipdate), TIMESTAMP '1998-12-01'), 0) / 120.0) AS w, {", ".join(f"{v}::DOUBLE AS {k}" for k, v in GAME_STATS.items())} FROM lineitem GROUP BY 1, 2),
    r AS (SELECT l_orderkey, l_suppkey, w, pass_attempts IS NOT NULL AND coalesce(targets, 0) <= pass_attempts AS known, {", ".join(f"coalesce({k}, 0) AS {k}" for k in GAME_STATS)},
        coalesce(pass_attempts, 0) + coalesce(sacks, 0) AS dropbacks, coalesce(pass_attempts, 0) + coalesce(sacks, 0) + coalesce(rush_attempts, 0) AS plays FROM g),
    p AS (SELECT sum(w * plays) / sum(w) AS plays, sum(w * dropbacks) / sum(w * plays) AS pass, sum(w * sacks) / sum(w * dropbacks) AS sack, sum(w * pass_yards) / sum(w * pass_attempts) AS pya,
        sum(w * rush_yards) / sum(w * rush_attempts) AS rya, least(1, coalesce(sum(w * targets) FILTER (WHERE known) / sum(w * pass_attempts) FILTER (WHERE known), 0.92)) AS directed,
        sum(w * off_tds) / sum(w * plays) AS td, sum(w * ints) / sum(w * pass_attempts) AS ints FROM r),
    pv AS (SELECT greatest(sum(w * (r.plays - p.plays) ** 2) / sum(w), 1e-9) AS v FROM r, p),
    m AS (SELECT l_suppkey, sum(w * plays) / sum(w) AS mean FROM r GROUP BY 1),
    o AS (SELECT l_suppkey, count(*) AS games, sum(w) AS sw, any_value(mean) AS mean, greatest(sum(w * (plays - mean) ** 2) / sum(w), 1e-9) AS v, sum(w * plays) AS plays, sum(w * dropbacks) AS dropbacks,
        sum(w * sacks) AS sacks, sum(w * pass_attempts) AS pa, sum(w * rush_attempts) AS ra, sum(w * pass_yards) AS py, sum(w * rush_yards) AS ry, sum(w * off_tds) AS td,
        coalesce(sum(w * targets) FILTER (WHERE known), 0) AS dt, coalesce(sum(w * pass_attempts) FILTER (WHERE known), 0) AS da FROM r JOIN m USING (l_suppkey) GROUP BY 1),
    d AS (SELECT a.l_suppkey, sum(a.w) AS sw, sum(a.w * b.plays) AS plays, sum(a.w * b.dropbacks) AS dropbacks, sum(a.w * b.sacks) AS sacks, sum(a.w * b.pass_attempts) AS pa, sum(a.w * b.rush_attempts) AS ra,
        sum(a.w * b.pass_yards) AS py, sum(a.w * b.rush_yards) AS ry, sum(a.w * b.off_tds) AS td, sum(a.w * b.ints) AS ints FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1)"""


def _sql_rate(name: str, num: str, den: str, prior: str, low: float, high: float, strength: float = 80.0) -> str:
    return f"round(least(greatest((coalesce({num}, 0) + {strength} * p.{prior}) / (coalesce({den}, 0) + {strength}), {low}), {high}), 6) AS {name}"


@R.add(f"""
    WITH {D_ROWS}
    SELECT o.l_suppkey, round(o.sw / (o.sw + 4.0) * o.mean + (1 - o.sw / (o.sw + 4.0)) * p.plays, 4) AS plays_mean,
        round(greatest(o.sw / (o.sw + 4.0) * o.v + (1 - o.sw / (o.sw + 4.0)) * pv.v, 1.1 * greatest(o.sw / (o.sw + 4.0) * o.mean + (1 - o.sw / (o.sw + 4.0)) * p.plays, 1)), 4) AS plays_variance,
        {_sql_rate("pass_tendency", "o.dropbacks", "o.plays", "pass", 0.25, 0.80)}, {_sql_rate("sack_rate_allowed", "o.sacks", "o.dropbacks", "sack", 0.01, 0.25)},
        {_sql_rate("directed_target_rate", "o.dt", "o.da", "directed", 0.70, 1.0)}, {_sql_rate("offensive_td_rate", "o.td", "o.plays", "td", 0.005, 0.12)},
        {_sql_rate("pass_yards_per_attempt", "o.py", "o.pa", "pya", 3.0, 12.0, 60.0)}, {_sql_rate("rush_yards_per_attempt", "o.ry", "o.ra", "rya", 2.0, 8.0, 60.0)},
        round(least(greatest(coalesce((d.plays + 4.0 * p.plays) / (d.sw + 4.0), p.plays), 45), 85), 4) AS plays_allowed_mean,
        {_sql_rate("sack_rate_generated", "d.sacks", "d.dropbacks", "sack", 0.01, 0.25)}, {_sql_rate("int_rate_generated", "d.ints", "d.pa", "ints", 0.002, 0.10)},
        {_sql_rate("td_rate_allowed", "d.td", "d.plays", "td", 0.005, 0.12)}, {_sql_rate("pass_yards_per_attempt_allowed", "d.py", "d.pa", "pya", 3.0, 12.0, 60.0)},
        {_sql_rate("rush_yards_per_attempt_allowed", "d.ry", "d.ra", "rya", 2.0, 8.0, 60.0)}, o.games
    FROM o LEFT JOIN d USING (l_suppkey), p, pv""")
def team_posterior(spark, sf_dir):
    """All fields of a team's state: offence, and defence from its opponents' rows, shrunk to pooled priors and clipped."""
    games = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_shipdate").alias("played"), *[F.expr(v).cast("double").alias(k) for k, v in GAME_STATS.items()])
    out = state.team_posterior(games, "l_orderkey", "l_suppkey", F.datediff(F.lit("1998-12-01").cast("date"), F.col("played").cast("date")).cast("double"))
    places = {"plays_mean": 4, "plays_variance": 4, "plays_allowed_mean": 4}
    return out.select("l_suppkey", *[F.round(c, places.get(c, 6)).alias(c) for c in out.columns[1:-1]], "games")


@R.add(f"""
    WITH w AS (SELECT *, {WEIGHT} AS weight FROM lineitem), t AS (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1)
    SELECT l_partkey, count(*) AS n, round(sum(l_quantity / total * weight) / sum(weight), 6) AS share FROM w JOIN t USING (l_orderkey) WHERE total > 0 GROUP BY 1""")
def player_shares(spark, sf_dir):
    return state.shares(_weighted(spark, sf_dir), ["l_orderkey"], ["l_partkey"], "l_quantity").select("l_partkey", "n", rounded("share").alias("share"))


@R.add(f"""
    WITH w AS (SELECT *, {WEIGHT} AS weight FROM lineitem JOIN part ON l_partkey = p_partkey),
         g AS (SELECT p_brand, sum(l_extendedprice * weight) / sum(l_quantity * weight) AS prior FROM w GROUP BY 1)
    SELECT l_partkey, p_brand, round((sum(l_extendedprice * weight) + any_value(prior) * 20.0) / (sum(l_quantity * weight) + 20.0), 4) AS rate FROM w JOIN g USING (p_brand) GROUP BY ALL""")
def player_state(spark, sf_dir):
    """Yards per play of each player, shrunk towards the rate of the position (brand)."""
    from tidemark.functions.scoring import shrunk

    rows = _weighted(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    num, den = F.sum(F.col("l_extendedprice") * F.col("weight")), F.sum(F.col("l_quantity") * F.col("weight"))
    prior = rows.groupBy("p_brand").agg((num / den).alias("prior"))
    return rows.groupBy("l_partkey", "p_brand").agg(num.alias("num"), den.alias("den")).join(prior, "p_brand").select("l_partkey", "p_brand", F.round(shrunk(F.col("num"), F.col("den"), F.col("prior"), 20.0), 4).alias("rate"))


@R.add("""
    WITH t AS (SELECT l_orderkey, sum(l_quantity) AS total, sum(l_quantity) FILTER (WHERE l_returnflag <> 'N') AS known FROM lineitem GROUP BY 1)
    SELECT l.l_orderkey, l.l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_quantity WHEN t.total = t.known THEN 0 END AS settled FROM lineitem l JOIN t USING (l_orderkey)""")
def null_as_zero_proof(spark, sf_dir):
    """An unknown count is 0 only where the known ones add up to the team total."""
    rows = table(spark, sf_dir, "lineitem")
    known = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    totals = rows.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"), F.sum(known).alias("known"))
    return rows.join(totals, "l_orderkey").select("l_orderkey", "l_linenumber", F.coalesce(known, F.when(F.col("total") == F.col("known"), 0.0)).alias("settled"))


@R.add("""
    SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def starters(spark, sf_dir):
    """Of each game the player with the largest share, then the least depth, then the smallest id."""
    from tidemark.sources.tables import keep_one

    return keep_one(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_quantity").desc(), F.col("l_linenumber").asc(), F.col("l_partkey").asc(), F.col("l_suppkey").asc()]).select("l_orderkey", "l_partkey", "l_linenumber")


@R.add("SELECT l_partkey, arg_max(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS team FROM lineitem GROUP BY 1")
def current_team(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")).alias("team"))
