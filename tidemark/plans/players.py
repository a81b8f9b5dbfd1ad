"""A player's whole state: parts are players, lines their games, orders games of two teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import players as P
from tidemark.plans.common import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
CUTOFF = "1998-06-01"
#: Fields of a line, as SQL that both engines read; q is the quantity as a whole number.
VALUES = {
    "targets": "q % 12", "receptions": "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE q % 12 * (l_linenumber % 2) END", "receiving_yards": "q * 2", "receiving_tds": "q % 3", "rush_attempts": "q % 7", "rushing_yards": "q % 7 * (l_linenumber % 5)", "rushing_tds": "l_linenumber % 2",
    "passing_attempts": "CASE WHEN p_size % 4 = 0 THEN 20 + q % 20 ELSE 0 END", "passing_completions": "CASE WHEN p_size % 4 = 0 THEN 10 + q % 15 ELSE 0 END", "interceptions": "CASE WHEN p_size % 4 = 0 THEN q % 3 ELSE 0 END", "fg_attempts": "q % 4", "fg_made": "q % 4 * (l_linenumber % 2)",
}
POSITION = "CASE p_size % 4 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' END"
#: A null here is a team without official figures, one more attempt a game that does not reconcile.
OFFICIAL = {"rush_attempts": "sum(rush_attempts) + 3", "passing_attempts": "CASE WHEN game % 11 > 0 THEN sum(passing_attempts) + CASE WHEN game % 5 = 0 THEN 1 ELSE 0 END END", "passing_completions": "sum(passing_completions)", "interceptions": "sum(interceptions)"}
TYPED = {k: f"CAST({v} AS BIGINT)" for k, v in VALUES.items()}
OFFICIAL = {k: f"CAST({v} AS BIGINT)" for k, v in OFFICIAL.items()}
OUTPUT = ["target_share", "target_share_variance", "rush_share", "rush_share_variance", "catch_probability", "receiving_yards_per_reception", "rushing_yards_per_attempt", "qb_completion_probability", "qb_int_probability", "qb_attempt_share", "receiving_td_share", "rushing_td_share", "fg_make_probability", "xp_make_probability", "opportunities"]


def _w(days: float, age: str = "age") -> str:
    return f"coalesce(power(0.5, greatest({age}, 0) / {days}), 0)"


def _s(c: str, w: str) -> str:
    return f"sum(coalesce({c}, 0) * {w})"


_C = P.Settings()
_SKILL, _QB = _w(_C.skill_half_life), "ok::INT"
_BOUND = {k: "least(greatest({}, %s), %s)" % v for k, v in P.BOUNDS.items()}  # noqa: UP031


def _shrunk(a: str, b: str, prior: str, n: float) -> str:
    return f"({a} + {prior} * {n}) / ({b} + {n})"


_RATES = {"catch_probability": ("s_catches", "s_targets", "catch"), "receiving_yards_per_reception": ("s_rec_yards", "s_catches", "ypr"), "rushing_yards_per_attempt": ("s_rush_yards", "s_carries", "ypc"), "qb_completion_probability": ("s_completions", "s_attempts", "completion"), "qb_int_probability": ("s_ints", "s_attempts", "interception"), "fg_make_probability": ("s_fgm", "s_fga", "fg")}
_TARGET, _RUSH = _shrunk("targets", "t_targets", "target", _C.target_prior), _shrunk("carries", "t_carries", "rush", _C.rush_prior)
STATES = f"""
    b AS (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 7 > 0 AND l_shipdate <= TIMESTAMP '{CUTOFF}'),
    st AS (SELECT l_orderkey AS game, l_suppkey % 2 AS team, l_partkey AS player, CASE WHEN l_linenumber < 7 THEN date_diff('day', l_shipdate::DATE, DATE '{CUTOFF}')::DOUBLE END AS age, l_shipdate AS played, {", ".join(f"{v} AS {k}" for k, v in TYPED.items())} FROM b),
    oo AS (SELECT game, team, {", ".join(f"{v} AS {k}" for k, v in OFFICIAL.items())} FROM st WHERE game % 13 > 0 GROUP BY 1, 2),
    pl AS (SELECT p_partkey AS player, coalesce({POSITION}, 'OTHER') AS position FROM part),
    sg AS (SELECT game, team, sum(coalesce(targets, 0)) AS tt, sum(coalesce(receiving_tds, 0)) AS tr, sum(coalesce(rushing_tds, 0)) AS tu, sum(coalesce(passing_attempts, 0)) AS pa, sum(coalesce(passing_completions, 0)) AS pc, sum(coalesce(interceptions, 0)) AS pi, min(age) AS ga FROM st GROUP BY 1, 2),
    tg AS (SELECT sg.*, oo.rush_attempts AS ta, coalesce(pa = oo.passing_attempts AND pc = oo.passing_completions AND pi = oo.interceptions, false) AS ok FROM sg LEFT JOIN oo USING (game, team)),
    r AS (SELECT st.*, tt, tr, tu, ta, ok, ga, position FROM st JOIN tg USING (game, team) JOIN pl USING (player)),
    pr AS (SELECT position, sum(receptions) / nullif(sum(targets), 0) AS catch, sum(receiving_yards) / nullif(sum(receptions), 0) AS ypr, sum(rushing_yards) / nullif(sum(rush_attempts), 0) AS ypc, sum(passing_completions) FILTER (WHERE ok) / nullif(sum(passing_attempts) FILTER (WHERE ok), 0) AS completion,
                  sum(interceptions) FILTER (WHERE ok) / nullif(sum(passing_attempts) FILTER (WHERE ok), 0) AS interception, sum(fg_made) / nullif(sum(fg_attempts), 0) AS fg, nullif(avg(CASE WHEN tt > 0 THEN coalesce(targets, 0) / tt END), 0) AS target, nullif(avg(CASE WHEN ta > 0 THEN coalesce(rush_attempts, 0) / ta END), 0) AS rush FROM r GROUP BY 1),
    pe AS (SELECT position, true AS has, coalesce(catch, {P.SKILLS["catch"]}) AS catch, coalesce(ypr, {P.SKILLS["ypr"]}) AS ypr, coalesce(ypc, {P.SKILLS["ypc"]}) AS ypc, coalesce(completion, {P.SKILLS["completion"]}) AS completion, coalesce(interception, {P.SKILLS["interception"]}) AS interception, coalesce(fg, {P.SKILLS["fg"]}) AS fg, coalesce(target, {P.TARGET_SHARE}) AS target, coalesce(rush, {P.RUSH_SHARE}) AS rush FROM pr),
    a AS (SELECT player, position, arg_max(team, (played, game, team)) AS team, {_s("targets", _w(_C.target_half_life))} AS targets, {_s("rush_attempts", _w(_C.rush_half_life))} AS carries, {_s("passing_attempts", f"{_w(_C.role_half_life)} * {_QB}")} AS attempts, {_s("tt", _w(_C.target_half_life))} AS t_targets, {_s("ta", _w(_C.rush_half_life))} AS t_carries,
                 {_s("tr", _w(_C.role_half_life))} AS t_rec_tds, {_s("tu", _w(_C.role_half_life))} AS t_rush_tds, {_s("receiving_tds", _w(_C.role_half_life))} AS rec_tds, {_s("rushing_tds", _w(_C.role_half_life))} AS rush_tds, {_s("targets", _SKILL)} AS s_targets, {_s("receptions", _SKILL)} AS s_catches, {_s("receiving_yards", _SKILL)} AS s_rec_yards,
                 {_s("rush_attempts", _SKILL)} AS s_carries, {_s("rushing_yards", _SKILL)} AS s_rush_yards, {_s("passing_attempts", f"{_SKILL} * {_QB}")} AS s_attempts, {_s("passing_completions", f"{_SKILL} * {_QB}")} AS s_completions, {_s("interceptions", f"{_SKILL} * {_QB}")} AS s_ints, {_s("fg_attempts", _SKILL)} AS s_fga, {_s("fg_made", _SKILL)} AS s_fgm FROM r GROUP BY 1, 2),
    ow AS (SELECT player, team, {_s("passing_attempts", f"{_w(_C.role_half_life, 'ga')} * {_QB}")} AS own FROM r GROUP BY 1, 2),
    al AS (SELECT team, sum(CASE WHEN ok THEN {_w(_C.role_half_life, "ga")} * pa ELSE 0 END) AS every FROM tg GROUP BY 1),
    ro AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN p_partkey + 10000000 ELSE p_partkey END AS player, p_partkey % 2 AS team, CASE WHEN p_size % 4 > 0 THEN p_size % 4 WHEN p_size % 8 = 0 THEN 1 END AS depth FROM part WHERE p_size % 3 > 0),
    ij AS (SELECT p_partkey AS player FROM part WHERE p_size % 13 = 0),
    full_ AS (SELECT player, team, position, ro.depth, {_TARGET} AS ts, {_RUSH} AS rs, t_targets, t_carries, {", ".join(f"{_BOUND[k].format(_shrunk(a, b, c, _C.skill_prior))} AS {k}" for k, (a, b, c) in _RATES.items())},
                  least(greatest({_shrunk("own", "coalesce(every, 0)", f"(CASE WHEN position = 'QB' THEN {P.QB_SHARE} ELSE 0 END)", _C.role_prior)}, 0), 1) AS qb_attempt_share,
                  least(greatest({_shrunk("rec_tds", "t_rec_tds", "target", _C.touchdown_prior)}, 0), 1) AS receiving_td_share, least(greatest({_shrunk("rush_tds", "t_rush_tds", "rush", _C.touchdown_prior)}, 0), 1) AS rushing_td_share, targets + carries + attempts AS opportunities
              FROM a JOIN pe USING (position) JOIN ow USING (player, team) LEFT JOIN al USING (team) LEFT JOIN (SELECT player, depth FROM ro) ro USING (player)),
    nw AS (SELECT ro.player, ro.team, coalesce(pl.position, 'OTHER') AS position, ro.depth, CASE ro.depth WHEN 1 THEN {_C.first} WHEN 2 THEN {_C.second} ELSE {_C.deeper} END AS f FROM ro LEFT JOIN pl USING (player) WHERE ro.player NOT IN (SELECT player FROM st)),
    ne AS (SELECT nw.*, coalesce(x.catch, o.catch, {P.SKILLS["catch"]}) AS catch, coalesce(x.ypr, o.ypr, {P.SKILLS["ypr"]}) AS ypr, coalesce(x.ypc, o.ypc, {P.SKILLS["ypc"]}) AS ypc, coalesce(x.completion, o.completion, {P.SKILLS["completion"]}) AS completion, coalesce(x.interception, o.interception, {P.SKILLS["interception"]}) AS interception, coalesce(x.fg, o.fg, {P.SKILLS["fg"]}) AS fg,
                  coalesce(x.target, {P.TARGET_SHARE}) AS target, coalesce(x.rush, {P.RUSH_SHARE}) AS rush FROM nw LEFT JOIN pe x ON x.position = nw.position LEFT JOIN pe o ON o.position = 'OTHER'),
    z AS (SELECT player, team, position, depth, least(greatest(ts, 0), 1) AS target_share, greatest(ts * (1 - ts) / greatest(t_targets + {_C.target_prior} + 1, 1), {_C.least_variance}) AS target_share_variance, least(greatest(rs, 0), 1) AS rush_share, greatest(rs * (1 - rs) / greatest(t_carries + {_C.rush_prior} + 1, 1), {_C.least_variance}) AS rush_share_variance,
                 {", ".join(_RATES)}, qb_attempt_share, receiving_td_share, rushing_td_share, opportunities FROM full_
          UNION ALL SELECT player, team, position, depth, least(greatest(target * f, 0), {P.NEW_TARGET_MOST}), {P.NEW_TARGET_VARIANCE}, least(greatest(rush * f, 0), {P.NEW_RUSH_MOST}), {P.NEW_RUSH_VARIANCE}, {", ".join(_BOUND[k].format(c) for k, (_, _, c) in _RATES.items())},
                 CASE WHEN position = 'QB' AND depth = 1 THEN {P.NEW_STARTER_SHARE} ELSE 0 END, least(greatest(target * f, 0), 1), least(greatest(rush * f, 0), 1), 0 FROM ne)"""


def _tables(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").where((F.col("l_partkey") % 7 > 0) & (F.col("l_shipdate") <= F.expr(f"TIMESTAMP_NTZ'{CUTOFF} 00:00:00'"))).withColumn("q", F.col("l_quantity").cast("long"))
    rows = rows.join(part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    age = F.when(F.col("l_linenumber") < 7, F.datediff(F.lit(CUTOFF).cast("date"), F.col("l_shipdate").cast("date")).cast("double"))
    stats = rows.select(F.col("l_orderkey").alias("game"), (F.col("l_suppkey") % 2).alias("team"), F.col("l_partkey").alias("player"), age.alias("age"), F.col("l_shipdate").alias("played"), *[F.expr(v).alias(k) for k, v in TYPED.items()])
    official = stats.where("game % 13 > 0").groupBy("game", "team").agg(*[F.expr(v).alias(k) for k, v in OFFICIAL.items()])
    players = part.select(F.col("p_partkey").alias("player"), F.expr(POSITION).alias("position"))
    size = F.col("p_size")
    roster = part.where(size % 3 > 0).select(F.when(F.col("p_partkey") % 10 == 0, F.col("p_partkey") + 10_000_000).otherwise(F.col("p_partkey")).alias("player"), (F.col("p_partkey") % 2).alias("team"), F.when(size % 4 > 0, size % 4).when(size % 8 == 0, 1).alias("depth"))
    # an earlier row of each player says something else
    roster = roster.select("*", F.lit(2).alias("seen")).unionByName(roster.select("player", (1 - F.col("team")).alias("team"), F.lit(9).alias("depth"), F.lit(1).alias("seen")))
    injuries = part.select(F.col("p_partkey").alias("player"), F.when(size % 13 == 0, "Out").otherwise("Questionable").alias("status"), F.lit(1).alias("seen"))
    return stats, official, players, roster, injuries


@R.add(f"WITH {STATES} SELECT player, team, position, depth, player NOT IN (SELECT player FROM ij) AS active, {', '.join(f'round({c}, 6) AS {c}' for c in OUTPUT if c != 'xp_make_probability')}, {P.EXTRA_POINT} AS xp_make_probability FROM z")
def player_states(spark, sf_dir):
    """All fields of every player with a game, and of those whom only the roster knows."""
    out = P.player_states(*_tables(spark, sf_dir))
    return out.select("player", "team", "position", "depth", "active", *[F.round(c, 6).alias(c) for c in OUTPUT])


@R.add(f"WITH {STATES} SELECT position, {', '.join(f'round({c}, 6) AS {c}' for c in [*P.SKILLS, 'target', 'rush'])} FROM pr")
def position_priors(spark, sf_dir):
    """What each position does: rates and mean shares; passing only where it reconciles."""
    stats, official, players, _, _ = _tables(spark, sf_dir)
    where = players.select("player", F.coalesce("position", F.lit(P.OTHER)).alias("position"))
    out = P.position_priors(stats.join(P.team_games(stats, official), ["game", "team"]).join(where, "player"))
    return out.select("position", *[F.round(c, 6).alias(c) for c in [*P.SKILLS, "target", "rush"]])
