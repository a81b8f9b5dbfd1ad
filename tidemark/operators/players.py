"""The state of every player as of a time: shares, skills and roles, shrunk to what the position does.

One aggregate by team and game gives what shares are shares of, one by player and team the weighted sums of all fields
under four rates of decay; priors are a row for each position. Players whom only the roster knows get the position's
figures, by their depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scoring import decay, shrunk

#: What counts where a position has no evidence, the bounds of each field, and constants of players without a game.
SKILLS = {"catch": 0.60, "ypr": 10.5, "ypc": 4.2, "completion": 0.64, "interception": 0.022, "fg": 0.84}
TARGET_SHARE, RUSH_SHARE, QB_SHARE, EXTRA_POINT = 0.02, 0.01, 0.97, 0.95
BOUNDS = {"catch_probability": (0.05, 0.98), "receiving_yards_per_reception": (-2.0, 35.0), "rushing_yards_per_attempt": (-1.0, 12.0), "qb_completion_probability": (0.30, 0.85), "qb_int_probability": (0.002, 0.10), "fg_make_probability": (0.50, 0.99)}
NEW_TARGET_MOST, NEW_RUSH_MOST, NEW_TARGET_VARIANCE, NEW_RUSH_VARIANCE, NEW_STARTER_SHARE = 0.60, 0.85, 0.01, 0.015, 0.98
OUT = ("out", "inactive", "ir", "injured_reserve")
OTHER, QUARTERBACK = "OTHER", "QB"


@dataclass(frozen=True)
class Settings:
    """Half lives in days, and by how many opportunities a prior counts."""

    role_half_life: float = 35.0
    target_half_life: float = 35.0
    rush_half_life: float = 35.0
    skill_half_life: float = 180.0
    role_prior: float = 12.0
    target_prior: float = 12.0
    rush_prior: float = 12.0
    skill_prior: float = 35.0
    touchdown_prior: float = 8.0
    least_variance: float = 1e-4
    first: float = 1.50
    second: float = 0.75
    deeper: float = 0.35


FIELDS = ("targets", "receptions", "receiving_yards", "receiving_tds", "rush_attempts", "rushing_yards", "rushing_tds", "passing_attempts", "passing_completions", "interceptions", "fg_attempts", "fg_made")


def _known(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _bounded(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def team_games(stats: DataFrame, official: DataFrame) -> DataFrame:
    """game and team with their targets, touchdowns and carries, the age of the game, and whether the passing of its players adds up to the official figures.

    official: game, team, rush_attempts, passing_attempts, passing_completions, interceptions; a null there reconciles nothing.
    """
    passing = ("passing_attempts", "passing_completions", "interceptions")
    sums = stats.groupBy("game", "team").agg(*[F.sum(_known(c)).alias(f"_s_{c}") for c in ("targets", "receiving_tds", "rushing_tds", *passing)], F.min("age").alias("_age"))
    theirs = official.select("game", "team", F.col("rush_attempts").cast("double").alias("_t_rush_attempts"), *[F.col(c).cast("double").alias(f"_o_{c}") for c in passing])
    equal = F.lit(True)
    for c in passing:
        equal &= F.col(f"_s_{c}") == F.col(f"_o_{c}")
    rows = sums.join(theirs, ["game", "team"], "left").withColumn("_reconciled", F.coalesce(equal, F.lit(False)))
    return rows.select("game", "team", F.col("_s_targets").alias("_t_targets"), F.col("_s_receiving_tds").alias("_t_receiving_tds"), F.col("_s_rushing_tds").alias("_t_rushing_tds"), "_t_rush_attempts", F.col("_s_passing_attempts").alias("_t_passing"), "_reconciled", "_age")


def position_priors(rows: DataFrame) -> DataFrame:
    """position with its rates over all rows (passing: over reconciled games only) and its mean shares of a game; null where there is no evidence.

    A mean share of exactly 0 counts as no evidence, too.
    """
    total = lambda c, when=None: F.sum(_known(c) if when is None else F.when(when, _known(c)).otherwise(0.0))
    ok = F.col("_reconciled")
    share = lambda c, of: F.avg(F.when(F.col(of) > 0, _known(c) / F.col(of)))
    some = lambda c: F.when(c != 0, c)
    return rows.groupBy("position").agg(
        _ratio(total("receptions"), total("targets")).alias("catch"), _ratio(total("receiving_yards"), total("receptions")).alias("ypr"), _ratio(total("rushing_yards"), total("rush_attempts")).alias("ypc"),
        _ratio(total("passing_completions", ok), total("passing_attempts", ok)).alias("completion"), _ratio(total("interceptions", ok), total("passing_attempts", ok)).alias("interception"),
        _ratio(total("fg_made"), total("fg_attempts")).alias("fg"), some(share("targets", "_t_targets")).alias("target"), some(share("rush_attempts", "_t_rush_attempts")).alias("rush"),
    )


def latest_roster(roster: DataFrame) -> DataFrame:
    """player, its team and depth by the last row. roster: player, team, depth, seen; rows after the time in question must be left out."""
    last = roster.groupBy("player").agg(F.max_by(F.struct("team", "depth"), F.struct("seen", "team", F.coalesce("depth", F.lit(-1)))).alias("r"))
    return last.select("player", F.col("r.team").alias("roster_team"), F.col("r.depth").alias("depth"))


def inactive(injuries: DataFrame) -> DataFrame:
    """Players whose last status rules them out. injuries: player, status, seen."""
    last = injuries.groupBy("player").agg(F.max_by(F.lower("status"), F.struct("seen", "status")).alias("status"))
    return last.where(F.col("status").isin(*OUT)).select("player", F.lit(True).alias("_out"))


def player_states(stats: DataFrame, official: DataFrame, players: DataFrame, roster: DataFrame | None = None, injuries: DataFrame | None = None, membership: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row a player: team, position, active, depth and the fields of its state.

    stats: game, team, player, age (days before the time in question; null weighs nothing), played (order of a player's
    games, null first) and FIELDS, null counting as 0. official: see `team_games`. players: player and position. membership:
    player and team at the time; who is not in it is left out, and its team replaces the one of the last game.
    """
    s = settings
    games = team_games(stats, official)
    where = players.select("player", F.coalesce(F.nullif(F.col("position"), F.lit("")), F.lit(OTHER)).alias("position"))
    rows = stats.join(games, ["game", "team"]).join(where, "player", "left").withColumn("position", F.coalesce("position", F.lit(OTHER)))
    weigh = lambda days: F.coalesce(decay(F.col("age"), days), F.lit(0.0))
    rows = rows.withColumns({"_wt": weigh(s.target_half_life), "_wr": weigh(s.rush_half_life), "_wm": weigh(s.role_half_life), "_ws": weigh(s.skill_half_life), "_wg": F.coalesce(decay(F.col("_age"), s.role_half_life), F.lit(0.0)) * F.col("_reconciled").cast("double")})
    qb = F.col("_reconciled").cast("double")
    total = lambda c, w, name: F.sum(_known(c) * w).alias(name)
    skill = F.col("_ws")
    sums = [
        total("targets", F.col("_wt"), "targets"), total("rush_attempts", F.col("_wr"), "carries"), total("passing_attempts", F.col("_wm") * qb, "attempts"), total("_t_targets", F.col("_wt"), "t_targets"),
        total("_t_rush_attempts", F.col("_wr"), "t_carries"), total("_t_receiving_tds", F.col("_wm"), "t_rec_tds"), total("_t_rushing_tds", F.col("_wm"), "t_rush_tds"), total("receiving_tds", F.col("_wm"), "rec_tds"),
        total("rushing_tds", F.col("_wm"), "rush_tds"), total("targets", skill, "s_targets"), total("receptions", skill, "s_catches"), total("receiving_yards", skill, "s_rec_yards"), total("rush_attempts", skill, "s_carries"),
        total("rushing_yards", skill, "s_rush_yards"), total("passing_attempts", skill * qb, "s_attempts"), total("passing_completions", skill * qb, "s_completions"), total("interceptions", skill * qb, "s_ints"),
        total("fg_attempts", skill, "s_fga"), total("fg_made", skill, "s_fgm"), total("passing_attempts", F.col("_wg"), "team_attempts"),
    ]
    names = ["targets", "carries", "attempts", "t_targets", "t_carries", "t_rec_tds", "t_rush_tds", "rec_tds", "rush_tds", "s_targets", "s_catches", "s_rec_yards", "s_carries", "s_rush_yards", "s_attempts", "s_completions", "s_ints", "s_fga", "s_fgm"]
    order = F.struct("played", "game", "team")
    by_team = rows.groupBy("player", "position", "team").agg(*sums, F.max(order).alias("_last"))
    mine = F.map_from_entries(F.collect_list(F.struct("team", "team_attempts")))  # an entry for each team that the player was in
    each = by_team.groupBy("player", "position").agg(*[F.sum(c).alias(c) for c in names], F.max("_last")["team"].alias("team"), mine.alias("_mine"))
    if membership is not None:
        each = each.drop("team").join(membership.select("player", "team"), "player")
    each = each.withColumn("own_attempts", F.coalesce(F.try_element_at("_mine", "team"), F.lit(0.0))).drop("_mine")
    passes = games.groupBy("team").agg(F.sum(F.when(F.col("_reconciled"), F.coalesce(decay(F.col("_age"), s.role_half_life), F.lit(0.0)) * F.col("_t_passing")).otherwise(0.0)).alias("all_attempts"))
    each = each.join(passes, "team", "left")
    priors = position_priors(rows)
    other = priors.where(F.col("position") == OTHER).select(*[F.col(c).alias(f"_{c}") for c in SKILLS], F.lit(True).alias("_has"))

    def with_priors(df: DataFrame) -> DataFrame:
        """Skills of the position, of OTHER if no player of it has a row, or the fixed ones; shares of the position, or the fixed ones."""
        df = df.join(priors.withColumn("_own", F.lit(True)), "position", "left").join(other, F.lit(True), "left")
        skills = {c: F.coalesce(F.when(F.col("_own"), F.col(c)).otherwise(F.col(f"_{c}")), F.lit(v)) for c, v in SKILLS.items()}
        df = df.withColumns(skills | {"target": F.coalesce("target", F.lit(TARGET_SHARE)), "rush": F.coalesce("rush", F.lit(RUSH_SHARE))})
        return df.drop("_own", "_has", *[f"_{c}" for c in SKILLS])

    col = F.col
    each = with_priors(each)
    target, rush = shrunk(col("targets"), col("t_targets"), col("target"), s.target_prior), shrunk(col("carries"), col("t_carries"), col("rush"), s.rush_prior)
    variance = lambda share, n, prior: F.greatest(share * (1 - share) / F.greatest(n + prior + 1.0, F.lit(1.0)), F.lit(s.least_variance))
    rate = lambda a, b, prior: shrunk(col(a), col(b), col(prior), s.skill_prior)
    made = {
        "target_share": _bounded(target, 0.0, 1.0), "target_share_variance": variance(target, col("t_targets"), s.target_prior), "rush_share": _bounded(rush, 0.0, 1.0), "rush_share_variance": variance(rush, col("t_carries"), s.rush_prior),
        "catch_probability": rate("s_catches", "s_targets", "catch"), "receiving_yards_per_reception": rate("s_rec_yards", "s_catches", "ypr"), "rushing_yards_per_attempt": rate("s_rush_yards", "s_carries", "ypc"),
        "qb_completion_probability": rate("s_completions", "s_attempts", "completion"), "qb_int_probability": rate("s_ints", "s_attempts", "interception"),
        "qb_attempt_share": _bounded(shrunk(col("own_attempts"), F.coalesce("all_attempts", F.lit(0.0)), F.when(col("position") == QUARTERBACK, QB_SHARE).otherwise(0.0), s.role_prior), 0.0, 1.0),
        "receiving_td_share": _bounded(shrunk(col("rec_tds"), col("t_rec_tds"), col("target"), s.touchdown_prior), 0.0, 1.0), "rushing_td_share": _bounded(shrunk(col("rush_tds"), col("t_rush_tds"), col("rush"), s.touchdown_prior), 0.0, 1.0),
        "fg_make_probability": rate("s_fgm", "s_fga", "fg"), "xp_make_probability": F.lit(EXTRA_POINT), "opportunities": col("targets") + col("carries") + col("attempts"),
    }
    made |= {c: _bounded(made[c], *BOUNDS[c]) for c in BOUNDS}
    out = each.select("player", "team", "position", *[v.alias(k) for k, v in made.items()])
    latest = latest_roster(roster) if roster is not None else None
    out = out.join(latest.select("player", "depth"), "player", "left") if latest is not None else out.withColumn("depth", F.lit(None).cast("int"))
    if latest is not None:
        new = latest.join(stats.select("player").distinct(), "player", "left_anti").withColumnRenamed("roster_team", "team")
        if membership is not None:
            new = new.join(membership.select("player", "team"), ["player", "team"])
        new = with_priors(new.join(where, "player", "left").withColumn("position", F.coalesce("position", F.lit(OTHER))))
        times = F.when(col("depth") == 1, s.first).when(col("depth") == 2, s.second).otherwise(s.deeper)
        fresh = {
            "target_share": _bounded(col("target") * times, 0.0, NEW_TARGET_MOST), "target_share_variance": F.lit(NEW_TARGET_VARIANCE), "rush_share": _bounded(col("rush") * times, 0.0, NEW_RUSH_MOST), "rush_share_variance": F.lit(NEW_RUSH_VARIANCE),
            "catch_probability": col("catch"), "receiving_yards_per_reception": col("ypr"), "rushing_yards_per_attempt": col("ypc"), "qb_completion_probability": col("completion"), "qb_int_probability": col("interception"),
            "qb_attempt_share": F.when((col("position") == QUARTERBACK) & (col("depth") == 1), NEW_STARTER_SHARE).otherwise(0.0), "receiving_td_share": _bounded(col("target") * times, 0.0, 1.0), "rushing_td_share": _bounded(col("rush") * times, 0.0, 1.0),
            "fg_make_probability": col("fg"), "xp_make_probability": F.lit(EXTRA_POINT), "opportunities": F.lit(0.0),
        }
        fresh |= {c: _bounded(fresh[c], *BOUNDS[c]) for c in BOUNDS}
        out = out.unionByName(new.select("player", "team", "position", *[v.alias(k) for k, v in fresh.items()], "depth"))
    if injuries is not None:
        out = out.join(inactive(injuries), "player", "left").withColumn("active", F.col("_out").isNull()).drop("_out")
    else:
        out = out.withColumn("active", F.lit(True))
    return out
