"""Recency-weighted states of teams and players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scoring import decay, shrunk


def weighted(df: DataFrame, age_days: Column, half_life: float) -> DataFrame:
    return df.withColumn("weight", decay(age_days, half_life))


def weighted_moments(df: DataFrame, group: list[str], value: str, floor: float = 1e-9) -> DataFrame:
    """Weighted mean and population variance of each group, by two passes so that large means lose no digits."""
    mean = df.groupBy(*group).agg((F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias("mean"))
    off = df.join(mean, group).withColumn("_d", F.pow(F.col(value) - F.col("mean"), F.lit(2.0)) * F.col("weight"))
    return off.groupBy(*group).agg(F.first("mean").alias("mean"), F.greatest(F.sum("_d") / F.sum("weight"), F.lit(floor)).alias("variance"))


def moments_or_default(df: DataFrame, groups: DataFrame, group: list[str], value: str, mean: float, variance: float, floor: float = 1e-9) -> DataFrame:
    """Each row of groups (whose columns are group) with its weighted mean and variance; null values count as 0.

    A group without rows, or without weight, has the stated defaults. Deviations are taken from the group's mean, in a second pass.
    """
    rows = df.select(*group, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x"), "weight")
    keys = [f"_k{i}" for i in range(len(group))]
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)]
    weight = F.nullif(F.sum("weight"), F.lit(0.0))
    first = rows.groupBy(*group).agg((F.sum(F.col("_x") * F.col("weight")) / weight).alias("_mean")).toDF(*keys, "_mean")
    off = F.pow(F.col("_x") - F.col("_mean"), F.lit(2.0)) * F.col("weight")
    own = rows.join(first, same).groupBy(*keys).agg(F.first("_mean").alias("_mean"), F.greatest(F.sum(off) / weight, F.lit(floor)).alias("_variance"))
    given = F.col("_mean").isNotNull()
    return groups.distinct().join(own, same, "left").select(*group, F.when(given, F.col("_mean")).otherwise(F.lit(mean)).alias("mean"), F.when(given, F.col("_variance")).otherwise(F.lit(variance)).alias("variance"))


def opponents(totals: DataFrame, game: str, team: str, columns: list[str]) -> DataFrame:
    """Each team's row of a game beside that of each opponent in it, whose columns are named opp_*."""
    other = totals.select(F.col(game), F.col(team).alias("opp_team"), *[F.col(c).alias(f"opp_{c}") for c in columns])
    return totals.join(other, game).where(F.col(team) != F.col("opp_team"))


def rates(df: DataFrame, group: list[str], numerator: str, denominator: str, strength: float) -> DataFrame:
    """Weighted rate of each group, shrunk towards the rate of all rows. The prior is one row, so broadcasting it is safe."""
    num, den = F.sum(F.coalesce(F.col(numerator), F.lit(0)) * F.col("weight")), F.sum(F.coalesce(F.col(denominator), F.lit(0)) * F.col("weight"))
    prior = df.agg((num / den).alias("prior"))
    by = df.groupBy(*group).agg(num.alias("num"), den.alias("den"), F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(prior)).withColumn("rate", shrunk(F.col("num"), F.col("den"), F.col("prior"), strength))


def shares(df: DataFrame, game: list[str], player: list[str], value: str) -> DataFrame:
    """A player's share of the game total, averaged over games with the row weights; games without a total are left out."""
    total = df.groupBy(*game).agg(F.sum(value).alias("_total"))
    return df.join(total, game).where("_total > 0").groupBy(*player).agg((F.sum(F.col(value) / F.col("_total") * F.col("weight")) / F.sum("weight")).alias("share"), F.count("*").alias("n"))


def team_posterior(games: DataFrame, game: str, team: str, age_days: Column, half_life: float = 120.0, games_prior: float = 4.0, rate_prior: float = 80.0, efficiency_prior: float = 60.0, least_variance: float = 1.1) -> DataFrame:
    """The 16 fields of each team's state: the team, plays and rates of its offence, of its defence (from its opponents' rows), games.

    games: one row for each team and game, with pass_attempts, sacks, rush_attempts, pass_yards, rush_yards, ints,
    targets and off_tds; nulls count as 0. Rates are recency-weighted, shrunk to those of all rows, and clipped.
    Targets count only where they are known not to exceed the attempts. The priors are one row.
    """
    names = ["pass_attempts", "sacks", "rush_attempts", "pass_yards", "rush_yards", "ints", "targets", "off_tds"]
    known = games["pass_attempts"].isNotNull() & (F.coalesce(games["targets"], F.lit(0)) <= games["pass_attempts"])
    rows = games.select(game, team, decay(age_days, half_life).alias("w"), known.alias("known"), *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in names])
    rows = rows.withColumn("dropbacks", F.col("pass_attempts") + F.col("sacks")).withColumn("plays", F.col("dropbacks") + F.col("rush_attempts"))
    names += ["dropbacks", "plays"]

    def sums(prefix: str = "") -> list[Column]:
        return [F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(prefix + c)).alias(c) for c in names]]

    directed = [F.coalesce(F.sum(F.when(F.col("known"), F.col("w") * F.col(c))), F.lit(0.0)).alias(f"directed_{c}") for c in ("targets", "pass_attempts")]

    def rate(num: str, den: str, default: float) -> Column:
        return F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(F.lit(default))

    prior = rows.agg(*sums(), *directed).select(
        rate("plays", "w", 62.0).alias("p_plays"), rate("dropbacks", "plays", 0.58).alias("p_pass"), rate("sacks", "dropbacks", 0.065).alias("p_sack"),
        rate("pass_yards", "pass_attempts", 6.5).alias("p_pass_yards"), rate("rush_yards", "rush_attempts", 4.2).alias("p_rush_yards"),
        F.least(F.lit(1.0), rate("directed_targets", "directed_pass_attempts", 0.92)).alias("p_directed"), rate("off_tds", "plays", 0.035).alias("p_td"), rate("ints", "pass_attempts", 0.022).alias("p_int"))
    # squares about the prior's mean, so that large means lose no digits
    off = rows.crossJoin(F.broadcast(prior.select("p_plays"))).withColumn("off", F.pow(F.col("plays") - F.col("p_plays"), F.lit(2.0)) * F.col("w"))
    spread = off.agg(F.when(F.sum("w") > 0, F.greatest(F.sum("off") / F.sum("w"), F.lit(1e-9))).otherwise(F.lit(62.0 * 1.2)).alias("p_variance"))
    offence = off.groupBy(team).agg(*sums(), *directed, F.sum("off").alias("off"), F.count("*").alias("games"))
    defence = opponents(rows, game, team, names).groupBy(team).agg(*sums("opp_")).select(team, *[F.col(c).alias(f"opp_{c}") for c in ["w", *names]])
    both = offence.join(defence, team, "left").crossJoin(F.broadcast(prior)).crossJoin(F.broadcast(spread))

    def mean(plays: str, w: str) -> Column:
        return F.when(F.col(w) > 0, (F.col(plays) + F.col("p_plays") * games_prior) / (F.col(w) + games_prior)).otherwise(F.col("p_plays"))

    def pulled(num: str, den: str, to: str, low: float, high: float, strength: float = rate_prior) -> Column:
        return F.least(F.greatest(shrunk(F.coalesce(F.col(num), F.lit(0.0)), F.coalesce(F.col(den), F.lit(0.0)), F.col(to), strength), F.lit(low)), F.lit(high))

    own = F.greatest(F.col("off") / F.col("w") - F.pow(F.col("plays") / F.col("w") - F.col("p_plays"), F.lit(2.0)), F.lit(1e-9))
    variance = F.when(F.col("w") > 0, (own * F.col("w") + F.col("p_variance") * games_prior) / (F.col("w") + games_prior)).otherwise(F.col("p_variance"))
    return both.select(
        team, mean("plays", "w").alias("plays_mean"), F.greatest(variance, least_variance * F.greatest(mean("plays", "w"), F.lit(1.0))).alias("plays_variance"),
        pulled("dropbacks", "plays", "p_pass", 0.25, 0.80).alias("pass_tendency"), pulled("sacks", "dropbacks", "p_sack", 0.01, 0.25).alias("sack_rate_allowed"),
        pulled("directed_targets", "directed_pass_attempts", "p_directed", 0.70, 1.0).alias("directed_target_rate"), pulled("off_tds", "plays", "p_td", 0.005, 0.12).alias("offensive_td_rate"),
        pulled("pass_yards", "pass_attempts", "p_pass_yards", 3.0, 12.0, efficiency_prior).alias("pass_yards_per_attempt"), pulled("rush_yards", "rush_attempts", "p_rush_yards", 2.0, 8.0, efficiency_prior).alias("rush_yards_per_attempt"),
        F.least(F.greatest(mean("opp_plays", "opp_w"), F.lit(45.0)), F.lit(85.0)).alias("plays_allowed_mean"), pulled("opp_sacks", "opp_dropbacks", "p_sack", 0.01, 0.25).alias("sack_rate_generated"),
        pulled("opp_ints", "opp_pass_attempts", "p_int", 0.002, 0.10).alias("int_rate_generated"), pulled("opp_off_tds", "opp_plays", "p_td", 0.005, 0.12).alias("td_rate_allowed"),
        pulled("opp_pass_yards", "opp_pass_attempts", "p_pass_yards", 3.0, 12.0, efficiency_prior).alias("pass_yards_per_attempt_allowed"), pulled("opp_rush_yards", "opp_rush_attempts", "p_rush_yards", 2.0, 8.0, efficiency_prior).alias("rush_yards_per_attempt_allowed"), "games")
