"""Reports over bets and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Nominal levels of the central intervals that the interval score uses.
LEVELS = (0.5, 0.8, 0.9)


def line_value_summary(df: DataFrame, slices: list[str], value: str) -> DataFrame:
    """Bets, bets with a close, mean and share of positive closing line value: overall and by each slice, in one aggregate."""
    sets = [[], *[[F.col(s)] for s in slices]]
    v = F.col(value)
    return df.groupingSets(sets, *map(F.col, slices)).agg(F.grouping_id().alias("slice"), F.count("*").alias("bets"), F.count(v).alias("with_close"), F.avg(v).alias("mean_value"), F.avg((v > 0).cast("double")).alias("share_positive"))


def trading(df: DataFrame, group: list[str], order: list[str], profit: str, expected: str) -> DataFrame:
    """Bets, expected and realised profit, return on stakes of one, and the share of bets won."""
    p = F.col(profit)
    return df.groupBy(*group).agg(F.count("*").alias("bets"), F.sum(expected).alias("expected"), F.sum(p).alias("profit"), F.avg(p).alias("roi"), F.avg((p > 0).cast("double")).alias("hit_rate"))


def interval_scores(df: DataFrame, group: list[str], actual: Column, quantile: dict[float, Column]) -> DataFrame:
    """Absolute error of the median, weighted interval score over LEVELS, and the coverage of each interval. quantile: columns by probability."""
    median = quantile[0.5]
    score, covers = F.lit(0.5) * F.abs(actual - median), []
    for level in LEVELS:
        a = 1 - level
        low, high = quantile[round(a / 2, 4)], quantile[round(1 - a / 2, 4)]
        width = (high - low) + F.greatest(low - actual, F.lit(0.0)) * (2 / a) + F.greatest(actual - high, F.lit(0.0)) * (2 / a)
        score = score + F.lit(a / 2) * width
        covers.append(F.avg(((actual >= low) & (actual <= high)).cast("double")).alias(f"cover{round(level * 100)}"))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.avg(F.abs(actual - median)).alias("mae"), F.avg(score / F.lit(len(LEVELS) + 0.5)).alias("wis"), *covers)


def first_scorer(df: DataFrame, draw: list[str], scorer: str, order: Column, scored: Column, weight: str | None = None) -> DataFrame:
    """scorer (null for none) and the share of draws, or of their weight, in which it scores first."""
    mass = F.lit(1.0) if weight is None else F.first(weight)
    first = df.groupBy(*draw).agg(F.min_by(F.when(scored, F.col(scorer)), F.when(scored, order)).alias(scorer), mass.alias("_w"))
    total = first.agg(F.sum("_w").alias("_all"))
    return first.groupBy(scorer).agg(F.sum("_w").alias("_w")).crossJoin(F.broadcast(total)).select(scorer, (F.col("_w") / F.col("_all")).alias("p"))


def prior_games(df: DataFrame, entity: str, slate: str, final: Column) -> DataFrame:
    """df with n_prior: the entity's final games in slates strictly before the row's. Slates are whole numbers."""
    past = Window.partitionBy(entity).orderBy(slate).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("n_prior", F.count(F.when(final, 1)).over(past))


def feed_status(checks: DataFrame, required: DataFrame, feed: str, clock: str, cutoff: Column, good: Column) -> DataFrame:
    """Required feeds with their last good check at or before the cutoff; null where there is none."""
    last = checks.where(F.col(clock) <= cutoff).where(good).groupBy(feed).agg(F.max(clock).alias("last_good"))
    return required.select(feed).distinct().join(last, feed, "left")


def settle_by_rules(df: DataFrame, rules: DataFrame, prop: str, vendor: str) -> DataFrame:
    """df with rule: the vendor's rule for the prop, else the default one (null vendor). rules (prop, vendor, rule) is a small table of settings."""
    special = F.broadcast(rules.where("vendor IS NOT NULL").select(F.col("prop").alias("_p"), F.col("vendor").alias("_v"), F.col("rule").alias("_special")))
    default = F.broadcast(rules.where("vendor IS NULL").select(F.col("prop").alias("_q"), F.col("rule").alias("_default")))
    out = df.join(special, (F.col(prop) == F.col("_p")) & (F.col(vendor) == F.col("_v")), "left").join(default, F.col(prop) == F.col("_q"), "left")
    return out.withColumn("rule", F.coalesce("_special", "_default")).drop("_p", "_v", "_q", "_special", "_default")
