"""Point-in-time selection: what was known at a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.sources.tables import keep_one


def known_at(df: DataFrame, cutoff: Column, clock: str = "available_at", estimated: str | None = None) -> DataFrame:
    """Rows whose clock is at or before the cutoff; with `estimated`, only those whose time is genuine (null flags count as genuine)."""
    out = df.where(F.col(clock) <= cutoff)
    return out if estimated is None else out.where(~F.coalesce(F.col(estimated), F.lit(False)))


def latest(df: DataFrame, key: list[str], cutoff: Column, clock: str, tie: str) -> DataFrame:
    """The last row of each key at or before the cutoff; equal times go to the larger tie column."""
    return keep_one(known_at(df, cutoff, clock), key, [F.col(clock).desc(), F.col(tie).desc()])


def latest_with_ties(df: DataFrame, key: list[str], cutoff: Column, clock: str) -> DataFrame:
    """All rows of each key that carry its last time at or before the cutoff."""
    place = F.rank().over(Window.partitionBy(*key).orderBy(F.col(clock).desc()))
    return known_at(df, cutoff, clock).withColumn("_place", place).where("_place = 1").drop("_place")


def first_and_last(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """First and last value of each key in the given order, and how many versions there are."""
    by = F.struct(*order)
    return df.groupBy(*key).agg(F.min_by(value, by).alias("first_value"), F.max_by(value, by).alias("last_value"), F.count("*").alias("n_versions"))


def audit(df: DataFrame, group: list[str], cutoff: Column, clock: str) -> DataFrame:
    """Rows, rows after the cutoff, and the latest time, of each group."""
    return df.groupBy(*group).agg(F.count("*").alias("n_rows"), F.count_if(F.col(clock) > cutoff).alias("n_future"), F.max(clock).alias("last_seen"))


def sole_membership(df: DataFrame, entity: str, owner: str, clock: str, cutoff: Column) -> DataFrame:
    """entity and owner as of the cutoff: of each owner's last batch the members, of each member the latest; entities that two owners claim at the same time are dropped."""
    batch = latest_with_ties(df, [owner], cutoff, clock)
    last = latest_with_ties(batch, [entity], cutoff, clock).select(entity, owner).distinct()
    return last.groupBy(entity).agg(F.count("*").alias("_n"), F.min(owner).alias(owner)).where("_n = 1").drop("_n")


def slate_boundaries(games: DataFrame, slate: list[str], kickoff: str) -> DataFrame:
    """First and last kickoff of each slate, and the boundary: midway to the first kickoff of the next slate, null for the last.

    The slates are few, whatever the number of games; they are ordered in one window after the aggregate.
    """
    by = games.groupBy(*slate).agg(F.min(kickoff).alias("first_kickoff"), F.max(kickoff).alias("last_kickoff"))
    following = F.lead("first_kickoff").over(Window.orderBy(*slate))
    middle = (F.unix_micros("last_kickoff") + F.unix_micros(following)) / 2
    return by.withColumn("boundary", F.timestamp_micros(F.floor(middle).cast("long")))


def close_of(quotes: DataFrame, kickoffs: DataFrame, game: str, key: list[str], received: str, kickoff: str, buffer: str, content: list[str]) -> DataFrame:
    """The closing quote of each key: the last received at least `buffer` before kickoff. Keys with quotes of different content at that time are ambiguous, flagged and without content."""
    at = quotes.join(kickoffs, game).where(F.col(received) <= F.col(kickoff) - F.expr(f"INTERVAL {buffer}"))
    place = F.rank().over(Window.partitionBy(*key).orderBy(F.col(received).desc()))
    last = at.withColumn("_place", place).where("_place = 1")
    one = last.groupBy(*key).agg(F.count_distinct(F.struct(*content)).alias("n_variants"), F.max(received).alias(received), F.min(F.struct(*content)).alias("_c"))
    return one.select(*key, received, "n_variants", *[F.when(F.col("n_variants") == 1, F.col(f"_c.{c}")).alias(c) for c in content])
