"""The board of prices: which quotes have a meaning here, which may be shown, and their prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.stats import PROPS, priced

#: The kinds of markets, the props that a milestone may ask for, and the one line that it may carry.
MARKETS = ("over_under", "milestone")
HIT_PROPS = ("anytime_td", "anytime_td_1h", "anytime_td_1q", "anytime_td_2h", "first_td")
HIT_LINE = 0.5
#: How far each prop is trusted; whatever is in neither of these lists belongs to the third tier.
FIRST_TIER = ("passing_attempts", "passing_completions", "passing_yards", "interceptions", "rushing_attempts", "rushing_yards", "receptions", "receiving_yards", "rushing_receiving_yards")
SECOND_TIER = ("passing_tds", "anytime_td", "kicking_points", "fg_made", "longest_rush", "longest_reception")


def tier(prop: Column) -> Column:
    """1, 2 or 3; null for a prop that no draw can answer."""
    return F.when(prop.isin(*FIRST_TIER), 1).when(prop.isin(*SECOND_TIER), 2).when(prop.isin(*PROPS), 3)


def unsupported(market: Column, prop: Column, line: Column) -> Column:
    """Why a quote has no price here, null if it has one. A null market or prop is not known."""
    known = lambda c, values: F.coalesce(c.isin(*values), F.lit(False))
    ladder = (market == "milestone") & (~known(prop, HIT_PROPS) | F.coalesce(line != HIT_LINE, F.lit(False)))
    return F.when(~known(market, MARKETS), "UNSUPPORTED_MARKET_TYPE").when(~known(prop, PROPS), "UNSUPPORTED_PROP_TYPE").when(ladder, "UNSUPPORTED_COUNT_MILESTONE")


def supported(quotes: DataFrame) -> DataFrame:
    """quotes (market_type, prop, line and more) with reason; a milestone that has a price carries no line."""
    market = F.col("market_type")
    out = quotes.withColumn("reason", unsupported(market, F.col("prop"), F.col("line").cast("double")))
    return out.withColumn("line", F.when(F.col("reason").isNull() & (market == "milestone"), None).otherwise(F.col("line")))


def exclusion_counts(quotes: DataFrame, book: str = "vendor") -> DataFrame:
    """book, prop, market_type, reason and how many quotes of `supported` have no price for it."""
    return quotes.where("reason IS NOT NULL").groupBy(F.col(book).alias("book"), "prop", "market_type", "reason").agg(F.count("*").alias("n"))


def board(quotes: DataFrame, distributions: DataFrame, keys: list[str], cutoff: Column, received: str, most: int, universe: DataFrame | None = None) -> DataFrame:
    """Prices, one row for each side of a quote whose prop is trusted to tier `most`, with that tier and where the numbers come from.

    quotes: keys (the prop among them), market_type, line, over_odds, under_odds, hit_odds and `received`. A quote without
    odds on a side has no row for it; one of an entity outside `universe` (the keys that were drawn, without the prop) has none
    at all. distributions: keys, outcome, p. A quote from after the cutoff is an error, as in `priced`.
    """
    rows = supported(quotes).where("reason IS NULL").drop("reason").withColumn("tier", tier(F.col("prop"))).where(F.col("tier") <= most)
    if universe is not None:
        rows = rows.join(universe.distinct(), universe.columns, "left_semi")
    hit = F.col("market_type") == "milestone"
    side = lambda name, odds, when: F.struct(F.lit(name).alias("side"), F.when(when, F.col(odds)).cast("double").alias("odds"))
    sides = rows.select("*", F.inline(F.array(side("OVER", "over_odds", ~hit), side("UNDER", "under_odds", ~hit), side("HIT", "hit_odds", hit)))).where("odds IS NOT NULL")
    # the event of a milestone is one or more
    asked = sides.withColumn("_line", F.col("line")).withColumn("line", F.when(F.col("side") == "HIT", 1.0).otherwise(F.col("line").cast("double")))
    out = priced(asked.where("line IS NOT NULL"), distributions, keys, cutoff, received)
    return out.withColumn("line", F.col("_line")).drop("_line", "over_odds", "under_odds", "hit_odds").withColumns({"as_of": cutoff, "quote_age_seconds": F.unix_seconds(F.to_timestamp(cutoff)) - F.unix_seconds(F.to_timestamp(F.col(received)))})
