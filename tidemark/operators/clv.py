"""Closing line value: each bet against the close of its market, in line units, in price and in probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import odds

MISSING, SAME, MOVED, ONE_SIDED = "MISSING_AT_CLOSE", "QUOTED_SAME_LINE", "QUOTED_MOVED_LINE", "QUOTED_ONE_SIDED"


def line_units(side: Column, entry: Column, close: Column) -> Column:
    """How far the line moved in favour of the bet: up for OVER, down for UNDER; a HIT has none."""
    return F.when(side == "OVER", close - entry).when(side == "UNDER", entry - close)


def close_odds(side: Column, over: Column, under: Column, milestone: Column) -> Column:
    """Odds at the close of the side that was bet."""
    return F.when(side == "OVER", over).when(side == "UNDER", under).otherwise(milestone)


def value(entries: DataFrame, closes: DataFrame, key: list[str]) -> DataFrame:
    """entries with the fields of closing line value.

    entries: key, side (OVER, UNDER or HIT), line, odds, fair (null where it is not known). closes: key, close_line,
    close_over, close_under, close_milestone; at most one row of each key. Prices are compared only where both are of
    the same event: at the same line, or one-sided. A bet without a close has availability MISSING_AT_CLOSE and no values.
    """
    side, line = F.col("side"), F.col("line")
    rows = entries.join(closes.withColumn("_quoted", F.lit(True)), key, "left").withColumn("_quoted", F.coalesce("_quoted", F.lit(False)))
    two = side.isin("OVER", "UNDER")
    same = F.when(two, F.coalesce(odds.same_line(F.col("close_line"), line), F.lit(False))).otherwise(F.lit(True)) & F.col("_quoted")
    close = F.when(F.col("_quoted"), close_odds(side, F.col("close_over"), F.col("close_under"), F.col("close_milestone")))
    over = odds.fair(F.col("close_over"), F.col("close_under"))
    fair = F.when(F.col("_quoted") & two, F.when(side == "OVER", over).otherwise(1.0 - over))
    return rows.withColumns({"closing_odds": close, "closing_market_fair": fair, "price_clv_comparable": same}).select(
        *entries.columns,
        (~F.col("_quoted")).alias("closing_line_missing"),
        F.when(~F.col("_quoted"), MISSING).when(~two, ONE_SIDED).when(same, SAME).otherwise(MOVED).alias("close_availability"),
        F.col("close_line").alias("closing_line"), "closing_odds", "closing_market_fair", "price_clv_comparable",
        F.when(F.col("price_clv_comparable"), F.col("closing_market_fair") - F.col("fair")).alias("clv_probability"),
        F.when(F.col("price_clv_comparable"), 100.0 * (odds.decimal(F.col("odds")) - odds.decimal(F.col("closing_odds")))).alias("clv_cents"),
        F.when(F.col("_quoted"), line_units(side, line, F.col("close_line"))).alias("clv_line_units"),
    )


VALUES = ("clv_probability", "clv_cents", "clv_line_units")


def summary(rows: DataFrame, slices: list[str]) -> DataFrame:
    """Bets, bets without a close, comparable ones, and count and mean of the finite values: overall and by each slice, in one aggregate."""
    finite = {v: F.when(~F.isnan(v) & (F.abs(F.col(v)) < float("inf")), F.col(v)) for v in VALUES}
    means = [c for v in VALUES for c in (F.count(finite[v]).alias(f"n_{v}"), F.avg(finite[v]).alias(f"mean_{v}"))]
    counts = [F.count("*").alias("bets"), F.count_if("closing_line_missing").alias("n_missing"), F.count_if("price_clv_comparable").alias("n_comparable")]
    return rows.groupingSets([[], *[[F.col(s)] for s in slices]], *map(F.col, slices)).agg(F.grouping_id().alias("slice"), *counts, *means)
