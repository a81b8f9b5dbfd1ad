"""Odds, margins, stakes and closing line value as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def implied(american: Column) -> Column:
    """Probability that American odds imply; null for 0."""
    a = american.cast("double")
    return F.when(a < 0, -a / (100.0 - a)).when(a > 0, 100.0 / (100.0 + a))


def decimal(american: Column) -> Column:
    """Decimal odds; null for 0."""
    a = american.cast("double")
    return F.when(a < 0, 1.0 + 100.0 / -a).when(a > 0, 1.0 + a / 100.0)


def american(probability: Column) -> Column:
    """American odds of a probability between 0 and 1, else null."""
    p = probability
    return F.when((p <= 0) | (p >= 1), None).when(p >= 0.5, -100.0 * p / (1.0 - p)).otherwise(100.0 * (1.0 - p) / p)


def overround(over: Column, under: Column) -> Column:
    return implied(over) + implied(under)


def hold(over: Column, under: Column) -> Column:
    o = overround(over, under)
    return (o - 1.0) / o


def fair(over: Column, under: Column) -> Column:
    """Probability of the first side once the margin is taken out in proportion."""
    return implied(over) / overround(over, under)


def expected_value(win: Column, push: Column, price: Column) -> Column:
    """Expected profit of a unit stake at American odds; null for 0. The gain is no difference of decimal odds, which would lose its last bits."""
    a = price.cast("double")
    return F.when(a < 0, win * 100.0 / -a).when(a > 0, win * a / 100.0) - (1.0 - win - push)


def non_push(win: Column, push: Column) -> Column:
    """Winning probability given that the bet does not push; null where it surely does."""
    return F.when(push < 1.0, win / (1.0 - push))


def kelly(win: Column, push: Column, price: Column) -> Column:
    """Stake that maximises log growth, 0 where the edge is negative."""
    gain, p = decimal(price) - 1.0, non_push(win, push)
    return F.greatest(F.lit(0.0), (p * gain - (1.0 - p)) / gain)


def same_line(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-12


def implied_points(total: Column, home_spread: Column, home: Column) -> Column:
    """Points of a side from the total and the home spread."""
    return F.when(home, (total - home_spread) / 2.0).otherwise((total + home_spread) / 2.0)


def outcome(side: Column, actual: Column, line: Column) -> Column:
    """1 won, 0 lost, null for a push or an unknown result; sides OVER, UNDER and HIT (actual at least line)."""
    push = (side != "HIT") & (actual == line)
    won = F.when(side == "OVER", actual > line).when(side == "UNDER", actual < line).when(side == "HIT", actual >= line)
    return F.when(push | actual.isNull(), None).otherwise(won.cast("int"))


def profit(result: Column, price: Column) -> Column:
    """Profit of a unit stake: 0 for a null result."""
    return F.when(result == 1, decimal(price) - 1.0).when(result == 0, -1.0).otherwise(0.0)


def logit_blend(a: Column, b: Column, weight: Column | float, clip: float = 1e-6) -> Column:
    """Weighted mean of two probabilities in log odds."""
    bound = lambda p: F.least(F.greatest(p, F.lit(clip)), F.lit(1.0 - clip))
    odds = lambda p: F.log(bound(p) / (1.0 - bound(p)))
    z = odds(a) * weight + odds(b) * (F.lit(1.0) - weight)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def edge(model: Column, market: Column) -> Column:
    """By how much the model's probability exceeds the market's fair one."""
    return model - market


def win_push_fault(win: Column, push: Column) -> Column:
    """Why a pair of probabilities cannot be priced; null if it can. Nothing is clipped or repaired."""
    wild = lambda p: p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return F.when(wild(win) | wild(push), "NOT_FINITE").when((win < 0) | (push < 0), "NEGATIVE").when((win > 1) | (push > 1), "ABOVE_ONE").when(win + push > 1.0 + 1e-9, "SUM_ABOVE_ONE")


def checked_win(win: Column, push: Column) -> Column:
    """win; a pair that cannot be priced is an error."""
    fault = win_push_fault(win, push)
    return F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("win and push: "), fault))).otherwise(win)
