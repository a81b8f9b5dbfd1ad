"""Scores of probabilities and distributions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CLIP = 1e-6


def clipped(p: Column, by: float = CLIP) -> Column:
    return F.least(F.greatest(p, F.lit(by)), F.lit(1.0 - by))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, F.lit(2.0)))


def log_loss(p: Column, y: Column) -> Column:
    q = clipped(p)
    return -F.avg(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def bin_of(p: Column, bins: int = 10) -> Column:
    """Equal-width bin, the last one closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def decay(age_days: Column, half_life: float) -> Column:
    """Weight that halves each half_life days; ages below 0 count as 0."""
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / F.lit(float(half_life)))


def shrunk(numerator: Column, denominator: Column, prior: Column | float, strength: float) -> Column:
    """Ratio pulled towards a prior that counts as much as `strength` observations."""
    return (numerator + prior * F.lit(float(strength))) / (denominator + F.lit(float(strength)))


def standard_error(p: Column, n: Column) -> Column:
    """Standard error of a share p among n draws; p is clipped to 0 and 1. No draws are an error."""
    q = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return F.when(n <= 0, F.raise_error(F.lit("a standard error needs draws"))).otherwise(F.sqrt(q * (F.lit(1.0) - q) / n))


def draws_needed(p: Column, error: Column) -> Column:
    """Draws after which the standard error of p is no larger than `error`, which must be above 0."""
    q = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return F.when(error <= 0, F.raise_error(F.lit("the error asked for must be above 0"))).otherwise(F.ceil(q * (F.lit(1.0) - q) / (error * error)))


def updated(observation: Column, n: Column, prior: Column | float, k: float) -> Column:
    """Mean after n observations whose mean is `observation`: weight n / (n + k) against the prior. Without observations the prior; fewer than none are an error."""
    p = prior if isinstance(prior, Column) else F.lit(float(prior))
    weight = n / (n + F.lit(float(k)))
    return F.when(n < 0, F.raise_error(F.lit("observations must not be negative")).cast("double")).when(n == 0, p).otherwise(weight * observation + (F.lit(1.0) - weight) * p)


def carried(mean: Column, population: Column | float, keep: float) -> Column:
    """A mean on its way to the next observation: `keep` of it stays, the rest is the population's."""
    return F.lit(float(keep)) * mean + F.lit(1.0 - keep) * population


def posterior_variance(observed: Column, n: Column, prior: Column | float) -> Column:
    """Variance after n observations of variance `observed`: precisions add up. Without observations the prior."""
    p = prior if isinstance(prior, Column) else F.lit(float(prior))
    least = lambda c: F.greatest(c, F.lit(1e-12))
    return F.when(n <= 0, p).otherwise(F.lit(1.0) / (n / least(observed) + F.lit(1.0) / least(p)))


def concentration(variance: Column, base: float, scale: float) -> Column:
    """Concentration of shares: lower where the variance is larger. A negative variance is an error."""
    return F.when(variance < 0, F.raise_error(F.lit("a variance must not be negative")).cast("double")).otherwise(F.lit(float(base)) / (F.lit(1.0) + F.lit(float(scale)) * variance))
