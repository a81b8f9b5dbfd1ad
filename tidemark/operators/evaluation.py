"""Evaluation of forecasts and bets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scoring import bin_of, brier, clipped, log_loss
from tidemark.operators.distributions import _counted, with_range


def benchmark(df: DataFrame, slices: list[str], model: str = "p", market: str = "q", outcome: str = "y") -> DataFrame:
    """Rows, Brier score and log loss of model and market over all rows and by each slice, in one aggregate over grouping sets."""
    p, q, y = F.col(model), F.col(market), F.col(outcome)
    fine = df.where(p.isNotNull() & q.isNotNull() & y.isNotNull() & ~F.isnan(p) & ~F.isnan(q))
    sets = [[], *[[F.col(s)] for s in slices]]
    out = fine.groupingSets(sets, *map(F.col, slices)).agg(F.grouping_id().alias("slice"), F.count("*").alias("n"), brier(p, y).alias("brier_model"), brier(q, y).alias("brier_market"), log_loss(p, y).alias("log_loss_model"), log_loss(q, y).alias("log_loss_market"))
    return out


def reliability(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Rows, mean probability and observed rate of each bin."""
    return df.groupBy(bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def calibration_error(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Mean gap between clipped probability and rate over the bins, weighted by rows."""
    r = reliability(df.withColumn(p, clipped(F.col(p))), p, y, bins)
    return r.agg((F.sum(F.abs(F.col("mean_p") - F.col("rate")) * F.col("n")) / F.sum("n")).alias("ece"))


def calibration_errors(df: DataFrame, slices: list[str], model: str = "p", market: str = "q", outcome: str = "y", bins: int = 10) -> DataFrame:
    """ece_model and ece_market over all rows and by each slice (with the slice number of `benchmark`), in two aggregates."""
    each = F.array(*[F.struct(F.lit(n).alias("_name"), clipped(F.col(c)).alias("_p")) for n, c in (("model", model), ("market", market))])
    rows = df.where(F.col(model).isNotNull() & F.col(market).isNotNull() & F.col(outcome).isNotNull()).select(*slices, F.col(outcome).alias("_y"), F.inline(each))
    rows = rows.withColumn("_bin", bin_of(F.col("_p"), bins))
    sets = [[F.col("_name"), F.col("_bin")], *[[F.col(s), F.col("_name"), F.col("_bin")] for s in slices]]
    binned = rows.groupingSets(sets, *map(F.col, slices), F.col("_name"), F.col("_bin")).agg(F.shiftright(F.grouping_id(), 2).alias("slice"), F.count("*").alias("_n"), F.abs(F.sum("_p") - F.sum("_y")).alias("_gap"))
    ece = lambda name: (F.sum(F.when(F.col("_name") == name, F.col("_gap"))) / F.sum(F.when(F.col("_name") == name, F.col("_n")))).alias(f"ece_{name}")
    return binned.groupBy("slice", *slices).agg(ece("model"), ece("market"))


def full_benchmark(df: DataFrame, slices: list[str], model: str = "p", market: str = "q", outcome: str = "y") -> DataFrame:
    """`benchmark` with ece_model and ece_market; slices are few rows, joined null-safely."""
    left, right = benchmark(df, slices, model, market, outcome), calibration_errors(df, slices, model, market, outcome)
    on = left["slice"] == right["slice"]
    for s in slices:
        on &= left[s].eqNullSafe(right[s])
    return left.join(right, on).select(*[left[c] for c in left.columns], "ece_model", "ece_market")


def sample_crps(df: DataFrame, group: list[str], value: str, actual: str) -> DataFrame:
    """CRPS of a sample against the group's actual value, by the sorted-sample identity over counted values."""
    counted = _counted(df, group, value)
    n, below, every, x = (F.col(c) for c in ("n", "below", "all", value))
    # places below + 1 to below + n share a value: the sum of 2 i - all - 1 over them
    spread = counted.groupBy(*group).agg((F.sum(x * n * (2 * below + n - every).cast("double")) / F.first(every) / F.first(every)).alias("_k"))
    error = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.avg(F.abs(F.col(value) - F.col(actual))).alias("_e"))
    return error.join(spread, group).select(*group, (F.col("_e") - F.col("_k")).alias("crps"))


def uniformity(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Largest distance of the group's empirical distribution from the uniform one, over counted values."""
    n, below, every, x = (F.col(c) for c in ("n", "below", "all", value))
    return _counted(df, group, value).groupBy(*group).agg(F.max(F.greatest((below + n) / every - x, x - below / every)).alias("ks"))


def drawdown(df: DataFrame, group: list[str], order: list[str], profit: str) -> DataFrame:
    """Bets, profit and the largest fall of the running profit from its peak (0 at the start).

    Rows are dealt out by group and range of the first column of order. Within a range, and then over the ranges of a
    group, a stretch is told by its profit, its highest and lowest running profit and its largest fall; so a group of
    all rows is spread over many tasks.
    """
    rows = with_range(df, order[0])
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum(profit).over(inside)).withColumn("_top", F.max("_run").over(inside))
    parts = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.sum(profit).alias("_sum"), F.max("_run").alias("_high"), F.min("_run").alias("_low"), F.max(F.col("_top") - F.col("_run")).alias("_fall"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
    parts = parts.withColumn("_peak", F.greatest(F.max(F.col("_base") + F.col("_high")).over(earlier), F.lit(0.0)))
    fall = F.greatest(F.col("_fall"), F.col("_peak") - F.col("_base") - F.col("_low"))
    return parts.groupBy(*group).agg(F.sum("_n").alias("bets"), F.sum("_sum").alias("profit"), F.greatest(F.max(fall), F.lit(0.0)).alias("max_drawdown"))
