"""The evaluation report of a backtest as one table of section, slice, metric and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.distributions import interpolated
from tidemark.operators.evaluation import drawdown, full_benchmark, reliability, uniformity
from tidemark.operators.quality import duplicate_keys, require_empty
from tidemark.operators.shards import interval_score

#: Columns that a row of a backtest must have; the others make parts of the report when they are there.
NEEDED = ("prop_type", "season", "week", "p", "q", "y", "actual")
LEVELS = {"coverage_50": ("p25", "p75"), "coverage_80": ("p10", "p90"), "coverage_90": ("p05", "p95")}


def finite(column: str) -> Column:
    """The value as a double, null where it is null, NaN or infinite."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _long(df: DataFrame, section: Column, slice_: Column, metrics: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(section.alias("section"), slice_.cast("string").alias("slice"), F.inline(each))


def checked(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """rows, once read: a missing column, a probability that is null or outside 0 and 1, or an outcome other than 0 and 1 is an error, and so is a row that repeats the key."""
    if lacking := [c for c in NEEDED if c not in rows.columns]:
        raise ValueError(f"rows of a backtest lack {', '.join(lacking)}")
    if key:
        require_empty(duplicate_keys(rows, key), "rows of a backtest repeat a key")
    fine = F.col("p").between(0, 1) & F.col("q").between(0, 1) & F.col("y").isin(0, 1)
    return rows.withColumn("p", F.when(F.coalesce(fine, F.lit(False)), F.col("p")).otherwise(F.raise_error(F.lit("a probability or outcome is out of range")).cast("double")))


def benchmarks(rows: DataFrame) -> DataFrame:
    """Model against market: over all rows, by prop, by season, in weeks 1 to 4, and from week 14 on; from one set of grouping sets."""
    band = F.when(F.col("week").between(1, 4), "early_weeks").when(F.col("week") >= 14, "late_weeks")
    named = rows.select(F.col("prop_type").cast("string").alias("by_prop_type"), F.col("season").cast("string").alias("by_season"), band.alias("band"), "p", "q", "y")
    out = full_benchmark(named, ["by_prop_type", "by_season", "band"])
    which = F.col("slice")  # bits of the columns that a grouping set leaves out
    out = out.where((which != 6) | F.col("band").isNotNull())
    section = F.when(which == 7, "aggregate").when(which == 3, "by_prop_type").when(which == 5, "by_season").otherwise(F.col("band"))
    name = F.when(which == 3, F.coalesce("by_prop_type", F.lit("unknown"))).when(which == 5, F.coalesce("by_season", F.lit("unknown"))).otherwise("all")
    return _long(out, section, name, ["n", "brier_model", "brier_market", "log_loss_model", "log_loss_market", "ece_model", "ece_market"])


def distributional(rows: DataFrame) -> DataFrame:
    """Errors of the mean, CRPS, interval scores with their coverage, and the distance of PITs from uniform; of rows with a known actual value.

    A figure whose columns are not there, or without any finite value, is null. The median is exact, over counted values by range.
    """
    has = lambda *names: set(names) <= set(rows.columns)
    quantiles = ("p05", "p10", "p25", "p50", "p75", "p90", "p95")
    known = rows.withColumn("actual", finite("actual"))
    for c in ("model_mean", "crps", "pit", *quantiles):
        if has(c):
            known = known.withColumn(c, finite(c))
    y, none = F.col("actual"), F.lit(None).cast("double")
    error = F.abs(F.col("model_mean") - y) if has("model_mean") else none
    wis, covers = none, dict.fromkeys(LEVELS, none)
    if has(*quantiles):
        wis = interval_score(y)
        whole = wis.isNotNull()
        covers = {name: F.when(whole, y.between(F.col(a), F.col(b)).cast("double")) for name, (a, b) in LEVELS.items()}
    known = known.withColumns({"_error": error, "_all": F.lit(1)})
    out = known.agg(F.count("actual").alias("n"), F.avg("_error").alias("mae"), F.avg(F.col("crps") if has("crps") else none).alias("mean_crps"), F.avg(wis).alias("mean_wis"), *[F.avg(c).alias(n) for n, c in covers.items()])
    single = [interpolated(known.where("_error IS NOT NULL"), ["_all"], "_error", [0.5]).select(F.col("p50").alias("value"), F.lit("median_ae").alias("metric"))]
    if has("pit"):
        single.append(uniformity(known.where("pit IS NOT NULL"), ["_all"], "pit").select(F.col("ks").alias("value"), F.lit("pit_ks").alias("metric")))
    parts = _long(out, F.lit("distributional"), F.lit("all"), ["n", "mae", "mean_crps", "mean_wis", *LEVELS])
    for s in single:
        parts = parts.unionByName(s.select(F.lit("distributional").alias("section"), F.lit("all").alias("slice"), "metric", F.col("value").cast("double").alias("value")))
    return parts


def trading(rows: DataFrame, order: list[str]) -> DataFrame:
    """Selected bets: their number, mean expected value, return, drawdown, and closing value over those only that have a close.

    Return and drawdown are null if any profit is not finite. order decides which bet comes first, without ties.
    """
    value, profit = finite("ev"), finite("profit")
    bets = rows.where(F.coalesce(F.col("selected"), F.lit(False)))
    close = F.when(F.col("close_available").isNull(), F.raise_error(F.lit("a bet does not say whether it has a close"))).otherwise(F.col("close_available"))
    at_close = lambda c: F.when(close, finite(c))
    whole = F.count(profit) == F.count("*")
    out = bets.agg(
        F.count("*").alias("bets"), F.avg(value).alias("mean_ev"), F.when(whole, F.avg(profit)).alias("roi"), F.count_if(close).alias("close_available"), F.count_if(~close).alias("close_missing"),
        F.count(at_close("clv_probability")).alias("n_clv_probability"), F.avg(at_close("clv_probability")).alias("mean_clv_probability"), F.count(at_close("clv_cents")).alias("n_clv_cents"), F.avg(at_close("clv_cents")).alias("mean_clv_cents"), F.max(~profit.isNotNull()).alias("_broken"),
    )
    runs = bets.select(*order, F.lit(1).alias("_all"), F.coalesce(profit, F.lit(0.0)).alias("_profit"))
    fall = drawdown(runs, ["_all"], order, "_profit").select("max_drawdown")
    out = out.join(F.broadcast(fall), F.lit(True), "left").withColumn("max_drawdown", F.when(~F.coalesce(F.col("_broken"), F.lit(False)), F.coalesce("max_drawdown", F.lit(0.0))))
    names = ["bets", "mean_ev", "roi", "max_drawdown", "close_available", "close_missing", "n_clv_probability", "mean_clv_probability", "n_clv_cents", "mean_clv_cents"]
    return _long(out, F.lit("trading"), F.lit("all"), names)


def report(rows: DataFrame, order: list[str], exclusions: DataFrame | None = None, bins: int = 10, key: list[str] | None = None) -> DataFrame:
    """section, slice, metric, value: benchmarks, reliability by bin, distributions, trading (if rows say what was selected) and exclusions by reason.

    rows: NEEDED, and for the other parts model_mean, crps, pit, quantiles p05 to p95; selected, ev, profit, close_available,
    clv_probability, clv_cents. Without rows the counts are 0 and the rest is null; bins and slices that hold nothing are not there.
    """
    rows = checked(rows, key)
    parts = [benchmarks(rows), _long(reliability(rows, bins=bins), F.lit("reliability"), F.col("bin"), ["n", "mean_p", "rate"]), distributional(rows)]
    if "selected" in rows.columns:
        parts.append(trading(rows, order))
    if exclusions is not None:
        if "reason" not in exclusions.columns:
            raise ValueError("exclusions lack their reason")
        reasons = exclusions.groupBy("reason").agg(F.count("*").alias("n"))
        parts.append(_long(reasons, F.lit("exclusions"), F.coalesce("reason", F.lit("unknown")), ["n"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
