"""Distributions of whole outcomes: exact PMFs, quantiles, thresholds, and weights over draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def pmf(df: DataFrame, group: list[str], outcome: str, weight: str | None = None) -> DataFrame:
    """group, outcome and p: the share of rows, or of weight, of each outcome. Only the counts are shuffled."""
    mass = F.count("*").cast("double") if weight is None else F.sum(weight)
    counts = df.groupBy(*group, outcome).agg(mass.alias("_mass"))
    return counts.withColumn("p", F.col("_mass") / F.sum("_mass").over(Window.partitionBy(*group))).drop("_mass")


def cumulative(dist: DataFrame, group: list[str], outcome: str, p: str = "p") -> DataFrame:
    rows = Window.partitionBy(*group).orderBy(outcome).rowsBetween(Window.unboundedPreceding, 0)
    return dist.withColumn("cdf", F.sum(p).over(rows))


def quantiles(dist: DataFrame, group: list[str], outcome: str, qs: list[float], p: str = "p") -> DataFrame:
    """Smallest outcome whose cumulative probability reaches q, for each q; columns q05, q50 and so on."""
    cdf = cumulative(dist, group, outcome, p)
    return cdf.groupBy(*group).agg(*[F.min(F.when(F.col("cdf") >= q - 1e-12, F.col(outcome))).alias(f"q{round(q * 100):02d}") for q in qs])


def line_probabilities(dist: DataFrame, group: list[str], outcome: str, line: Column, p: str = "p") -> DataFrame:
    """Mean of the outcome, and probability of over, under and push at the line."""
    mass = lambda test: F.sum(F.when(test, F.col(p)).otherwise(0.0))
    x = F.col(outcome)
    return dist.groupBy(*group).agg(F.sum(x * F.col(p)).alias("mean"), mass(x > line).alias("p_over"), mass(x < line).alias("p_under"), mass(x == line).alias("p_push"))


#: Ranges that the values of a group are dealt out over.
RANGES = 64


def with_range(df: DataFrame, column: str, name: str = "_part", ranges: int = RANGES) -> DataFrame:
    """df with the number of a range of about equal size, by the column (a number or a time); a null has range 0.

    The ends of the ranges are quantiles that one aggregate over df finds; they come as one row beside every row.
    """
    kind = dict(df.dtypes)[column]
    key = F.col(column).cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col(column).cast("double")
    ends = df.agg(F.array_distinct(F.coalesce(F.approx_percentile(key, [i / ranges for i in range(1, ranges)], 10 * ranges), F.array().cast("array<double>"))).alias("_ends"))
    part = F.size(F.filter("_ends", lambda end: key > end))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.coalesce(part, F.lit(0))).drop("_ends")


def past_sums(times: DataFrame, group: list[str], clock: str, sums: list[str]) -> DataFrame:
    """group, clock and the columns `sums`, each added up over the earlier times of the group. times: one row for each group and time.

    Times are dealt out by range: within a range a window adds up, and the totals of the ranges before it, of which
    there are RANGES at most, come on top.
    """
    rows = with_range(times, clock)
    inside = Window.partitionBy(*group, "_part").orderBy(clock).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*group, "_part").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if not group:
        earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = parts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_at"), *[zero(F.sum(c).over(earlier)).alias(f"_b{i}") for i, c in enumerate(sums)])
    on = F.col("_part") == F.col("_at")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    rows = rows.withColumns({f"_i{i}": zero(F.sum(c).over(inside)) for i, c in enumerate(sums)}).join(parts, on)
    return rows.select(*group, clock, *[(F.col(f"_i{i}") + F.col(f"_b{i}")).alias(c) for i, c in enumerate(sums)])


def past_last(times: DataFrame, group: list[str], clock: str, value: str) -> DataFrame:
    """group, clock and the value of the latest time of the group that has one, up to and with its own. times: one row for each group and time.

    Times are dealt out by range; ranges hand the last value of each on to those after it.
    """
    rows = with_range(times, clock)
    inside = Window.partitionBy(*group, "_part").orderBy(clock).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.where(F.col(value).isNotNull()).groupBy(*group, "_part").agg(F.max_by(value, clock).alias("_v"))
    marks = rows.select(*group, "_part").distinct().join(ends, [*group, "_part"], "left")
    before = F.last("_v", True).over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_at"), before.alias("_b"))
    on = F.col("_part") == F.col("_at")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    rows = rows.withColumn("_i", F.last(value, True).over(inside)).join(marks, on)
    return rows.select(*group, clock, F.coalesce("_i", "_b").alias(value))


def _counted(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value and n, with below: how many rows of the group have a smaller value, and all: how many it has.

    Rows are added up by value first. The values are then dealt out by group and range; a range's total of a group, of
    which there are RANGES at most, gives the offset of its values, so a group of all rows is spread over many tasks.
    """
    v = F.col(value)
    counts = with_range(df.where(v.isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n")), value)
    inside = Window.partitionBy(*group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    parts = counts.groupBy(*group, "_part").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy(*group)).alias("all"))
    on = F.col("_part") == F.col("_at")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return counts.join(parts, on).select(*group, value, "n", (F.col("_before") + F.col("_offset")).alias("below"), "all")


def _value_at(place: Column, value: str) -> Column:
    """The value of the row at a place, counted from 0 in the order of values."""
    return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col(value)))


def order_statistics(df: DataFrame, group: list[str], value: str, qs: list[float]) -> DataFrame:
    """Rows, mean, and percentiles without interpolation: the least value that a share q of the rows does not exceed."""
    each = [_value_at(F.greatest(F.ceil(F.lit(q) * F.col("all") - 1e-9) - 1, F.lit(0)), value).alias(f"p{round(q * 100):02d}") for q in qs]
    return _counted(df, group, value).groupBy(*group).agg(F.sum("n").alias("n_draws"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), *each)


def interpolated(df: DataFrame, group: list[str], value: str, qs: list[float]) -> DataFrame:
    """Rows, mean, and percentiles with linear interpolation between neighbouring rows."""
    each = []
    for q in qs:
        place = F.lit(q) * (F.col("all") - 1)
        low, part = F.floor(place + 1e-9), F.first(place - F.floor(place + 1e-9))
        a, b = _value_at(low, value), _value_at(F.least(low + 1, F.col("all") - 1), value)
        each.append((a + (b - a) * F.greatest(part, F.lit(0.0))).alias(f"p{round(q * 100):02d}"))
    return _counted(df, group, value).groupBy(*group).agg(F.sum("n").alias("n_draws"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), *each)


def thresholds(df: DataFrame, group: list[str], value: str, catalog: list[int]) -> DataFrame:
    """group, threshold and the share of rows at or above it, for all thresholds of a fixed catalog in one pass."""
    hits = df.groupBy(*group).agg(*[F.avg((F.col(value) >= t).cast("double")).alias(f"_t{t}") for t in catalog])
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_t{t}").alias("p_hit")) for t in catalog])
    return hits.select(*group, F.explode(pairs).alias("_e")).select(*group, "_e.threshold", "_e.p_hit")


def rising(grid: DataFrame, group: list[str]) -> DataFrame:
    """Rows of a threshold grid whose probability exceeds that of the threshold before; none in a sound grid."""
    before = F.lag("p_hit").over(Window.partitionBy(*group).orderBy("threshold"))
    return grid.withColumn("before", before).where("p_hit > before")


def z_scores(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Value less the group's mean over its population deviation; 0 where that is 0."""
    w = Window.partitionBy(*group)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn("z", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))


def z_scores_of(df: DataFrame, group: list[str], values: list[str], prefix: str = "z") -> DataFrame:
    """The `z_scores` of several columns, each named by the prefix and its column; they share one pass over a group."""
    w = Window.partitionBy(*group)
    return df.withColumns({prefix + c: F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(0.0) for c in values})


def softmax_weights(df: DataFrame, group: list[str], score: Column) -> DataFrame:
    """Weights that add up to 1 in each group, in proportion to exp(score)."""
    w = Window.partitionBy(*group)
    top = df.withColumn("_s", score).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    return top.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_s", "_e")


def weight_diagnostics(df: DataFrame, group: list[str]) -> DataFrame:
    """Effective sample size, largest weight and entropy of each group."""
    w = F.col("weight")
    return df.groupBy(*group).agg((F.lit(1.0) / F.sum(w * w)).alias("ess"), F.max(w).alias("max_weight"), (-F.sum(F.when(w > 0, w * F.log(w)).otherwise(0.0))).alias("entropy"))


def pmf_crps(dist: DataFrame, group: list[str], outcome: str, actual: Column) -> DataFrame:
    """Continuous ranked probability score of whole-number PMFs: squared distance of the CDF from a step, over the gaps between outcomes."""
    cdf = cumulative(dist, group, outcome)
    following = F.lead(outcome).over(Window.partitionBy(*group).orderBy(outcome))
    x, y = F.col(outcome), F.col("actual")
    rows = cdf.withColumn("_next", following).withColumn("actual", actual)
    low, high = F.col("cdf"), F.lit(1.0) - F.col("cdf")
    below = F.least(F.greatest(y, x), F.coalesce(F.col("_next"), x)) - x  # part of the gap before the actual value
    above = F.coalesce(F.col("_next"), x) - x - below
    inside = F.sum(low * low * below + high * high * above)
    outside = F.greatest(F.min(x) - F.first("actual"), F.lit(0.0)) + F.greatest(F.first("actual") - F.max(x), F.lit(0.0))
    return rows.groupBy(*group).agg((inside + outside).alias("crps"))
