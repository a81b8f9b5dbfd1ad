"""Statistics of draws, their distributions, the products made of them, and settlement against what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import odds
from tidemark.operators.quality import require_empty

#: The statistics that draws have as columns. Parts of a game are columns too, such as q1_passing_yards; q5 is overtime.
NATIVE = ("targets", "receptions", "receiving_yards", "receiving_tds", "longest_reception", "rush_attempts", "rushing_yards", "rushing_tds", "longest_rush", "passing_attempts",
    "passing_completions", "passing_yards", "passing_tds", "interceptions", "longest_pass", "fg_attempts", "fg_made", "xp_made", "kicking_points", "rushing_receiving_yards")
#: Statistics made of others, the ones read as 0 or 1, and the ones that only the catalog of thresholds knows.
HALVES = ("passing_yards", "passing_tds", "receiving_yards", "rushing_yards", "fg_made")
BINARY = ("anytime_td", "anytime_td_1q", "anytime_td_1h", "anytime_td_2h")
DERIVED = ("anytime_td", *(f"{s}_1h" for s in HALVES), "anytime_td_1q", "anytime_td_1h", "anytime_td_2h", "first_td")
CATALOG_STATS = ("offensive_tds",)
#: Kinds of props that are bet on and are a column or a derived statistic under their own name; one has another.
PROPS = ("passing_attempts", "passing_completions", "passing_yards", "passing_tds", "interceptions", "rushing_attempts", "rushing_yards", "receptions", "receiving_yards", "rushing_receiving_yards",
    "longest_pass", "longest_reception", "longest_rush", "fg_made", "kicking_points", *DERIVED)
RENAMED = {"rushing_attempts": "rush_attempts"}
#: The thresholds of each statistic's events, "at least so many": 131 in all.
LADDERS = {
    "passing_yards": [150, 175, 200, 225, 250, 275, 300, 325, 350, 400],
    "passing_completions": [15, 18, 20, 22, 25, 28, 30],
    "passing_attempts": [25, 30, 35, 40, 45, 50],
    "rushing_yards": [25, 40, 50, 60, 75, 90, 100, 125, 150],
    "rush_attempts": [5, 8, 10, 12, 15, 18, 20, 25],
    "receiving_yards": [20, 30, 40, 50, 60, 75, 90, 100, 125, 150],
    "receptions": [2, 3, 4, 5, 6, 7, 8, 10],
    "targets": [3, 5, 7, 9, 11],
    "longest_reception": [15, 20, 25, 30, 40, 50],
    "longest_rush": [10, 15, 20, 30, 40],
    "longest_pass": [20, 30, 40, 50, 60],
    "rushing_receiving_yards": [40, 50, 60, 75, 90, 100, 125, 150],
    "kicking_points": [4, 6, 7, 8, 10, 12],
    "passing_yards_1h": [75, 100, 125, 150, 175, 200],
    "receiving_yards_1h": [15, 25, 40, 50, 60, 75],
    "rushing_yards_1h": [15, 25, 40, 50, 60, 75],
    "passing_tds": [1, 2, 3, 4],
    "interceptions": [1, 2, 3],
    "fg_made": [1, 2, 3, 4],
    "fg_attempts": [1, 2, 3],
    "offensive_tds": [2, 3],
    "passing_tds_1h": [1, 2],
    "fg_made_1h": [1, 2],
}
MILESTONES = ("passing_tds", "interceptions", "fg_made", "fg_attempts", "offensive_tds", "passing_tds_1h", "fg_made_1h")
EVENTS = 131


def touchdowns(quarters: str) -> str:
    return " + ".join(f"q{q}_receiving_tds + q{q}_rushing_tds" for q in quarters)


def formula(stat: str, overtime: bool = True) -> str:
    """The value of a statistic or prop from the columns of one draw, as SQL that Spark and others read. overtime: whether second halves count it."""
    stat = RENAMED.get(stat, stat)
    if stat in NATIVE or stat == "first_td":
        return stat
    if stat in ("anytime_td", "offensive_tds"):
        return "receiving_tds + rushing_tds"
    if stat.removesuffix("_1h") in HALVES:
        return f"q1_{stat.removesuffix('_1h')} + q2_{stat.removesuffix('_1h')}"
    quarters = {"anytime_td_1q": "1", "anytime_td_1h": "12", "anytime_td_2h": "345" if overtime else "34"}
    if stat not in quarters:
        raise ValueError(f"unknown statistic: {stat}")
    return touchdowns(quarters[stat])


def extractor(stat: str, overtime: bool = True) -> Column:
    """The value of a statistic in one draw; binary ones are 1 from one on."""
    value = F.expr(formula(stat, overtime)).cast("long")
    return (value >= 1).cast("long") if stat in BINARY else value


def long_form(draws: DataFrame, keys: list[str], stats: list[str], overtime: bool = True) -> DataFrame:
    """One row of stat and value for each draw and statistic; a null value is left out."""
    each = F.array(*[F.struct(F.lit(s).alias("stat"), extractor(s, overtime).alias("value")) for s in stats])
    return draws.select(*keys, F.inline(each)).where("value IS NOT NULL")


def first_draws(draws: DataFrame, draw: str, keep: int) -> DataFrame:
    """The draws numbered below keep."""
    return draws.where(F.col(draw) < keep)


def pmf(rows: DataFrame, keys: list[str], value: str = "value", weight: Column | None = None) -> DataFrame:
    """keys, outcome and p: the share of rows, or of their weight."""
    mass = F.lit(1.0) if weight is None else weight
    counted = rows.groupBy(*keys, F.col(value).alias("outcome")).agg(F.sum(mass).alias("_w"))
    total = counted.groupBy(*keys).agg(F.sum("_w").alias("_all"))
    return counted.join(total, keys).select(*keys, "outcome", (F.col("_w") / F.col("_all")).alias("p"))


#: A key with more draws than this is spread over tasks; others are dealt out whole.
MANY_DRAWS = 100_000


def stat_pmf(draws: DataFrame, keys: list[str], stats: list[str], many: int = MANY_DRAWS) -> DataFrame:
    """keys, stat, outcome and p of statistics of draws: what `pmf` makes of `long_form`.

    Draws themselves go to the task of their key, as narrow rows, and are turned into rows of statistics and counted there.
    A key with more than `many` draws, of which there are few, is added up by outcome first.
    """
    wide = draws.select(*keys, *[extractor(s).alias(f"_s{i}") for i, s in enumerate(stats)])
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"_s{i}").alias("outcome")) for i, s in enumerate(stats)]))
    long = F.broadcast(draws.groupBy(*keys).count().where(F.col("count") > many).select(*keys))
    of = Window.partitionBy(*keys, "stat")

    def counted(rows: DataFrame) -> DataFrame:
        counts = rows.select(*keys, each).where("outcome IS NOT NULL").groupBy(*keys, "stat", "outcome").agg(F.count("*").cast("double").alias("_n"))
        return counts.select(*keys, "stat", "outcome", (F.col("_n") / F.sum("_n").over(of)).alias("p"))

    return counted(wide.join(long, keys, "left_anti").repartition(*keys)).unionByName(counted(wide.join(long, keys, "left_semi")))


def packed(table: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each distribution: pmf, an array of (outcome, p) in order. Outcomes of one distribution are few, whatever the rows behind them."""
    return table.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("outcome", "p"))).alias("pmf"))


def faults(pmf_: Column, close: float = 1e-9) -> Column:
    """Why an array of (outcome, p) is no distribution: EMPTY, ORDER, MASS or SUM; null if it is one."""
    following = F.slice(pmf_, F.lit(2), F.greatest(F.size(pmf_) - 1, F.lit(0)))
    rising = F.forall(F.zip_with(F.slice(pmf_, F.lit(1), F.greatest(F.size(pmf_) - 1, F.lit(0))), following, lambda a, b: a["outcome"] < b["outcome"]), lambda x: x)
    total = F.aggregate(pmf_, F.lit(0.0), lambda s, x: s + x["p"])
    return F.when(F.coalesce(F.size(pmf_), F.lit(0)) < 1, "EMPTY").when(~rising, "ORDER").when(F.exists(pmf_, lambda x: ~(x["p"] > 0)), "MASS").when(F.abs(total - 1.0) > close, "SUM")


def unpacked(table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that `packed` was given; a distribution with a fault is an error."""
    bad = faults(F.col("pmf"))
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("not a distribution: "), bad))).otherwise(F.col("pmf"))
    return table.select(*keys, F.inline(checked))


def weighted_quantile(table: DataFrame, keys: list[str], q: float) -> DataFrame:
    """keys and the least outcome at which the cumulative probability reaches q. table: keys, outcome, p, few rows a key."""
    w = Window.partitionBy(*keys).orderBy("outcome").rowsBetween(Window.unboundedPreceding, 0)
    reached = table.withColumn("_c", F.sum("p").over(w)).where(F.col("_c") >= F.lit(q) - 1e-12)
    return reached.groupBy(*keys).agg(F.min("outcome").alias("quantile"))


def props(draws: DataFrame, keys: list[str], overtime: bool = True) -> DataFrame:
    """One row of prop and value for each draw and each of the 25 kinds of props; touchdown props count touchdowns."""
    each = F.array(*[F.struct(F.lit(p).alias("prop"), F.expr(formula(p, overtime)).cast("long").alias("value")) for p in PROPS])
    return draws.select(*keys, F.inline(each)).where("value IS NOT NULL")


def projections(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Draws, mean, standard deviation and share of draws above 0 of each statistic. rows: keys and value."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_draws"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.avg((F.col("value") > 0).cast("double")).alias("p_positive"))


def eligible(players: DataFrame, team: list[str], player: str, active: str, share: str, position: str, depth: str) -> DataFrame:
    """Active players with a share, and of each team the quarterback (largest share, then least depth) and the kicker (least depth); ties go to the smaller id."""
    w = Window.partitionBy(*team, position)
    rows = players.where(F.col(active))
    quarterback = F.row_number().over(w.orderBy(F.col(share).desc(), F.col(depth).asc_nulls_last(), player))
    kicker = F.row_number().over(w.orderBy(F.col(depth).asc_nulls_last(), player))
    rows = rows.withColumns({"_q": quarterback, "_k": kicker})
    chosen = ((F.col(position) == "QB") & (F.col("_q") == 1)) | ((F.col(position) == "K") & (F.col("_k") == 1))
    return rows.withColumn("starter", F.coalesce(chosen, F.lit(False))).where((F.col(share) > 0) | F.col("starter")).drop("_q", "_k")


def catalog(spark: SparkSession, ladders: dict[str, list[int]] | None = None, events: int | None = EVENTS) -> DataFrame:
    """stat, threshold and classification of every event, checked: known statistics, positive thresholds, each ladder rising, as many events as stated."""
    ladders = LADDERS if ladders is None else ladders
    for stat, ladder in ladders.items():
        extractor(stat)
        if not ladder or ladder[0] < 1 or any(a >= b for a, b in zip(ladder, ladder[1:], strict=False)):
            raise ValueError(f"thresholds of {stat} must be positive and rise")
    rows = [(s, t, "MILESTONE_ONLY" if s in MILESTONES else "STANDARD_THRESHOLD_ELIGIBLE") for s, ladder in sorted(ladders.items()) for t in ladder]
    if events is not None and len(rows) != events:
        raise ValueError(f"{len(rows)} events, not {events}")
    return spark.createDataFrame(rows, "stat string, threshold long, classification string")


def threshold_product(table: DataFrame, keys: list[str], events: DataFrame) -> DataFrame:
    """p_hit of each distribution at each threshold of its statistic. events: the catalog, whose size does not depend on data."""
    tail = F.sum(F.when(F.col("outcome") >= F.col("threshold"), F.col("p")).otherwise(0.0))
    return table.join(F.broadcast(events), "stat").groupBy(*keys, "threshold", "classification").agg(tail.alias("p_hit"))


def priced(quotes: DataFrame, table: DataFrame, keys: list[str], cutoff: Column, received: str) -> DataFrame:
    """quotes (keys, side, line, odds) with p_win, p_push, fair odds and expected value under the distributions.

    A quote received after the cutoff is an error; one without a distribution is left out. Each quote meets one row, its
    distribution packed into an array, so quotes that repeat stay as they are.
    """
    late = F.when(F.col(received) > cutoff, F.raise_error(F.lit("a quote from after the cutoff"))).otherwise(F.col("line"))
    rows = quotes.withColumn("line", late).join(packed(table, keys), keys)
    side, line = F.col("side"), F.col("line")
    mass = lambda test: F.aggregate(F.filter("pmf", test), F.lit(0.0), lambda a, x: a + x["p"])
    above, below, at = (mass(t) for t in (lambda x: x["outcome"] > line, lambda x: x["outcome"] < line, lambda x: x["outcome"] == line))
    wins = F.when(side == "OVER", above).when(side == "UNDER", below).otherwise(above + at)
    out = rows.withColumns({"p_win": wins, "p_push": F.when(side != "HIT", at).otherwise(0.0)}).drop("pmf")
    fair = odds.non_push(F.col("p_win"), F.col("p_push"))
    return out.withColumns({"fair_odds": odds.american(fair), "ev": odds.expected_value(F.col("p_win"), F.col("p_push"), F.col("odds"))})


def actual(fields: list[str], policy: str = "field") -> Column:
    """What a settlement rule makes of a player's row: a field, or a sum with one of two policies for nulls."""
    known = [F.col(f).isNotNull() for f in fields]
    total = sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in fields[1:]), F.coalesce(F.col(fields[0]).cast("double"), F.lit(0.0)))
    if policy == "field":
        return F.col(fields[0]).cast("double")
    if policy == "require_all":
        return F.when(_all(known), total)
    if policy == "zero_if_any_known":
        return F.when(~_all([~k for k in known]), total)
    raise ValueError(f"unsupported null policy: {policy!r}")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def settled(bets: DataFrame, actuals: DataFrame, keys: list[str]) -> DataFrame:
    """bets (keys, side, line, odds) with actual, result and profit; bets without a row of results are dropped."""
    rows = bets.join(actuals, keys).withColumn("result", odds.outcome(F.col("side"), F.col("actual"), F.col("line")))
    return rows.withColumn("profit", F.when(F.col("actual").isNotNull(), odds.profit(F.col("result"), F.col("odds"))))


def linked(predictions: DataFrame, distributions: DataFrame, keys: list[str]) -> DataFrame:
    """predictions with the columns of their distribution; a prediction without one is an error."""
    require_empty(predictions.join(distributions, keys, "left_anti"), "a prediction without a distribution")
    return predictions.join(distributions, keys)
