"""Gates: what must hold before a product is used, and the joins and sums that the checks rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scoring import clipped
from tidemark.operators.distributions import past_sums
from tidemark.operators.quality import require_empty

BLOCK, WARN = "BLOCK", "WARN"
#: Kind of an input that is a price of a player's market.
MARKET_PRICE = "player_prop_market_price"


def issues(*checks: tuple[str, str, DataFrame]) -> DataFrame:
    """code, severity and n of each check (code, severity, rows at fault) that has rows."""
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n") for code, severity, rows in checks]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.where("n > 0")


def unpaired(rows: DataFrame, game: str, team: str) -> DataFrame:
    """Games that have not exactly two teams."""
    return rows.groupBy(game).agg(F.count_distinct(team).alias("n_teams")).where("n_teams <> 2")


def excess(parts: DataFrame, totals: DataFrame, key: list[str], part: str, total: str) -> DataFrame:
    """key and by how much the sum of the parts exceeds a known total."""
    return parts.join(totals.where(F.col(total).isNotNull()), key).withColumn("excess", F.col(part) - F.col(total)).where("excess > 0").select(*key, "excess")


def reconciled(rows: DataFrame, sums: DataFrame, official: DataFrame, key: list[str], summed: str, stated: str) -> DataFrame:
    """rows with reconciled: whether the sum of their group equals the official value; without either it is false."""
    equal = sums.join(official, key).select(*key, (F.col(summed) == F.col(stated)).alias("reconciled"))
    return rows.join(equal, key, "left").withColumn("reconciled", F.coalesce("reconciled", F.lit(False)))


def opportunity(rows: DataFrame, key: list[str], clock: str, flag: Column, value: Column, when: Column) -> DataFrame:
    """Latest time, whether any row is flagged, and the sum of value over the rows that count."""
    return rows.groupBy(*key).agg(F.max(clock).alias("latest"), F.bool_or(flag).alias("any_flag"), F.sum(F.when(when, value)).alias("opportunity"))


def directed(rows: DataFrame, key: list[str], targets: str, attempts: str, weight: Column) -> DataFrame:
    """Weighted targets and attempts over rows that know both and have no more targets than attempts."""
    valid = F.col(attempts).isNotNull() & (F.coalesce(F.col(targets), F.lit(0)) <= F.col(attempts))
    total = lambda c: F.sum(F.when(valid, F.coalesce(F.col(c), F.lit(0)) * weight)).alias(c)
    return rows.groupBy(*key).agg(F.count_if(valid).alias("n_valid"), total(targets), total(attempts))


UNPAIRED = "keys that are not in both tables exactly once"


def joined_one_to_one(left: DataFrame, right: DataFrame, key: list[str], at_once: bool = True) -> DataFrame:
    """The join of two tables that hold the same keys, each once; anything else is an error.

    at_once: keys are looked at before the join is given back, which reads both tables twice. Otherwise the error comes
    when the joined rows are read: counts of keys use the shuffle and the order that the join needs anyhow.
    """
    if not at_once:
        same = Window.partitionBy(*key)
        both = left.withColumn("_l", F.count("*").over(same)).join(right.withColumn("_r", F.count("*").over(same)), key, "full")
        paired = F.col("_l").eqNullSafe(1) & F.col("_r").eqNullSafe(1)
        return both.where(F.when(paired, True).otherwise(F.raise_error(F.lit(UNPAIRED)).cast("boolean"))).drop("_l", "_r")
    names = [F.col(k) for k in key]
    both = left.groupBy(*names).agg(F.count("*").alias("_l")).join(right.groupBy(*names).agg(F.count("*").alias("_r")), key, "full")
    require_empty(both.where("_l IS DISTINCT FROM 1 OR _r IS DISTINCT FROM 1"), UNPAIRED)
    return left.join(right, key)


def resolved_position(players: DataFrame, histories: DataFrame, player: str, cutoff: Column, clock: str, group: str, current: str) -> DataFrame:
    """player, position and its source: the latest group known at the cutoff (HISTORY), else the present one (CURRENT), else OTHER (NONE)."""
    known = histories.where(F.col(clock) <= cutoff).groupBy(player).agg(F.max_by(group, F.struct(clock, group)).alias("_then"))
    rows = players.join(known, player, "left")
    return rows.select(player, F.coalesce("_then", current, F.lit("OTHER")).alias("position"), F.when(F.col("_then").isNotNull(), "HISTORY").when(F.col(current).isNotNull(), "CURRENT").otherwise("NONE").alias("source"))


def sole_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and its only value, or null and conflict where there are more."""
    out = rows.groupBy(key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return out.select(key, F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias(value), (F.col("_low") != F.col("_high")).alias("conflict"))


def candidate_sets(rows: DataFrame, appearance: list[str], player: str, candidate: str) -> DataFrame:
    """Of each player: appearances, distinct candidates, and the most that one appearance has. Counts only, so no set is collected."""
    each = rows.groupBy(player, *appearance, candidate).agg(F.lit(1).alias("_1")).groupBy(player, *appearance).agg(F.count("*").alias("_n"))
    sizes = each.groupBy(player).agg(F.count("*").alias("appearances"), F.max("_n").alias("largest"))
    return sizes.join(rows.groupBy(player).agg(F.count_distinct(candidate).alias("candidates")), player)


def multiclass_loss(rows: DataFrame, group: list[str], p_true: str) -> DataFrame:
    """Mean loss -ln p of the probability given to what happened."""
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(-F.log(clipped(F.col(p_true)))).alias("loss"))


def skill(challenger: Column, baseline: Column) -> Column:
    """1 - challenger / baseline; 0 where the baseline is perfect."""
    return F.when(baseline == 0, 0.0).otherwise(1.0 - challenger / baseline)


def fallback_rate(rows: DataFrame, levels: list[list[str]], clock: str, y: str, least: int) -> DataFrame:
    """rows with level and rate: of the groups from narrow to broad, the first with `least` outcomes strictly before the row's time; level is its number.

    Each group is first added up by time, and the times of a group are dealt out by range, so a window goes over the
    distinct times of a range. A null group is a group of its own; a row without a time has no past and
    is in nobody's.
    """
    out = rows
    for i, level in enumerate(levels):
        told = F.when(F.col(clock).isNotNull(), F.col(y))
        times = rows.groupBy(*level, clock).agg(F.count(told).alias("n"), F.sum(told).alias("s"))
        past = past_sums(times, level, clock, ["n", "s"])
        names = [f"_k{j}" for j in range(len(level) + 1)]
        past = past.toDF(*names, f"_n{i}", f"_s{i}")
        on = F.lit(True)
        for c, name in zip([*level, clock], names, strict=True):
            on &= out[c].eqNullSafe(past[name])
        out = out.join(past, on).drop(*names)
    enough = [F.col(clock).isNotNull() & (F.col(f"_n{i}") >= least) for i in range(len(levels))]
    level, rate = F.lit(None).cast("int"), F.lit(None).cast("double")
    for i in reversed(range(len(levels))):
        level, rate = F.when(enough[i], i).otherwise(level), F.when(enough[i], F.col(f"_s{i}") / F.col(f"_n{i}")).otherwise(rate)
    return out.select(*rows.columns, level.alias("level"), rate.alias("rate"))


def leakage(lineage: DataFrame, prediction: str) -> DataFrame:
    """prediction, rule and how often it is broken. lineage, one row a prediction: as_of, game, player, prop, season, week,
    features and injuries (arrays of times), history (array of game, season, week, at, used), season_games (array of game, at),
    opening, closing_used, in_training, calibration_max, state_as_of, inputs (array of kind, player, prop).
    """
    n = lambda array, test: F.coalesce(F.size(F.filter(array, test)), F.lit(0))
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    as_of = F.col("as_of")
    price = F.filter("inputs", lambda i: i["kind"] == MARKET_PRICE)
    counts = {
        "feature_after_asof": n("features", lambda t: t > as_of),
        "predicted_game_result": n("history", lambda g: g["used"] & (g["game"] == F.col("game"))),
        "future_game_in_history": n("history", lambda g: ((g["season"] == F.col("season")) & (g["week"] > F.col("week"))) | (g["at"] > as_of)),
        "closing_odds_at_open": one(F.col("opening") & F.col("closing_used")),
        "injury_after_asof": n("injuries", lambda t: t > as_of),
        "future_game_in_season_aggregate": n("season_games", lambda g: g["at"] > as_of),
        "calibration_overlap": one(F.col("in_training")) + one(F.col("calibration_max") >= as_of),
        "state_after_asof": one(F.col("state_as_of") > as_of),
        "target_price_in_fundamental": n(price, lambda i: i["player"].isNull() | i["prop"].isNull() | ((i["player"] == F.col("player")) & (i["prop"] == F.col("prop")))),
    }
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), c.cast("long").alias("n")) for rule, c in counts.items()])
    return lineage.select(prediction, F.inline(each)).where("n > 0")


def superiority_reasons(least_rows: int, tolerance: float) -> Column:
    """Why a benchmark does not beat its market; empty if it does. Loss and Brier must be strictly less, ECE no more than tolerance above."""
    col = F.col
    tests = [
        ("sample too small", col("n") < least_rows), ("log loss not better", col("log_loss_model") >= col("log_loss_market")),
        ("Brier score not better", col("brier_model") >= col("brier_market")), ("calibration error worse", col("ece_model") > col("ece_market") + tolerance),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), reason) for reason, broken in tests]))


def evidence_reasons(evidence: list[str]) -> Column:
    """What of the named boolean columns is missing or false; all must be true."""
    return F.array_compact(F.array(*[F.when(F.col(e).isNull(), f"missing: {e}").when(~F.col(e), f"failed: {e}") for e in evidence]))


def stable(slices: DataFrame, group: list[str], promoted: Column) -> DataFrame:
    """Whether all slices of a group are promoted; null if one cannot say."""
    return slices.groupBy(*group).agg(F.when(F.count_if(promoted.isNull()) == 0, F.bool_and(promoted)).alias("stable"))


def reproduced(first: DataFrame, second: DataFrame, run: str) -> DataFrame:
    """run and whether two headers (n_rows, content_hash) of it agree; a run that one build lacks does not."""
    other = second.select(run, F.col("n_rows").alias("_n"), F.col("content_hash").alias("_h"))
    return first.join(other, run, "full").select(run, F.coalesce((F.col("n_rows") == F.col("_n")) & (F.col("content_hash") == F.col("_h")), F.lit(False)).alias("equal"))


def read_either(compact: DataFrame, legacy: DataFrame, key: list[str], value: str) -> DataFrame:
    """key and value from two stores; a key that both hold must have one value in both, or it is an error."""
    old = legacy.select(*key, F.col(value).alias("_old"))
    both = compact.join(old, key, "full")
    differ = F.col(value).isNotNull() & F.col("_old").isNotNull() & (F.col(value) != F.col("_old"))
    return both.select(*key, F.when(differ, F.raise_error(F.lit("two stores disagree"))).otherwise(F.coalesce(value, "_old")).alias(value))


def with_provenance(rows: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """rows with source_hash and max_available_at of what they were made from; a name that rows have already is an error."""
    if clash := {"source_hash", "max_available_at"} & set(rows.columns):
        raise ValueError(f"rows have {sorted(clash)} already")
    return rows.join(sources.select(*key, "source_hash", "max_available_at"), key, "left")


def scoreable(settled: DataFrame, availability: DataFrame, positions: DataFrame, game: str, player: str) -> DataFrame:
    """settled with outcome_available_at (of game and player) and position_group (of the player); a row that lacks one is an error."""
    # the two narrow tables meet first, so that wide rows are shuffled once
    facts = availability.select(game, player, "outcome_available_at").join(positions.select(player, "position_group"), player, "left")
    rows = settled.join(facts, [game, player], "left")
    rows = rows.select(player, game, *[c for c in rows.columns if c not in (game, player)])
    missing = F.when(F.col("outcome_available_at").isNull(), "outcome_available_at").when(F.col("position_group").isNull(), "position_group")
    told = F.when(missing.isNotNull(), F.raise_error(F.concat(F.lit("a settled prediction lacks "), missing)))
    return rows.withColumn("position_group", F.coalesce(told, F.col("position_group")))


#: The columns of a row of a backtest, with what each is called before.
BACKTEST = {
    "prediction_id": "prediction_id", "as_of": "as_of", "quote_available_at": "quote_available_at", "quote_time_source": "quote_time_source", "quote_age_seconds": "quote_age_seconds", "injury_data_available": "injury_data_available",
    "canonical_game_id": "game_id", "canonical_player_id": "player_id", "prop_type": "prop_type", "line": "line", "odds": "american_odds", "vendor": "vendor", "market_type": "market_type", "feature_snapshot_id": "feature_snapshot_id",
    "state_snapshot_id": "state_snapshot_id", "model_version": "model_version", "p_raw": "p_model_raw", "p_calibrated": "p_calibrated", "p_fundamental": "p_model_raw", "p_final": "p_calibrated", "market_fair": "p_market_fair",
    "devig_method": "devig_method", "devig_confidence": "devig_confidence", "actual_value": "actual_value", "outcome": "outcome_binary", "closing_line": None, "closing_odds": None, "quoted_at_close": None,
}


def backtest_rows(scoreable_: DataFrame, calibrated: DataFrame) -> DataFrame:
    """The 28 columns of a backtest. calibrated: prediction_id and p_calibrated, once for each prediction; anything else is an error, once rows are read."""
    joined = joined_one_to_one(scoreable_, calibrated.select("prediction_id", "p_calibrated"), ["prediction_id"], at_once=False)
    empty = {"closing_line": "double", "closing_odds": "int", "quoted_at_close": "boolean"}
    checked = F.when(F.col("p_calibrated").isNull(), F.raise_error(F.lit("a prediction without a calibrated probability"))).otherwise(F.col("p_calibrated"))
    return joined.withColumn("p_calibrated", checked).select(*[F.lit(None).cast(empty[c]).alias(c) if old is None else F.col(old).alias(c) for c, old in BACKTEST.items()])
