"""What a forecast may read, by profile of the model and by how history is certified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.timing import latest_available, members_of_week
from tidemark.operators.pit import known_at, sole_membership
from tidemark.sources.tables import empty_like

#: Profiles and modes.
CORE, ENHANCED = "STRUCTURAL_CORE", "LIVE_ENHANCED"
LIVE, HISTORICAL = "LIVE_PIT", "HISTORICAL_WALK_FORWARD"


def slates(games: DataFrame, season: str = "season", week: str = "week", game: str = "game", kickoff: str = "kickoff") -> DataFrame:
    """game, slate (season * 100 + week), kickoff and boundary, the last kickoff of its slate. A game that has two slates is in none."""
    number = (F.col(season) * 100 + F.col(week)).cast("long")
    one = games.groupBy(game).agg(F.min(number).alias("slate"), F.max(number).alias("_b"), F.max(kickoff).alias("kickoff")).where("slate = _b").drop("_b")
    ends = one.groupBy("slate").agg(F.max("kickoff").alias("boundary"))
    return one.join(ends, "slate")


def certified(stats: DataFrame, chronology: DataFrame, target: int, as_of: Column, final: Column, game: str = "game") -> DataFrame:
    """Rows of final games in slates before the target's that ended by as_of; event_time is the boundary of their slate.

    When a row was received does not matter: it is the order of events that proves it was history.
    """
    past = chronology.where((F.col("slate") < target) & (F.col("boundary") <= as_of)).select(game, F.col("boundary").alias("event_time"))
    return stats.where(final).join(past, game)


def prior_slates(stats: DataFrame, chronology: DataFrame, target: int, game: str = "game") -> DataFrame:
    """Rows of games in slates before the target's; event_time is the kickoff."""
    return stats.join(chronology.where(F.col("slate") < target).select(game, F.col("kickoff").alias("event_time")), game)


def model_inputs(profile: str, mode: str, tables: dict[str, DataFrame], as_of: Column, target: int, final: Column, week: tuple[int, int] | None = None, statuses: tuple[str, ...] = ("ACT",)) -> dict[str, DataFrame]:
    """stats, odds, roster, injuries and membership (player, team) that the profile may read at as_of for the slate `target`.

    tables: games (game, season, week, kickoff, available_at), stats (game, available_at and more), odds, roster (player, team,
    available_at), injuries, and for HISTORICAL weekly (player, team, season, week, status). stats come with event_time.
    LIVE_ENHANCED reads all that was received by as_of, and cannot be replayed: odds, injuries and depth of the past have no
    certified time. STRUCTURAL_CORE reads no odds, injuries or roster rows; its membership is the live roster's, or the weekly
    roster's when history is walked. Whatever does not fit together is an error.
    """
    if profile not in (CORE, ENHANCED) or mode not in (LIVE, HISTORICAL):
        raise ValueError(f"unknown profile or mode: {profile}, {mode}")
    if profile == ENHANCED and mode != LIVE:
        raise ValueError("LIVE_ENHANCED has no certified past: it runs as LIVE_PIT only")
    weekly = tables.get("weekly")
    if mode == LIVE and weekly is not None:
        raise ValueError("weekly rosters prove membership in the past only")
    nothing = {name: empty_like(tables[name]) for name in ("odds", "roster", "injuries")}
    if mode == HISTORICAL:
        if weekly is None or week is None:
            raise ValueError("walking history needs weekly rosters and the week of the target")
        members = members_of_week(weekly.where((F.col("season") == week[0]) & (F.col("week") == week[1])), "player", "team", ["season", "week"], list(statuses), "status").select("player", "team")
        return {"stats": certified(tables["stats"], slates(tables["games"]), target, as_of, final), **nothing, "membership": members}
    known = known_at(tables["stats"], as_of)
    chronology = slates(known_at(tables["games"], as_of))
    members = sole_membership(tables["roster"], "player", "team", "available_at", as_of)
    if profile == CORE:
        return {"stats": prior_slates(known, chronology, target), **nothing, "membership": members}
    dated = known.join(chronology.select("game", F.col("kickoff").alias("event_time")), "game", "left")
    return {"stats": dated, **{name: known_at(tables[name], as_of) for name in nothing}, "membership": members}


def last_times(inputs: dict[str, DataFrame], entity: str, as_of: Column) -> DataFrame:
    """entity and the latest time at which any of its rows of stats, roster or injuries was available."""
    parts = [latest_available(inputs[n], entity, as_of, "available_at") for n in ("stats", "roster", "injuries") if {entity, "available_at"} <= set(inputs[n].columns)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(entity).agg(F.max("available_at").alias("available_at"))
