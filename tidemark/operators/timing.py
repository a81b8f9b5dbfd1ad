"""When quotes, games, memberships and results were known, and which of them may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.pit import known_at, latest
from tidemark.sources.tables import keep_one

#: The column that says when a quote was received, by market mode.
RECEIPT = {"live": "collector_received_at", "opening": "collector_received_at"}


def knowledge_time(quotes: DataFrame, mode: str) -> DataFrame:
    """quotes with known_at, when each could be known. A mode that is not known, a missing column or a missing receipt is an error."""
    if mode not in RECEIPT:
        raise ValueError(f"unsupported market mode: {mode!r}")
    if RECEIPT[mode] not in quotes.columns:
        raise ValueError(f"{mode} quotes lack the column {RECEIPT[mode]}")
    received = F.col(RECEIPT[mode])
    return quotes.withColumn("known_at", F.when(received.isNull(), F.raise_error(F.lit(f"a {mode} quote lacks {RECEIPT[mode]}"))).otherwise(received))


def game_knowledge_time(quotes: DataFrame, game: str, cutoff: Column, mode: str) -> DataFrame:
    """The latest receipt of each game at or before the cutoff; quotes without one count for nothing."""
    received = F.col(RECEIPT[mode])
    return quotes.where(received <= cutoff).groupBy(game).agg(F.max(received).alias("known_at"))


def exclusion_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that holds, null for a quote that may be published. A rule that is null does not hold."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def vendor_allowed(vendor: Column, blocked: list[str]) -> Column:
    """Whether a vendor, whatever its case and the spaces around it, is named and not blocked."""
    name = F.lower(F.trim(vendor))
    return F.coalesce(name != "", F.lit(False)) & ~name.isin([b.strip().lower() for b in blocked])


def games_as_of(games: DataFrame, key: list[str], cutoff: Column, clock: str, tie: str, status: str, allowed: list[str]) -> DataFrame:
    """The last row of each game at the cutoff, and of those the ones whose status is allowed: a game that has ended since is not revived by an older row."""
    return latest(games, key, cutoff, clock, tie).where(F.col(status).isin(allowed))


def final_or_unknown(status: Column) -> Column:
    """Whether a status is null or starts with 'Final'."""
    return status.isNull() | status.startswith("Final")


def kickoffs(games: DataFrame, game: str, final: str, at: str) -> DataFrame:
    """The kickoff of each game: that of its final row, or else of its last one."""
    return games.groupBy(game).agg(F.max_by(at, F.struct(final, at)).alias("kickoff"))


def conflicting(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with other than one distinct value; nulls are no value."""
    return df.groupBy(*key).agg(F.count_distinct(value).alias("n_values")).where("n_values <> 1")


def conflict_flag(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """df with conflict: whether its key has more than one distinct value."""
    w = Window.partitionBy(*key)
    return df.withColumn("conflict", F.min(value).over(w) != F.max(value).over(w))


def known_version(versions: DataFrame, key: list[str], cutoff: Column, available: str, order: list[str]) -> DataFrame:
    """The version of each key that was known at the cutoff: the last by all columns of order."""
    return keep_one(known_at(versions, cutoff, available), key, [F.col(c).desc_nulls_last() for c in order])


def members_of_week(roster: DataFrame, entity: str, owner: str, period: list[str], statuses: list[str], status: str) -> DataFrame:
    """entity, period and owner of those members that exactly one owner has in a period; two make it ambiguous."""
    members = roster.where(F.col(status).isin(statuses)).groupBy(entity, *period).agg(F.count_distinct(owner).alias("_n"), F.min(owner).alias(owner))
    return members.where("_n = 1").drop("_n")


def latest_available(df: DataFrame, entity: str, cutoff: Column, clock: str) -> DataFrame:
    return known_at(df, cutoff, clock).groupBy(entity).agg(F.max(clock).alias("available_at"))


def availability_of_result(date: Column, hours: Column | int, given: Column) -> tuple[Column, Column]:
    """When a result was known, and whether that is an estimate: as given, or else `hours` after the date. Without either it is an error."""
    lag = F.make_dt_interval(hours=hours if isinstance(hours, Column) else F.lit(hours))
    estimate = F.when(date.isNull(), F.raise_error(F.lit("a result lacks its date"))).otherwise(date + lag)
    return F.coalesce(given, estimate), given.isNull()


def event_time_known(rows: DataFrame, event: str, available: str = "available_at", estimated: str = "available_at_is_estimated") -> DataFrame:
    """rows available from the time of their event; a row without one keeps the time it has and is flagged as an estimate. A missing column is an error."""
    if event not in rows.columns:
        raise ValueError(f"rows lack the time of their event, {event}")
    return rows.withColumns({available: F.coalesce(F.col(event), F.col(available)), estimated: F.col(event).isNull()})


def evidence_class(genuine: Column, at: Column, cutoff: Column, final: Column) -> Column:
    """What a row proves before a game: OBSERVED, ESTIMATED, LATE, NOT_FINAL or UNDATED."""
    return F.when(at.isNull(), "UNDATED").when(at > cutoff, "LATE").when(~final, "NOT_FINAL").when(genuine, "OBSERVED").otherwise("ESTIMATED")


def overlapping_slates(slates: DataFrame) -> DataFrame:
    """Slates (in the order of first_kickoff) whose last kickoff is not before the next one's first. The slates are few."""
    w = Window.orderBy("first_kickoff")
    return slates.withColumn("_next", F.lead("first_kickoff").over(w)).where("last_kickoff >= _next").drop("_next")


def checkpoint_state(scheduled: Column, now: Column, done: Column, grace: str, catch_up: str) -> Column:
    """DONE, PENDING (not yet due), DUE (within grace), CATCH_UP (late, but still worth it) or MISSED."""
    late = lambda by: now > scheduled + F.expr(f"INTERVAL {by}")
    return F.when(done, "DONE").when(now < scheduled, "PENDING").when(~late(grace), "DUE").when(~late(catch_up), "CATCH_UP").otherwise("MISSED")


def due(last_cycle: Column, now: Column, cadence_seconds: Column) -> Column:
    """Whether a collection is due: none before, or one as long ago as the present cadence."""
    return last_cycle.isNull() | (F.unix_seconds(now) - F.unix_seconds(last_cycle) >= cadence_seconds)


def select_request(requests: DataFrame, now: Column, run: str | None = None) -> DataFrame:
    """The request to handle, at most one row of requests (run_id, kickoff_at, as_of and more).

    The one named by run, which must be there; else of those whose game is still to come the one of earliest kickoff, time and
    id, and without such the earliest by time and id of the others.
    """
    if run is not None:
        named = requests.where(F.col("run_id") == run).limit(1)
        if named.isEmpty():
            raise ValueError(f"run {run} is not among the requests that can be handled")
        return named
    later = F.coalesce(F.col("kickoff_at") > now, F.lit(False))
    return requests.orderBy(F.desc(later), F.when(later, F.col("kickoff_at")), "as_of", "run_id").limit(1)
