"""Provider values to canonical ones, as column expressions: null where a form is unknown, an error where it must be known."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Codes of positions by group; anything else is OTHER.
POSITION_GROUPS = {"QB": "QB", "RB": "RB", "HB": "RB", "TB": "RB", "FB": "FB", "WR": "WR", "TE": "TE", "K": "K", "PK": "K"}
#: Injury statuses by their lower-case name, '-' and '_' read as spaces; anything else is UNKNOWN_PROVIDER_STATUS.
INJURY_STATUSES = {
    "active": "ACTIVE", "healthy": "ACTIVE", "probable": "PROBABLE", "questionable": "QUESTIONABLE", "q": "QUESTIONABLE", "doubtful": "DOUBTFUL", "d": "DOUBTFUL",
    "out": "OUT", "o": "OUT", "inactive": "INACTIVE", "injured reserve": "IR", "ir": "IR", "reserve dnr": "RESERVE", "physically unable to perform": "PUP", "pup": "PUP",
    "pup p": "PUP", "pup r": "PUP", "non football injury": "NFI", "nfi": "NFI", "nfi a": "NFI", "nfi r": "NFI", "suspended": "SUSPENDED", "susp": "SUSPENDED", "reserve sus": "SUSPENDED",
}
UNKNOWN = "UNKNOWN_PROVIDER_STATUS"
#: Parts of a play's type and its family, the first that occurs counts.
PLAY_FAMILIES = (("kneel", "KNEEL"), ("spike", "SPIKE"), ("sack", "SACK"), ("field goal", "FIELD_GOAL"), ("field_goal", "FIELD_GOAL"), ("punt", "PUNT"), ("kickoff", "KICKOFF"), ("penalty", "PENALTY"), ("rush", "RUN"), ("run", "RUN"), ("pass", "PASS"))


def _lookup(key: Column, table: dict[str, str], other: str) -> Column:
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(found, F.coalesce(key, F.lit(""))), F.lit(other))


def inches(height: Column) -> Column:
    """Height in inches: feet and inches parted by a dash or a mark, or inches alone, with or without their unit; null for others."""
    bare = F.lower(F.trim(height))
    for unit in ("inches", "in", '"', "″"):
        bare = F.when(F.endswith(bare, F.lit(unit)), F.rtrim(F.left(bare, F.length(bare) - len(unit)))).otherwise(bare)
    parts = F.transform(F.split(F.translate(bare, "'′", "--"), "-"), lambda part: F.trim(part).try_cast("decimal(9,4)").cast("double"))
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(F.size(parts) == 1, first).when(F.size(parts) == 2, first * 12 + second)


def pounds(weight: Column) -> Column:
    """The first number of a text, null where it is not positive."""
    number = F.regexp_extract(weight, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(number > 0, number)


def experience(value: Column) -> Column:
    """Years of experience: 0 for rookies, the first number of other texts."""
    text = F.lower(F.trim(value))
    return F.when(text.isin("r", "rookie", "rook"), 0).otherwise(F.regexp_extract(text, r"\d+", 0).try_cast("int"))


def position_group(position: Column) -> Column:
    return _lookup(F.upper(F.trim(position)), POSITION_GROUPS, "OTHER")


def injury_status(status: Column) -> Column:
    """Canonical status; what is not known is never taken for healthy."""
    return _lookup(F.translate(F.lower(F.trim(status)), "-_", "  "), INJURY_STATUSES, UNKNOWN)


def play_family(*types: Column) -> Column:
    """Family of a play by the texts that describe its type."""
    text = F.lower(F.concat_ws(" ", *types))
    out = F.lit("OTHER")
    for part, family in reversed(PLAY_FAMILIES):
        out = F.when(text.contains(part), family).otherwise(out)
    return out


def possession_seconds(clock: Column) -> Column:
    """Seconds of minutes:seconds; null stays null, any other form is an error."""
    parts = F.split(F.trim(clock), ":")
    minutes, seconds = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    digits = F.translate(F.concat(minutes, seconds), "0123456789", "") == ""
    fine = (F.size(parts) == 2) & digits & F.length(minutes).between(1, 3) & (F.length(seconds) == 2) & (seconds.try_cast("int") < 60)
    return F.when(fine, minutes.try_cast("int") * 60 + seconds.try_cast("int")).when(clock.isNotNull(), F.raise_error(F.concat(F.lit("invalid possession time: "), clock)).cast("int"))


#: Weeks of the postseason and the weeks of a season they are.
POSTSEASON_WEEKS = {1: 19, 2: 20, 3: 21, 5: 22}


def season_week(postseason: Column, week: Column) -> Column:
    """The week of a season; a week of the postseason that is not known is null."""
    known = F.create_map(*[F.lit(x) for pair in POSTSEASON_WEEKS.items() for x in pair])
    return F.when(F.coalesce(postseason, F.lit(False)), F.try_element_at(known, F.coalesce(week.cast("int"), F.lit(-1)))).otherwise(week.cast("int"))


def line(value: Column, kind: str = "decimal(18,6)") -> Column:
    """A line as a decimal, read from its text without a binary number between; null stays null, any other text is an error."""
    text = F.trim(value.cast("string"))
    number = text.try_cast(kind)
    return F.when(number.isNotNull(), number).when(value.isNotNull(), F.raise_error(F.concat(F.lit("unparseable line: "), text)).cast(kind))


def opened(opened_at: Column, updated_at: Column) -> Column:
    """When a quote opened, or else was last updated; texts with a zone are read as UTC."""
    return F.coalesce(F.try_to_timestamp(opened_at), F.try_to_timestamp(updated_at))


def canonical_id(namespace: str, *parts: Column) -> Column:
    """UUID version 5 of the parts joined by ':' in a namespace (a UUID in hex)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.concat_ws(":", *parts).cast("binary")))
    variant = F.substring(F.lit("89ab" * 4), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def canonical_json(*columns: str) -> Column:
    """The columns as compact JSON with sorted keys, nulls included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def utc_micros(at: Column) -> Column:
    """Microseconds since 1970 of a time; one without a zone is in UTC."""
    return F.unix_micros(F.to_utc_timestamp(at, F.current_timezone()))
