"""Parsing of names, clocks and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def person_name(name: Column) -> Column:
    """Lower case without punctuation, generational suffix and repeated spaces."""
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, " (jr|sr|ii|iii|iv|v)$", ""), " +", " "))


def clock_seconds(clock: Column) -> Column:
    """Seconds of mm:ss; null where it is not of that form."""
    parts = F.split(clock, ":")
    return F.when(clock.rlike("^[0-9]+:[0-9]{1,2}$"), parts[0].cast("int") * 60 + parts[1].cast("int"))


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by '|', in hex; null parts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def key60(digest: Column) -> Column:
    """First 15 hex digits as a number."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def uniform(digest: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)
