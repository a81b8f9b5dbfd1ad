"""A registry of calibration artifacts as a log of events: which were allowed, and what was in force when.

An event is lawful by what lawfully happened to its artifact before: it is registered first, validated after that,
approved after a passed validation, promoted after an approval; nothing but another end follows its end. Each of these
firsts is one aggregate by artifact, so no artifact's events meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.distributions import past_last

REGISTERED, VALIDATED, APPROVED, PROMOTED = "REGISTERED", "VALIDATED", "APPROVED", "PROMOTED"
#: Events after which an artifact is of no use.
ENDS = ("INVALIDATED", "RETIRED")


def _first(events: DataFrame, name: str, when: Column) -> DataFrame:
    """events with the place of the artifact's first event for which `when` holds."""
    firsts = events.where(when).groupBy(F.col("artifact").alias("_artifact")).agg(F.min("place").alias(name))
    return events.join(firsts, F.col("artifact") == F.col("_artifact"), "left").drop("_artifact")


def judged(events: DataFrame) -> DataFrame:
    """events (artifact, kind, at, seq, content, passed and more) with fault, null where the event was allowed.

    at and seq order the events; content is a hash of what is registered, passed whether a validation was passed.
    """
    rows = events.withColumn("place", F.struct("at", "seq"))
    kind, place = F.col("kind"), F.col("place")
    rows = _first(rows, "_registered", kind == REGISTERED)
    # what was registered first is the artifact's content for good
    contents = events.where(kind == REGISTERED).groupBy(F.col("artifact").alias("_artifact")).agg(F.min_by("content", F.struct("at", "seq")).alias("_content"))
    rows = rows.join(contents, F.col("artifact") == F.col("_artifact"), "left").drop("_artifact")
    after = lambda c: F.coalesce(place > F.col(c), F.lit(False))
    before = lambda c: F.coalesce(place <= F.col(c), F.lit(True))
    rows = _first(rows, "_ended", kind.isin(*ENDS) & after("_registered"))
    rows = _first(rows, "_valid", (kind == VALIDATED) & F.col("passed") & after("_registered") & before("_ended"))
    rows = _first(rows, "_approved", (kind == APPROVED) & after("_valid") & before("_ended"))
    fault = (
        F.when((kind == REGISTERED) & ~F.col("content").eqNullSafe(F.col("_content")), "registered again with other content")
        .when((kind != REGISTERED) & ~after("_registered"), "not registered")
        .when(kind.isin(APPROVED, PROMOTED) & ~before("_ended"), "ended")
        .when((kind == APPROVED) & ~after("_valid"), "no passed validation")
        .when((kind == PROMOTED) & ~after("_approved"), "not approved")
        .when(~kind.isin(REGISTERED, VALIDATED, APPROVED, PROMOTED, *ENDS), "unknown event")
    )
    return rows.select(*events.columns, fault.alias("fault"), F.col("_ended.at").alias("ended_at"))


def in_force(events: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (scope, at) with artifact: the one last promoted lawfully in the scope by then, null if there is none or it had ended by then."""
    lawful = judged(events).where((F.col("fault").isNull()) & (F.col("kind") == PROMOTED))
    promoted = lawful.groupBy("scope", "at").agg(F.max_by(F.struct("artifact", "ended_at"), "seq").alias("value"))
    asked = asked.select("scope", "at").distinct()
    times = promoted.unionByName(asked.withColumn("value", F.lit(None).cast(dict(promoted.dtypes)["value"]))).groupBy("scope", "at").agg(F.max("value").alias("value"))
    last = past_last(times, ["scope"], "at", "value")
    ended = F.coalesce(F.col("value.ended_at") <= F.col("at"), F.lit(False))
    return asked.join(last, ["scope", "at"]).select("scope", "at", F.when(~ended, F.col("value.artifact")).alias("artifact"))
