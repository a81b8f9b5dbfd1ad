"""Bindings of providers' ids to canonical ids: each is made once and never changes its meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.text import stable_id
from tidemark.operators.quality import require_empty
from tidemark.sources.tables import cut

KEY = ["entity_kind", "provider", "provider_id"]


def conflicts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The key, least and largest canonical_id of what stored and batch bind to more than one; a null in batch asks for what is stored."""
    both = stored.select(*KEY, "canonical_id").unionByName(batch.select(*KEY, "canonical_id")).where("canonical_id IS NOT NULL")
    found = both.groupBy(*KEY).agg(F.min("canonical_id").alias("first"), F.max("canonical_id").alias("last"))
    return found.where("first <> last")


def attached(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """stored with the new keys of batch. A key without a canonical_id gets one that its own parts decide; one bound otherwise already is an error."""
    require_empty(conflicts(stored, batch), "provider ids that are bound to more than one canonical id")
    one = batch.groupBy(*KEY).agg(F.max("canonical_id").alias("canonical_id"))
    new = one.join(stored.select(*KEY), KEY, "left_anti")
    made = F.concat_ws("_", F.lower("entity_kind"), F.substring(stable_id(*[F.col(k) for k in KEY]), 1, 24))
    return stored.select(*KEY, "canonical_id").unionByName(new.withColumn("canonical_id", F.coalesce("canonical_id", made)))


def resolved(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (the key and more) with canonical_id, null where nothing is bound."""
    return asked.join(stored.select(*KEY, "canonical_id"), KEY, "left")


def followed(links: DataFrame) -> DataFrame:
    """from and to: where each link from one canonical id to its successor leads in the end. A circle is an error.

    links: from and to, each from once. Every round follows twice as many links, so a chain of n takes log2 n rounds.
    """
    now = cut(links.select("from", "to"))
    for _ in range(now.count().bit_length() + 1):  # a chain has no more links than there are
        further = now.select(F.col("from").alias("to"), F.col("to").alias("_next"))
        moved = cut(now.join(further, "to", "left").select("from", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")))
        now = moved.select("from", "to")
        if moved.where("moved").isEmpty():
            return now
    raise ValueError("canonical ids that lead back to themselves")
