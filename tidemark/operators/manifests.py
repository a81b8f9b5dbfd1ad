"""Fingerprints of what was known: for every checkpoint and scope the count and an order-free hash of the rows available by its time.

Rows are hashed once for all scopes and move as they are (key, time, hash, and one number for the scopes they are in) to the
first checkpoint of their key that sees them; sums of all scopes exist for checkpoints only. However many checkpoints there
are, the rows are read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.distributions import past_sums, with_range
from tidemark.sources.tables import content_hash, cut


#: Ranges of times that the rows of one key are dealt out over.
SPREAD = 8


def fingerprints(rows: DataFrame, key: list[str], clock: str, scopes: dict[str, Column], content: list[str], checkpoints: DataFrame, at: str) -> DataFrame:
    """checkpoints with one struct (n_rows, sha256) for each scope: its rows of the checkpoint's key whose clock is not after `at`.

    Rows without a clock were never available and are in no scope.
    """
    digest = content_hash(content)
    part = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("long")
    # bit i tells whether a row is in scope i
    member = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(scopes.values())])
    hashed = rows.where(F.col(clock).isNotNull()).select(*key, F.col(clock).alias("_t"), part(1).alias("_a"), part(16).alias("_b"), member.alias("_in"), F.lit(None).cast(dict(checkpoints.dtypes)[at]).alias("_mark"))
    asked = checkpoints.select(*key, F.col(at).alias("_t")).where("_t IS NOT NULL").distinct()
    # the first checkpoint at or after a row: within a range of times by a window, else the first one of the ranges after it
    zero = F.lit(0).cast("long")
    both = with_range(hashed.unionByName(asked.select(*key, "_t", zero.alias("_a"), zero.alias("_b"), zero.alias("_in"), F.col("_t").alias("_mark"))), "_t", ranges=SPREAD)
    later = Window.partitionBy(*key, "_part").orderBy(F.col("_t").desc(), F.col("_mark").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_seen", F.last("_mark", True).over(later))
    # sums of the two halves of each hash (30 bits), so that they are whole numbers of 64 bits; an overflow is an error
    halves = [(f"{c[1]}{half}", (F.shiftright(c, 30) if half == "h" else F.col(c).bitwiseAND((1 << 30) - 1))) for c in ("_a", "_b") for half in "hl"]
    sums = []
    for i in range(len(scopes)):
        inside = F.col("_in").bitwiseAND(1 << i) != 0
        sums += [F.count_if(inside).alias(f"n{i}"), *[F.sum(F.when(inside, c).otherwise(zero)).alias(f"{n}{i}") for n, c in halves]]
    parts = [f"{c}{i}" for i in range(len(scopes)) for c in ("n", *(n for n, _ in halves))]
    added = cut(found.groupBy(*key, "_part", "_seen").agg(*sums))
    first = added.where("_seen IS NOT NULL").groupBy(*key, "_part").agg(F.min("_seen").alias("_first"))
    ahead = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_part").alias("_at"), "_first")
    on = F.col("_part") < F.col("_at")
    for i, k in enumerate(key):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rest = added.where("_seen IS NULL")
    moved = rest.join(ahead, on).groupBy(*key, "_part").agg(F.min("_first").alias("_seen"), *[F.first(n).alias(n) for n in parts])
    names = [f"{c}{i}" for i in range(len(scopes)) for c in "nab"]
    whole = lambda c, i: F.sum(f"{c}h{i}").cast("decimal(38,0)") * (1 << 30) + F.sum(f"{c}l{i}")
    made = [c for i in range(len(scopes)) for c in (F.sum(f"n{i}").cast("decimal(38,0)").alias(f"n{i}"), *[whole(c, i).cast("decimal(38,0)").alias(f"{c}{i}") for c in "ab"])]
    times = cut(added.where("_seen IS NOT NULL").unionByName(moved).groupBy(*key, F.col("_seen").alias("_t")).agg(*made))
    earlier = past_sums(times, key, "_t", names).toDF(*[f"_k{i}" for i in range(len(key))], "_kt", *[f"_{n}" for n in names])
    on = F.col("_t") == F.col("_kt")
    for i, k in enumerate(key):
        on &= times[k].eqNullSafe(earlier[f"_k{i}"])
    upto = times.join(earlier, on).select(*key, F.col("_t").alias(at), *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in names])
    value = lambda i: F.struct(F.col(f"n{i}").cast("long").alias("n_rows"), F.sha2(F.concat_ws("|", *[F.col(f"{c}{i}").cast("decimal(38,0)").cast("string") for c in "nab"]), 256).alias("sha256"))
    return checkpoints.join(upto, [*key, at], "left").select(*checkpoints.columns, *[value(i).alias(name) for i, name in enumerate(scopes)])


def changed(one: DataFrame, other: DataFrame, key: list[str], scopes: list[str]) -> DataFrame:
    """key and scope of every fingerprint that two builds do not share."""
    each = lambda df, name: df.select(*key, F.inline(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(f"{s}.sha256").alias(name)) for s in scopes])))
    return each(one, "_a").join(each(other, "_b"), [*key, "scope"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, "scope")
