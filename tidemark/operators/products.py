"""Immutable products: rows under a run, with a header that proves them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.gates import superiority_reasons
from tidemark.sources.tables import content_hash


def header(rows: DataFrame, run: str, content: list[str]) -> DataFrame:
    """run, row count and content hash of each run. The hash is a sum of row hashes, so it needs neither order nor one task for all rows."""
    low = F.conv(F.substring(content_hash(content), 1, 15), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(content_hash(content), 16, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy(run).agg(F.count("*").alias("n_rows"), F.sum(low).alias("_a"), F.sum(high).alias("_b"))
    return sums.select(run, "n_rows", F.sha2(F.concat_ws("|", "n_rows", "_a", "_b"), 256).alias("content_hash"))


def conflicts(stored: DataFrame, batch: DataFrame, run: str) -> DataFrame:
    """Headers of batch whose run is stored with other rows; none may be."""
    old = stored.select(run, F.col("content_hash").alias("_old"), F.col("n_rows").alias("_n"))
    return batch.join(old, run).where("content_hash <> _old OR n_rows <> _n").drop("_old", "_n")


def missing_grid(rows: DataFrame, entity: list[str], axis: str) -> DataFrame:
    """Entities that lack a value of the axis that others have, with how many."""
    size = rows.agg(F.count_distinct(axis).alias("_all"))
    have = rows.groupBy(*entity).agg(F.count_distinct(axis).alias("_n"))
    return have.crossJoin(F.broadcast(size)).where("_n < _all").select(*entity, (F.col("_all") - F.col("_n")).alias("n_missing"))


def promotion(benchmark: DataFrame, least_rows: int = 500, tolerance: float = 0.01) -> DataFrame:
    """benchmark (with ece_model and ece_market) with reasons against a promotion, and promoted where there are none."""
    rows = benchmark.withColumn("reasons", superiority_reasons(least_rows, tolerance))
    return rows.withColumn("promoted", F.size("reasons") == 0)


def leaks(rows: DataFrame, cutoff: str, clocks: list[str]) -> DataFrame:
    """Rows of a lineage with a clock after the cutoff, or none at all, by clock and rule."""
    tests = F.array(*[F.struct(F.lit(c).alias("clock"), F.when(F.col(c).isNull(), "unknown").when(F.col(c) > F.col(cutoff), "future").alias("rule")) for c in clocks])
    return rows.withColumn("_t", F.explode(F.filter(tests, lambda t: t["rule"].isNotNull()))).select(*rows.columns, "_t.clock", "_t.rule")
