"""Checks on tables; each gives the rows or counts at fault."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def negative_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column, how many values are negative."""
    return df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in columns])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key the parent lacks."""
    return child.join(parent.select(F.col(parent_key).alias("_parent")).distinct(), F.col(child_key) == F.col("_parent"), "left_anti")


def exact_duplicates(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows and surplus rows of each group, in one shuffle of distinct rows."""
    each = df.groupBy(*group, *columns).agg(F.count("*").alias("_n"))
    return each.groupBy(*group).agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_surplus"))


def require_empty(df: DataFrame, reason: str) -> None:
    """Raises if df has a row; looks at one."""
    if row := df.limit(1).collect():
        raise ValueError(f"{reason}: {row[0].asDict()}")
