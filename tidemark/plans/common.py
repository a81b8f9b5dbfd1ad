"""How queries read their tables, and the registry that keeps a query and its SQL together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Decimals that both engines round floating results to.
DECIMALS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, DECIMALS)


def tied(column: Column | str) -> Column:
    """As `rounded`, for sums of shares: 12 decimals first, so that half a unit of the last place is one in whatever order they were added up."""
    return rounded(F.round(column, 2 * DECIMALS))


def scaled(column: Column | str) -> Column:
    """As the SQL's round: the nearest whole number of units of the last place. `rounded` goes by the decimal digits of a value, which may read as a tie what is none."""
    unit = float(10**DECIMALS)
    return F.round((F.col(column) if isinstance(column, str) else column) * unit, 0) / unit


def text_time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
