"""Raw payloads: stored by content, and mapped to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType


def landing(payloads: DataFrame, body: str, received: str) -> DataFrame:
    """One row for each distinct body: its hash, the first receipt and how often it came."""
    return payloads.groupBy(F.sha2(F.col(body), 256).alias("sha256")).agg(F.first(body).alias(body), F.min(received).alias("first_received"), F.count("*").alias("n_received"))


def mapped(payloads: DataFrame, body: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the body's fields typed by schema, and those whose body is no JSON of that kind."""
    read = payloads.withColumn("_json", F.from_json(body, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_json._corrupt").isNotNull() | F.col("_json").isNull()
    fields = StructType.fromDDL(schema).names
    return read.where(~bad).select(*payloads.columns, *[F.col(f"_json.{c}").alias(c) for c in fields]), read.where(bad).select(*payloads.columns)


def masked(column: str, secrets: list[str]):
    """The text with the values of named query parameters replaced."""
    out = F.col(column)
    for name in secrets:
        out = F.regexp_replace(out, f"(?i)({name}=)[^&\\\\s\"]+", "$1***")
    return out
