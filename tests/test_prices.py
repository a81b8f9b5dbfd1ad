"""Expected values and their rounding are those of the SQL to the last decimal, not only within a tolerance."""

from pyspark.sql import functions as F

from oracle import connect
from tidemark.functions import odds
from tidemark.plans import ORACLE_SQL, QUERIES
from tidemark.plans.common import scaled


def test_expected_values_as_in_sql(spark, sf):
    grid = spark.range(33).select((F.col("id") / 32).alias("w")).crossJoin(spark.range(100, 200).select(F.col("id").alias("odds")))
    got = grid.select("w", "odds", scaled(odds.expected_value(F.col("w"), F.lit(0.0), F.col("odds"))).alias("ev"))
    want = connect(sf).execute("SELECT i / 32 AS w, o AS odds, round(w * o / 100.0 - (1 - w), 6) FROM range(33) t(i), range(100, 200) u(o)").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    signs = spark.createDataFrame([(-110,), (0,), (None,)], "odds int").select(odds.expected_value(F.lit(0.5), F.lit(0.25), F.col("odds"))).collect()
    assert [r[0] for r in signs] == [0.5 * 100 / 110 - 0.25, None, None]


def test_calibrated_prices_equal_sql_exactly(spark, sf):
    out = connect(sf).execute(ORACLE_SQL["calibrated_prices"])
    names = [d[0] for d in out.description]
    plain = lambda row: str([x + 0.0 if isinstance(x, float) else x for x in row])
    assert sorted(map(plain, out.fetchall())) == sorted(plain([r[c] for c in names]) for r in QUERIES["calibrated_prices"](spark, sf).collect())
