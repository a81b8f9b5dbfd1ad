"""Connected components of a table of links, by contraction.

In a round, each component that has a link points to its smallest neighbour, or to itself; pointers are followed to
their ends by doubling; links are rewritten to what their ends have become, and links within a component go. Every
round at least halves the components that still have links, and every table is written out and read again, so that
no step depends on more than one before it. Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import release, stage


def _ends(parent: DataFrame) -> DataFrame:
    """parent (node, up), up <= node: follows up until it stays."""
    while True:
        step = parent.select(F.col("node").alias("up"), F.col("up").alias("next"))
        before, parent = parent, stage(parent.join(step, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.col("next") < F.col("up")).alias("moved")), "pointers")
        release(before)
        if parent.where("moved").isEmpty():
            return parent.select("node", "up")


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node that links (a, b) reach, for every node that has a link to another. Rows with a null are left out."""
    left = stage(links.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "links")
    found = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("comp"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = _ends(stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up")), "parents"))
        at = parent.select(F.col("node").alias("comp"), "up")
        found = stage(found.join(at, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "components")
        a, b = (parent.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        left = stage(left.join(a, "a").join(b, "b").where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "links")
    return found
