"""Entity resolution by rules in order of strength."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import text


def resolve(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rules: list[list[str]]) -> DataFrame:
    """left_id, right_id, status and rule: the first rule whose columns match exactly one id of right decides; if it matches more, the row is ambiguous."""
    found = None
    for n, rule in enumerate(rules):
        ids = right.groupBy(*rule).agg(F.min(right_id).alias("_id"), F.max(right_id).alias("_other"))
        one = left.join(ids, rule).groupBy(left_id).agg(F.min("_id").alias("_id"), F.max("_other").alias("_other")).withColumn("_rule", F.lit(n + 1))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(left_id).agg(F.min_by(F.struct("_id", "_other"), "_rule").alias("_ids"), F.min("_rule").alias("rule"))
    out = left.select(left_id).distinct().join(best, left_id, "left")
    sole = F.col("_ids._id") == F.col("_ids._other")
    status = F.when(F.col("_ids").isNull(), "UNMATCHED").when(sole, "MATCHED").otherwise("AMBIGUOUS")
    return out.select(left_id, F.when(sole, F.col("_ids._id")).alias(right_id), status.alias("status"), "rule")


#: What a player's match is, and the rule behind it.
EXACT, CORROBORATED, AMBIGUOUS, UNMATCHED = "MATCHED_EXACT", "MATCHED_CORROBORATED", "AMBIGUOUS", "UNMATCHED"
BY_NAME, BY_NAME_AND_COLLEGE, BY_LAST_NAME = "TEAM_WEEK+EXACT_NAME", "TEAM_WEEK+EXACT_NAME+COLLEGE", "TEAM_WEEK+LAST_NAME+COLLEGE"
SLOT = ["season", "week", "team"]


def player_crosswalk(appearances: DataFrame, rosters: DataFrame) -> DataFrame:
    """player, id, match_class, match_rule and n_appearances: who of the weekly rosters each player is.

    appearances: player, season, week, team, name, last_name, college, one row a game; rosters: season, week, team, id,
    full_name, football_name, last_name, college. Names and colleges are compared as `person_name` leaves them; a null matches
    nothing. A name of the same team and week decides if one id ever bears it; if more do, the college narrows them; if none
    does, a last name that is alone in its team and week must agree with the college. An id that two players claim is
    neither's. Each rule needs the least and greatest id of a key only, so no set of candidates is ever gathered.
    """
    college = lambda c: text.person_name(F.col(c))
    shown = rosters.select(*SLOT, "id", college("college").alias("college"), text.person_name(F.col("last_name")).alias("last"), F.array(text.person_name(F.col("full_name")), text.person_name(F.concat_ws(" ", F.when(F.col("last_name").isNotNull(), F.col("football_name")), "last_name"))).alias("_names"), F.col("football_name").isNotNull().alias("_both"))
    second = F.when(F.col("_both") & F.col("last").isNotNull(), F.col("_names")[1])
    named = shown.select(*SLOT, "id", "college", F.explode(F.array_compact(F.array(F.col("_names")[0], second))).alias("name"))
    span = lambda df, keys, n: df.groupBy(*SLOT, *keys).agg(F.min("id").alias(f"_lo{n}"), F.max("id").alias(f"_hi{n}"))
    rows = appearances.select("player", *SLOT, text.person_name(F.col("name")).alias("name"), text.person_name(F.col("last_name")).alias("last"), college("college").alias("college"))
    for n, (df, keys) in enumerate([(named, ["name"]), (named, ["name", "college"]), (shown, ["last"]), (shown, ["last", "college"])], 1):
        rows = rows.join(span(df, keys, n), [*SLOT, *keys], "left")
    several = F.bool_or(F.col("_lo3") < F.col("_hi3"))
    ends = [c for n in (1, 2, 4) for c in (F.min(f"_lo{n}").alias(f"_lo{n}"), F.max(f"_hi{n}").alias(f"_hi{n}"))]
    found = rows.groupBy("player").agg(F.count("*").alias("n_appearances"), F.coalesce(several, F.lit(False)).alias("_crowded"), *ends)
    none, one, more = (lambda n: F.col(f"_lo{n}").isNull()), (lambda n: F.coalesce(F.col(f"_lo{n}") == F.col(f"_hi{n}"), F.lit(False))), (lambda n: F.coalesce(F.col(f"_lo{n}") < F.col(f"_hi{n}"), F.lit(False)))
    rule = F.when(one(1), BY_NAME).when(more(1) & one(2), BY_NAME_AND_COLLEGE).when(none(1) & one(4) & ~F.col("_crowded"), BY_LAST_NAME)
    candidate = F.when(F.col("_rule") == BY_NAME, F.col("_lo1")).when(F.col("_rule") == BY_NAME_AND_COLLEGE, F.col("_lo2")).when(F.col("_rule") == BY_LAST_NAME, F.col("_lo4"))
    judged = found.withColumn("_rule", rule).withColumn("_id", candidate)
    claims = judged.where("_id IS NOT NULL").groupBy(F.col("_id").alias("_claimed")).agg(F.count("*").alias("_claims"))
    judged = judged.join(claims, F.col("_id") == F.col("_claimed"), "left")
    sole = F.col("_claims") == 1
    kind = F.when(F.col("_claims") > 1, AMBIGUOUS).when(F.col("_rule") == BY_NAME, EXACT).when(F.col("_rule").isNotNull(), CORROBORATED).when(more(1) | ~none(4), AMBIGUOUS).otherwise(UNMATCHED)
    return judged.select("player", F.when(sole, F.col("_id")).alias("id"), kind.alias("match_class"), F.when(sole, F.col("_rule")).alias("match_rule"), "n_appearances")
