"""Folds of a validation experiment, what is wrong with them, and the manifest that names the experiment by its content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Times of a fold in the order they must have: fitting, selection, scoring.
TIMES = ("train_start", "train_end", "selection_end", "score_start", "score_end")
HASHES = ("source_sha256", "config_sha256", "data_manifest_sha256")


def judged_folds(folds: DataFrame, experiment: str, place: str) -> DataFrame:
    """folds (experiment, place, fold_id and TIMES) with fault: the first rule that a fold breaks, null if none.

    Within a fold times are in order and scoring begins after selection has ended. From one fold to the next the start of
    fitting stays, fitting and selection never end earlier, and scoring begins after the last scoring ended. An experiment's
    folds are few, whatever the rows that they cut up.
    """
    w = Window.partitionBy(experiment)
    before = lambda c: F.lag(c).over(w.orderBy(place))
    start, fitted, chosen, scored, ended = (F.col(c) for c in TIMES)
    same = F.count("*").over(Window.partitionBy(experiment, "fold_id"))
    rules = [
        ("NO_ID", F.coalesce(F.trim("fold_id"), F.lit("")) == ""),
        ("NO_TIME", F.greatest(*[F.col(c).isNull().cast("int") for c in TIMES]) == 1),
        ("TRAIN_ORDER", start > fitted),
        ("SELECTION_BEFORE_TRAIN_END", fitted > chosen),
        ("SCORE_BEFORE_SELECTION_END", chosen >= scored),
        ("SCORE_ORDER", scored > ended),
        ("REPEATED_ID", same > 1),
        ("ORIGIN_MOVED", start != F.first("train_start").over(w.orderBy(place))),
        ("TRAIN_SHRINKS", fitted < before("train_end")),
        ("SELECTION_SHRINKS", chosen < before("selection_end")),
        ("SCORES_OVERLAP", scored <= before("score_end")),
    ]
    fault = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        fault = F.when(holds, name).otherwise(fault)
    return folds.withColumn("fault", fault)


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def manifests(experiments: DataFrame, folds: DataFrame) -> DataFrame:
    """experiment_id, payload and sha256: canonical JSON (keys in order, no spaces) of each experiment with its folds in order of place.

    experiments: experiment_id, evidence_class, protocol_version and HASHES; folds: experiment_id, place, fold_id and TIMES.
    An experiment without folds, with a faulty fold, or with a name that is empty or a hash that is none is an error when
    its row is read.
    """
    fold = F.struct(F.col("fold_id"), *[_iso(c).alias(c) for c in sorted(TIMES)])
    listed = judged_folds(folds, "experiment_id", "place").groupBy("experiment_id").agg(F.array_sort(F.collect_list(F.struct(F.col("place"), fold.alias("fold")))).alias("_f"), F.min("fault").alias("_fault"))
    rows = experiments.join(listed, "experiment_id", "left")
    bad_hash = F.lit(False)
    for h in HASHES:
        bad_hash |= ~F.coalesce(F.col(h).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    blank = (F.coalesce(F.trim("experiment_id"), F.lit("")) == "") | (F.coalesce(F.trim("protocol_version"), F.lit("")) == "")
    fault = F.when(blank, "NO_NAME").when(bad_hash, "NO_HASH").when(F.col("_f").isNull(), "NO_FOLDS").otherwise(F.col("_fault"))
    body = F.to_json(F.struct("config_sha256", "data_manifest_sha256", "evidence_class", "experiment_id", F.transform("_f", lambda x: x["fold"]).alias("folds"), "protocol_version", "source_sha256"))
    payload = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("experiment "), F.coalesce("experiment_id", F.lit("")), F.lit(": "), fault))).otherwise(body)
    return rows.select("experiment_id", payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
