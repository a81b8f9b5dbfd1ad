"""A corpus pipeline over documents: toxicity, exact copies, near copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; `run` writes the result of each
as Parquet in the shared folder and reads it again. All stages but the last return the columns of documents, others
that docs has included.

In every stage a null text counts as an empty one, null ids are rows like others, and texts are read whole, however
long. Rows that repeat another in id and text fare alike until exact_dedup, which keeps one of them. Labels of ids that
docs lacks are ignored; without labels nothing is toxic and all rows stay as often as they are. An empty table of
documents gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import mixing, toxicity
from tidemark.llm.byte_bpe import decode, encode, n_tokens
from tidemark.llm.common import release, stage, uid
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.ngram_join import ngram_join

#: Shares of words that documents of low and high quality are to have after mixing, and the most copies of one.
QUALITY = {"0": 0.10, "1": 0.90}
MOST_COPIES = 4.0
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that are not predicted to be toxic; the model learns from the labelled rows among docs."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest doc_id."""
    return _keep(docs, exact_dedup(docs).where("kept").groupBy("text_sha256", "doc_id").agg(F.min("uid").alias("uid")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id."""
    owners = ngram_join(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return _keep(docs, owners.groupBy("component", "doc_id").agg(F.min("uid").alias("uid")))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs as often as their rates say; the domains are the two labels of quality."""
    labels = _labels(spark, sf_dir).select("doc_id", F.col("quality").alias("domain"))
    return mixing.resample(docs, labels, QUALITY, MOST_COPIES)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    out = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    return out.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _keep(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """The rows of docs that owners names by doc_id and uid, a hash of the text; of rows that agree in both, one."""
    key = "_".join(["key", *docs.columns])  # no column has this name
    rows = docs.withColumn(key, F.struct(docs["doc_id"].cast("long").alias("doc_id"), uid(docs).alias("uid")))
    kept = rows.join(owners.select(F.struct("doc_id", "uid").alias(key)), key, "left_semi")
    return kept.dropDuplicates([key]).select(*[rows[c] for c in docs.columns])


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix_to_targets), ("byte_bpe", tokenise)]

#: SQL has neither the models nor the tokenizer; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        before, docs = docs, stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
