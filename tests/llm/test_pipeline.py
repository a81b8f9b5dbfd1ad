"""Each stage against a plain version over the same rows."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, toxicity
from tidemark.llm.common import stage
from test_ngram_join import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """Documents with copies, near copies, toxic rows, nulls, repeated rows and ids; labels of most."""
    rng, at = random.Random(5), str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        toxic = int(i % 6 == 0)
        if toxic:
            words[7], words[30] = "idiot", "1d10t"
        if i % 5 == 0:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(i % 5 != 0), toxic))
    for i in range(400, 430):
        rows.append((i, rows[i - 400][1].upper() if i % 2 else rows[i - 399][1].replace(" ", " x ", 1), None, None, None))
    rows += [(430, None, "en", "s", 0), (431, "", "en", "s", 0), (None, "nothing to see here at all", None, None, None), (1, rows[1][1], "en", "s", 1), (2, "another text of the same id, quite short", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def key(r):
    return str((r.doc_id, r.text))


def test_stages(spark, inputs):
    docs = spark.read.parquet(f"{inputs}/documents.parquet")
    before = docs.collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "byte_bpe"]

    docs = stage(corpus_pipeline.reject_toxic(spark, docs, inputs), "t")
    after = docs.collect()
    fine = [r for r in before if "idiot" not in toxicity.fold(r.text or "").split()]
    assert docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    assert sorted(map(str, after)) == sorted(map(str, fine))

    docs = stage(corpus_pipeline.drop_copies(spark, docs, inputs), "t")
    best = {}
    for r in after:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        if low not in best or (r.doc_id is not None and (best[low].doc_id is None or r.doc_id > best[low].doc_id)):
            best[low] = r
    assert sorted(map(key, docs.collect())) == sorted(map(key, best.values()))

    before = docs.collect()
    docs = stage(corpus_pipeline.drop_near_copies(spark, docs, inputs), "t")
    labelled = brute([(i, r.text) for i, r in enumerate(before)])  # by place, as ids repeat
    groups = {}
    for i, _, c in labelled:
        groups.setdefault(c, []).append(before[i])
    want = [min(g, key=lambda r: (r.doc_id is None, r.doc_id)) for g in groups.values()]
    assert sorted(map(key, docs.collect())) == sorted(map(key, want))

    labels = spark.read.parquet(f"{inputs}/labels.parquet").select("doc_id", F.col("quality").alias("domain"))
    rates = {key(r): r.rate for r in mixing.mix(docs, labels, corpus_pipeline.QUALITY, corpus_pipeline.MOST_COPIES).join(docs, "doc_id").collect()}
    mixed = stage(corpus_pipeline.mix_to_targets(spark, docs, inputs), "t")
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        times[key(r)] = times.get(key(r), 0) + 1
    for k, rate in rates.items():
        assert abs(times.get(k, 0) - rate) < 1 + 1e-9

    out = corpus_pipeline.tokenise(spark, mixed, inputs).collect()
    assert len(out) == mixed.count() and np.all([r.n_tokens >= 0 for r in out])


def test_run(spark, inputs, sf):
    ids = [r.doc_id for r in corpus_pipeline.run(spark, inputs).collect()]
    assert 100 < len(ids) < 430
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def empty(spark, at, rows=(), labels=(), more=""):
    docs = spark.createDataFrame(rows, SCHEMA + more)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, empty(spark, str(tmp_path / "a"))).count() == 0
    rows = [(i, f"text {i} of some that differ in every word {i}{i}", "en", "s", 1) for i in range(30)]
    assert corpus_pipeline.run(spark, empty(spark, str(tmp_path / "b"), rows)).count() == 30
    assert corpus_pipeline.run(spark, empty(spark, str(tmp_path / "c"), [], [(1, 1, 1)])).count() == 0


def test_long_texts_and_clashing_columns(spark, tmp_path):
    rows = [(i, t, "en", "s", 1, 5, "x", 0.5) for i, t in enumerate(["/a1" * 20_000, "é" * 200_000, " ".join(map(str, range(60_000))), " ".join(map(str, range(60_001))), None, "", "short"])]
    at = empty(spark, str(tmp_path), rows, [(6, 1, 0)], ", uid long, key string, score double")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, at), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "uid", "key", "score"], name
        assert {r.uid for r in docs.collect()} == {5}
    assert {0, 1, 2, 6} <= {r.doc_id for r in docs.collect()} and {4, 5} - {r.doc_id for r in docs.collect()} == {4}
    assert {r.doc_id for r in corpus_pipeline.run(spark, at).collect()} == {0, 1, 2, 5, 6}


def test_leaves_settings_and_folders_as_they_were(spark, inputs):
    from tidemark.llm.common import shared_dir

    def state():
        folder = shared_dir(spark).removeprefix("file:")
        return dict(spark.conf.getAll), {f for f in os.listdir(folder) if f.startswith("tidemark-")}

    settings, folders = state()
    corpus_pipeline.run(spark, inputs).collect()
    after, more = state()
    assert after == settings
    # what the lazy result still reads, and the small tables of links and models
    assert sum(f.startswith("tidemark-pipeline-") for f in more - folders) == 1
    assert not any(f.split("-")[1] in ("sets", "held", "ordered", "segments", "signatures", "lists", "open", "often") for f in more - folders)
