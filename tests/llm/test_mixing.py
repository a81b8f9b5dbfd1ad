import math
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import common, mixing
from tidemark.llm.queries import TARGETS, domains, op10_mixing

SCHEMA = "doc_id long, text string, rate string, domain int"


def corpus(spark):
    rows = [(i, " ".join(f"{'sun' if i % 4 else 'rain'}{j % 7}" for j in range(20 + i % 9)), "x", 1) for i in range(300)]
    rows += [(None, "sun1 sun2", None, None), (900, None, None, None), (901, "", None, None), (5, rows[5][1], "x", 1), (902, "rain1 " * 5000, None, 0)]
    labels = spark.createDataFrame([(i, "dry" if i % 4 else "wet") for i in range(0, 300, 2)] + [(None, "dry"), (8, None)], "doc_id long, domain string")
    return spark.createDataFrame(rows, SCHEMA), labels


def totals(rows):
    return sum(np.array(r.posterior) * r.rate * r.n_tokens for r in rows)


def test_small_cases(spark):
    docs, labels = corpus(spark)
    rows = mixing.mix(docs, labels, {"dry": 0.3, "wet": 0.7}).collect()
    assert len(rows) == 305 and rows[0].domains == ["dry", "wet"]
    for r in rows:
        assert 0 <= r.rate <= mixing.MOST and abs(sum(r.posterior) - 1) < 1e-9
    right = [r.posterior[0] > 0.5 for r in rows if r.doc_id is not None and r.doc_id < 300] == [bool(r.doc_id % 4) for r in rows if r.doc_id is not None and r.doc_id < 300]
    assert right
    all_words = sum(r.n_tokens for r in rows)
    assert np.allclose(totals(rows), [0.3 * all_words, 0.7 * all_words], rtol=2e-3)
    assert {r.n_tokens for r in rows if r.doc_id in (900, 901)} == {0}
    none = mixing.mix(docs, labels.limit(0), {"dry": 1.0}).collect()
    assert {tuple(r.posterior) for r in none} == {(1.0,)} and {r.rate for r in none} == {1.0}
    assert mixing.mix(docs.limit(0), labels, {"dry": 1.0}).count() == 0


def test_steps_are_those_of_plain_projected_gradient(spark):
    rng = np.random.default_rng(0)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 200), rng.integers(1, 90, 200)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "n_tokens long, posterior array<double>")
    steps, left = mixing.fit_rates(members, [0.7, 0.2, 0.1], most=2.0)
    assert len(left) == 3
    rate = np.ones(200)
    for s in steps:
        rate = np.clip(rate - p @ s, 0, 2.0)
    got = [r[0] for r in members.select(mixing.rate_of(F.col("posterior"), steps, 2.0)).collect()]
    assert np.allclose(got, rate)
    want = np.array([0.7, 0.2, 0.1]) * t.sum()
    assert np.abs((rate * t) @ p / want - 1).max() < 2e-3 or len(steps) == mixing.STEPS


def test_resample_keeps_columns(spark):
    docs, labels = corpus(spark)
    out = mixing.resample(docs, labels, {"dry": 0.3, "wet": 0.7})
    assert out.columns == docs.columns
    by = {r.doc_id: r.rate for r in mixing.mix(docs, labels, {"dry": 0.3, "wet": 0.7}).collect()}
    for r in out.groupBy("doc_id").count().collect():
        if r.doc_id is not None and r.doc_id != 5:
            assert abs(r["count"] - by[r.doc_id]) < 1
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.resample(docs, labels, {"dry": 0.3, "wet": 0.7}).collect()))


def test_fit_reads_one_row_of_each_id(spark, monkeypatch):
    sizes, stage = {}, mixing.stage

    def counted(df, name):
        out = stage(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(mixing, "stage", counted)
    docs = spark.createDataFrame([(i, f"text {i % 3} of many") for i in range(90)] + [(i, f"repeat {j}") for i in (4, 12) for j in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "doc_id long, domain string")
    mixing.train(docs, labels, 50)
    assert 0 < sizes["mixing"] <= 50


MASK = 2**64 - 1


def plain_hash(word):
    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
        return x ^ (x >> 31)

    base = int(common._BASE)
    return mixed((sum(int(common._BYTE[b]) * pow(base, i, 2**64) for i, b in enumerate(word)) + len(word)) & MASK)


def plain_posterior(model, text):
    """Word counts, measures and softmax by loops over one text."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b | 32 if 65 <= b <= 90 else b for b in data))
    size, n = max(len(data), 1), len(words)
    letter, digit, blank = (lambda b: 97 <= b | 32 <= 122), (lambda b: 48 <= b <= 57), (lambda b: b == 32 or 9 <= b <= 13)
    share = lambda test: sum(map(test, data)) / size
    other = lambda b: not (letter(b) or digit(b) or blank(b)) and b < 128
    x = [math.log1p(n), math.log1p(size / max(n, 1)), share(lambda b: 65 <= b <= 90), share(digit), share(other), share(lambda b: b == 10)]
    x += [sum(model.table[plain_hash(w) % mixing.BUCKETS][d] for w in words) / max(n, 1) for d in range(len(model.domains))]
    row = [1.0] + [(v - c) / s for v, c, s in zip(x, model.centre, model.scale, strict=True)]
    z = [sum(v * w[d] for v, w in zip(row, model.weights, strict=True)) for d in range(len(model.domains))]
    e = [math.exp(v - max(z)) for v in z]
    return n, [v / sum(e) for v in e]


def test_posteriors_match_plain_loops(spark, sf):
    at = "/root/testdata/sf0.01"
    model = mixing.train(spark.read.parquet(f"{at}/documents.parquet"), domains(spark.read.parquet(f"{at}/labels.parquet")))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(150)
    docs = docs.union(spark.createDataFrame([(None, None), (-1, ""), (-2, "é" * 100_000), (-3, "a1 B " * 30_000)], "doc_id long, text string"))
    for r in mixing.scored(docs, model, "text").collect():
        n, p = plain_posterior(model, r.text)
        assert n == r.n_tokens and np.allclose(p, r.posterior, atol=1e-9), r.doc_id


def test_targets_out_of_reach_leave_a_residual(spark):
    docs = spark.createDataFrame([(i, f"alpha{i % 7} beta gamma" if i % 50 else "delta epsilon zeta") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "rare" if i % 50 == 0 else "common") for i in range(400)], "doc_id long, domain string")
    (left,) = {tuple(r.residual) for r in mixing.mix(docs, labels, {"rare": 0.9, "common": 0.1}, 2.0).collect()}
    assert max(map(abs, left)) > 0.5


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    labels = domains(spark.read.parquet(f"{at}/labels.parquet"))
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = mixing.train(docs, labels.where("doc_id % 4 <> 0"))
    rows = docs.join(labels.where("doc_id % 4 = 0"), "doc_id").select("domain", "text")
    rows = mixing.scored(rows, model, "text").collect()
    right = np.mean([model.domains[int(np.argmax(r.posterior))] == r.domain for r in rows])
    base = max(np.mean([r.domain == d for r in rows]) for d in model.domains)
    print("accuracy", right, "largest domain", base)
    assert right >= base + 0.03
    rows = op10_mixing(spark, at).collect()
    got = totals(rows) / sum(r.n_tokens for r in rows)
    print(dict(zip(rows[0].domains, got.tolist(), strict=True)))
    assert np.allclose(got, [TARGETS[d] for d in rows[0].domains], rtol=0.05)
