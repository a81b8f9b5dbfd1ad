import random
from collections import Counter

import pytest

from tidemark.llm.suffix_array import suffix_array_dedup


def brute(rows, window):
    docs = [(doc, (text or "").encode()) for doc, text in rows]
    seen = Counter(hash(b[i : i + window]) for _, b in docs for i in range(len(b) - window + 1))
    out = []
    for doc, b in docs:
        gone, end = bytearray(len(b)), 0
        for i in range(len(b) - window + 1):
            if seen[hash(b[i : i + window])] > 1:
                for j in range(max(i, end), i + window):
                    gone[j] = 1
                end = i + window
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def same(spark, rows, **sizes):
    docs = spark.createDataFrame([(i, t, 7, 5) for i, t in rows], "doc_id long, text string, at int, uid long")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_array_dedup(docs, **sizes).collect()]
    assert sorted(got, key=str) == brute(rows, sizes.get("window", 400))


def test_small_cases(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh é") for _ in range(900))
    rows = [(1, a), (2, "xy" + a[100:499] + "z"), (3, a[200:602]), (4, None), (5, ""), (6, "u" * 401), (7, "v" * 400), (8, "Ww" * 700), (None, a[300:]), (9, a[:350]), (10, "twice " * 80), (10, "twice " * 80), (11, "q" + a[500:])]
    same(spark, rows)
    same(spark, [])
    same(spark, [(1, a), (1, a)])


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab ") for _ in range(200)) for _ in range(5)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randrange(5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            text += rng.choice([p, p[a:], p[:a], str(rng.randrange(10**6)), "cd" * rng.randrange(40)])
        rows.append((i, text))
    same(spark, rows, window=40, k=8, step=8)
    same(spark, rows, window=41, k=6, step=32)


def test_open_runs_across_batches(spark):
    """Batches of a few rows, so that runs of equal triples go on in the next one."""
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefghij") for _ in range(45))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randrange(9))) + line[rng.randrange(4) :] + rng.choice("mn") * rng.randrange(5)) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same(spark, rows, window=40, k=8, step=8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents(spark, sf):
    same(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
