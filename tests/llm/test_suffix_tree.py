import random
import re
from collections import Counter

import pytest

from tidemark.llm.suffix_tree import LEAVES, dealt, suffix_tree_dedup


def brute(rows, window):
    docs = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for doc, w in docs:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def same(spark, rows, window=35, k=10, most=LEAVES):
    docs = spark.createDataFrame([(i, t, 7, 5) for i, t in rows], "doc_id long, text string, at int, uid long")
    assert sorted([tuple(r) for r in suffix_tree_dedup(docs, window, k, most).collect()], key=str) == brute(rows, window)


def test_small_cases(spark):
    a = " ".join(f"a{i}" for i in range(50))
    rows = [(1, a), (2, "x\t\ny " + a[:150] + " z"), (3, None), (4, ""), (5, " \n"), (6, "u " * 40), (7, "v " * 35), (8, "W w " * 30), (None, a), (9, "solo " * 34), (10, "q\x1cr \x85 é" * 20), (10, "q\x1cr \x85 é" * 20), (11, a.upper())]
    same(spark, rows)
    same(spark, [])
    same(spark, [(1, a), (1, a)])


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    pool = [[f"p{p}_{rng.randrange(30)}" for _ in range(40)] for p in range(6)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            words += rng.choice([p, p[a:], [f"n{rng.randrange(10**6)}"], ["ab"] * rng.randrange(15)])
        rows.append((i, " ".join(words)))
    same(spark, rows, window=9, k=3)


@pytest.mark.parametrize("most", [1, 3, 40])
def test_prefixes_grow(spark, most):
    """Prefixes of all four lengths, with texts that share their first words and part later, over batches of a few rows."""
    rng = random.Random(most)
    rows = []
    for i in range(60):
        words = []
        for _ in range(4):
            words += [f"s{j}" for j in range(rng.choice([3, 6, 8, 12]))] + [f"t{rng.randrange(3)}"] * rng.randrange(4)
        rows.append((i, " ".join(words)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same(spark, rows, window=9, k=3, most=most)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_dealt(spark):
    paths = [(a, b, c, d) for a, b, c, d, n in [(1, 1, 1, 1, 9), (1, 1, 1, 2, 1), (1, 1, 2, 1, 2), (1, 2, 1, 1, 2), (2, 1, 1, 1, 3), (3, 1, 1, 1, 1)] for _ in range(n)]
    rows = spark.createDataFrame([(a << 32 | b, c << 32 | d) for a, b, c, d in paths], "k1 long, k2 long")
    found = {(r.k1 >> 32, r.k1 & 0xFFFFFFFF, r.k2 >> 32, r.k2 & 0xFFFFFFFF): r.length for r in dealt(rows, 3).collect()}
    assert found == {(1, 1, 1, 1): 4, (1, 1, 1, 2): 4, (1, 1, 2, 1): 3, (1, 2, 1, 1): 2, (2, 1, 1, 1): 1, (3, 1, 1, 1): 1}
    assert dealt(rows, 3).count() == len(paths)


def test_documents(spark, sf):
    same(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
