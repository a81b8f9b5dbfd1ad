import random
import re
from collections import defaultdict

import pytest

from tidemark.llm.components import components
from tidemark.llm.ngram_join import _beyond, _looked_at, ngram_join


def brute(rows, k=5, per_cent=80):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    holds = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holds[x] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= per_cent * len(s | sets[j]):
                up[top(i)] = top(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(i)] = min(low.get(top(i), doc), doc)
    return sorted(((doc, len(s), low.get(top(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def same(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n int, cid string")
    assert sorted([tuple(r)[:3] for r in ngram_join(docs, **kw).collect()], key=str) == brute(rows)


def test_small_cases(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (3, base.upper()), (9, base + " more"), (1, base.replace("w30", "v")), (2, base.replace("w30", "v").replace("w10", "u").replace("w50", "t")), (4, None), (6, ""), (7, " \t\n"), (8, "a b"), (10, "A  b"), (11, "b a"), (None, base), (12, "one two three four five"), (12, "something else in a repeated id here"), (13, "x y \x1cz")]
    same(spark, rows)
    same(spark, [])
    same(spark, [(None, "a b c"), (None, "a b c"), (None, None)])


@pytest.mark.parametrize("stars", [0, 1, 6])
def test_random_near_copies(spark, stars):
    rng = random.Random(3)
    rows = []
    for g in range(6):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(90)]
        for _ in range(40):
            copy = words[:]
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(9)}"
            rows.append((len(rows) * 7 % 1000, " ".join(copy[: rng.randrange(80, 91)])))
    same(spark, rows, stars=max(stars, 1) if stars else 1)


def least_overlap(a, b, per_cent):
    return -(-per_cent * (a + b) // (100 + per_cent))


@pytest.mark.parametrize("per_cent", [50, 80, 90])
def test_first_filter_keeps_every_size_pair(per_cent):
    """Private shingles first in both sets, or in one of them only."""
    for a in range(1, 61):
        for b in range(-(-per_cent * a // 100), a + 1):
            o = least_overlap(a, b, per_cent)
            for before_a in (0, a - o):
                for before_b in (0, b - o):
                    x = [("a", i) for i in range(before_a)] + list(range(o)) + [("a", -i) for i in range(1, a - o - before_a + 1)]
                    y = [("b", i) for i in range(before_b)] + list(range(o)) + [("b", -i) for i in range(1, b - o - before_b + 1)]
                    assert len(x) == a and len(y) == b and 100 * o >= per_cent * len({*x, *y})
                    both = set(x[: _looked_at(a, per_cent)]) & set(y[: _looked_at(b, per_cent)])
                    assert len(both) > _beyond(a, per_cent) and len(both) > _beyond(b, per_cent), (a, b)


def test_links_of_every_size_pair(spark):
    rows = []
    for a in range(1, 61):
        for b in range(-(-80 * a // 100), a + 1):
            o = least_overlap(a, b, 80)
            shared = [f"s{a}.{b}.{i}" for i in range(o + 4)]
            rows.append((len(rows), " ".join([f"x{a}.{b}.{i}" for i in range(a - o)] + shared)))
            rows.append((len(rows), " ".join(shared + [f"y{a}.{b}.{i}" for i in range(b - o)])))
    assert all(low == doc - doc % 2 for doc, _, low in brute(rows))
    same(spark, rows)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(spark, rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 40), (60, 40), (70, 70), (60, 61)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 40 for i in (40, 50, 60, 61)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
