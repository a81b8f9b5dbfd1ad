import math

import numpy as np
import pytest

from tidemark.llm import hard_negatives as mining
from tidemark.llm.exact_topk import exact_top_k, histogram
from tidemark.llm.hard_negatives import Keys, hard_negatives
from tidemark.llm.vectors import NONE, Best, scores

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 7, None) for i, v, label in rows], SCHEMA)


def usable(rows, labelled=False):
    out = {}
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and not (labelled and label is None):
            row = ([math.floor(256 * float(np.float32(x))) for x in v], label)
            out[i] = min(out.get(i, row), row)
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, every, k):
    have = usable(rows)
    return {(q, n + 1, i, -s) for q, (v, _) in have.items() if q % every == 0 for n, (s, i) in enumerate(sorted((-product(v, w), i) for i, (w, _) in have.items() if i != q)[:k])}


def brute_negatives(rows, every, positives, negatives):
    have, out = usable(rows, True), set()
    for a, (v, label) in have.items():
        if a % every == 0:
            found = sorted((-product(v, w), i, other) for i, (w, other) in have.items() if i != a)
            for s, p, _ in [x for x in found if x[2] == label][:positives]:
                fits = [(t, i) for t, i, other in found if other != label and 30 * -s <= 100 * -t <= 90 * -s]
                out |= {(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fits[:negatives])}
    return out


def messy(seed, n=400, size=6):
    """Vectors with nulls, repeated ids and rows, many ties, other lengths and one vector that a third of the rows share."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size) / 2], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(i, [1.0] * size, i % 3) for i in range(1000, 1000 + n // 2)]
    rows += rows[:5] + [(3, [9.0] * size, 1), (50, [0.5] * size, 2), (100, [0.5] * size, 2)]
    rows += [(2000, None, 1), (2050, [None] + [1.0] * 5, 1), (2100, [float("nan")] * size, 1), (2150, [float("inf")] * size, 1), (None, [1.0] * size, 1), (2200, [1.0] * size, None), (2250, [], 1), (2300, [2.0, 1.0], 1), (2301, [0.0] * size, 0), (2350, [1.0] * 40, 0)]
    return rows


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_top_k_equals_brute_force(spark, bins):
    rows = messy(bins)
    got = [tuple(r) for r in exact_top_k(frame(spark, rows), 50, 5, bins=bins).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_top(rows, 50, 5)


def test_top_k_of_few_rows(spark):
    for rows in ([], [(0, [1.0, 2.0], 1)], [(0, None, 1)], [(0, [1.0], 1), (50, [2.0], 1), (7, [3.0], 1)], [(1, [1.0], 1)]):
        assert {tuple(r) for r in exact_top_k(frame(spark, rows)).collect()} == brute_top(rows, 50, 5)


def test_too_long_vectors_are_an_error(spark):
    with pytest.raises(Exception, match="too long"):
        exact_top_k(frame(spark, [(0, [1e9, 1.0], 1), (1, [1.0, 1.0], 1)])).collect()


def test_long_vectors_stay_exact():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(2**26), 2**26, (5, 4)), rng.integers(-(2**26), 2**26, (6, 3))
    assert scores(a, b).tolist() == [[product(x, y) for y in b.tolist()] for x in a.tolist()]


def test_histogram_counts_down_to_the_value_looked_for():
    rng = np.random.default_rng(4)
    score, low, high, left = rng.integers(-50, 50, (8, 200)), np.full(8, -40), np.full(8, 35), np.arange(1, 9)
    score[0, :100] = NONE
    row, at, count = histogram(score, low, high, left, 10)
    for i in range(8):
        inside = sorted((s for s in score[i].tolist() if -40 <= s < 35), reverse=True)
        least = (inside[left[i] - 1] + 40) // 8
        want = {b: sum((s + 40) // 8 == b for s in inside) for b in range(least, 10)}
        assert dict(zip(at[row == i].tolist(), count[row == i].tolist(), strict=True)) == {b: n for b, n in want.items() if n}


def test_best_keeps_the_first_of_each_window():
    rng = np.random.default_rng(5)
    best, want = Best(3, 2), {}
    for _ in range(20):
        names, slot, ids = rng.integers(0, 4, 5), rng.integers(0, 2, 5), rng.permutation(1000)[:30]
        keys = dict.fromkeys(zip(names.tolist(), slot.tolist(), strict=True))
        names, slot = np.array([k[0] for k in keys]), np.array([k[1] for k in keys])
        score = rng.integers(0, 9, (len(names), 30))
        best.add(names, slot, score, ids)
        for i, k in enumerate(keys):
            want.setdefault(k, []).extend((-s, j) for s, j in zip(score[i].tolist(), ids.tolist(), strict=True))
    out = best.rows()
    got = {}
    for n, s, i, v in zip(*(out[c].tolist() for c in ("name", "slot", "vec_id", "score")), strict=True):
        got.setdefault((n, s), []).append((-v, i))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:3] for k, v in want.items()}


@pytest.mark.parametrize("piece", [16, 4096])
def test_negatives_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(mining, "PIECE", piece)
    rows = messy(piece)
    got = [tuple(r) for r in hard_negatives(frame(spark, rows), 50, 5, 10).collect()]
    want = brute_negatives(rows, 50, 5, 10)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_negatives_of_few_rows(spark):
    for rows in ([], [(0, [1.0, 2.0], 1)], [(0, None, 1), (1, [1.0], None)], [(0, [2.0], 1), (1, [2.0], 1), (2, [1.0], 0)], [(1, [2.0], 1), (2, [1.0], 0)]):
        assert {tuple(r) for r in hard_negatives(frame(spark, rows)).collect()} == brute_negatives(rows, 100, 5, 10)


def test_bounds_hold_for_every_row():
    """No score lies outside the bounds that an annulus gives, and clustered rows leave annuli closed."""
    import pandas as pd

    rng = np.random.default_rng(6)
    centres = rng.standard_normal((8, 16)) * 100
    x = np.floor(centres[rng.integers(0, 8, 600)] + rng.standard_normal((600, 16)) * 5).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(1).max())
    lifted = np.column_stack([centres, np.sqrt(np.maximum(most - (centres**2).sum(1), 0))])
    keys = Keys(lifted, most)
    far = keys.distances(x, True)
    place = pd.DataFrame({"annulus": far.argmin(1), "distance": far.min(1)})
    annuli = place.groupby("annulus").distance.agg(["count", "min", "max"]).reset_index()
    annuli.columns = ["annulus", "rows", "least", "largest"]
    keys.scanned(annuli.assign(pieces=1), 1)
    _, low, high = keys.bounds(x[:50])
    score, at = x[:50] @ x.T, np.searchsorted(keys.id, place.annulus)
    assert (score >= low[:, at]).all() and (score <= high[:, at]).all()
    fifth = np.sort(score, axis=1)[:, -6]
    assert (high < fifth[:, None]).mean() > 0.5


def test_grouped_vectors_in_many_annuli(spark, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(mining, "PIECE", 64)
    centres = rng.standard_normal((20, 12))
    rows = [(i, (centres[i % 20] + 0.05 * rng.standard_normal(12)).tolist(), i % 3) for i in range(4000)]
    got = {tuple(r) for r in hard_negatives(frame(spark, rows), 500, 5, 10).collect()}
    assert got == brute_negatives(rows, 500, 5, 10)
