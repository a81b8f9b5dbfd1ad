import math

import numpy as np
import pytest

from tidemark.llm.multi_index import Cells, cells_in_order, multi_index

SCHEMA = "vec_id long, embedding array<float>, rep long, cell string"


def brute(rows, every=50, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q, v in good.items():
        if q % every == 0:
            near = [(-float(v @ w) / (math.sqrt(v @ v) * math.sqrt(w @ w)), i) for i, w in good.items() if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def test_walk_is_in_order():
    rng = np.random.default_rng(1)
    left, right = rng.random(9), rng.random(7)
    held = np.array([c for c in reversed(range(63)) if c % 5 and not 14 <= c < 21])
    cells = Cells(held, np.arange(len(held)) % 3 + 1, 7, 4)
    want = sorted(cells.id.tolist(), key=lambda c: left[c // 7] + right[c % 7])
    assert [int(cells.id[i]) for i in cells_in_order(left, right, cells, 10**9)] == want
    size, have, some = dict(zip(cells.id.tolist(), cells.size.tolist(), strict=True)), 0, 0
    while have < 20:
        have, some = have + size[want[some]], some + 1
    assert [int(cells.id[i]) for i in cells_in_order(left, right, cells, 20)] == want[:some]
    for at in range(int(cells.block.max()) + 1):
        assert cells.size[(cells.block == at) & (cells.split == 1)].sum() <= 4


def test_small_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(6)]) for i in range(120)]
    same = [1.0, 2.0, 0.0, 0.0, 1.0, 0.5]
    rows += [(i, same) for i in range(200, 420)]
    rows += [(500, None), (550, [0.0] * 6), (600, [1.0, float("nan")] * 3), (650, [None, 1.0] * 3), (700, [1.0, float("inf")] * 3), (None, same), (750, []), (800, [1.0, 2.0]), (801, [2.0, 1.0]), (50, rows[50][1])]
    got, want = found(multi_index(frame(spark, rows), share=1.0)), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got[q], want[q], strict=True))
    assert multi_index(frame(spark, [])).count() == 0
    assert multi_index(frame(spark, [(0, [1.0, 1.0])])).count() == 0


def recall(df):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    got, hits, total = found(multi_index(df)), 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        hits += len(set(ids[np.argsort(-s)[:5]].tolist()) & {i for i, _ in got[ids[q]]})
        total += 5
    return hits / total


def test_recall_on_the_test_table(spark):
    assert recall(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")) >= 0.9


@pytest.mark.parametrize("groups", [0, 60])
def test_recall_on_made_vectors(spark, groups):
    """Vectors without any structure, and vectors in groups."""
    rng = np.random.default_rng(groups)
    x = rng.standard_normal((6_000, 64))
    if groups:
        x = 0.4 * x + rng.standard_normal((groups, 64))[rng.integers(0, groups, len(x))]
    assert recall(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])) >= 0.9
