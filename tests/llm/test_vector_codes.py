import math

import numpy as np
import pytest

from tidemark.llm.vector_codes import Codebook, codebooks_sha256, hex_code, levels, nearest, vector_codes, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, of int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 1) for i, v, label in rows], SCHEMA)


def brute(rows, parts, entries, rounds):
    kept = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda w, book: min((far(w, e), n) for n, e in enumerate(book))
    for _ in range(rounds):
        groups = {}
        for _, _, v in kept:
            for p in range(parts):
                groups.setdefault((p, best(cut(v, p), books[p])[1]), []).append(cut(v, p))
        for (p, n), ws in groups.items():
            books[p][n] = [sum(c) // len(ws) for c in zip(*ws, strict=True)]
    coded = [(i, label, [best(cut(v, p), books[p]) for p in range(parts)]) for i, label, v in kept]
    total = {}
    for _, label, found in coded:
        total[label] = total.get(label, 0) + sum(d for d, _ in found)
    return books, sorted(((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), total[label]) for i, label, found in coded), key=str)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 8])
def test_nearest_equals_all_distances(size):
    rng = np.random.default_rng(size)
    for spread in (2, 50, 10**6):
        x, entries = rng.integers(-spread, spread, (300, size)), rng.integers(-spread, spread, (64, size))
        entries[40] = entries[3]
        far = ((x[:, None] - entries) ** 2).sum(2)
        at, least, exact = nearest(x, Codebook(entries))
        assert (at == far.argmin(1)).all() and (least == far.min(1)).all()
        if size in (4, 8) and spread > 2:
            assert exact < {4: 0.4, 8: 0.6}[size] * far.size  # what the bounds leave


def test_levels_are_coarse_to_fine():
    assert [levels(n) for n in (1, 2, 3, 4, 8, 12)] == [[], [1], [1], [1, 2], [1, 2, 4], [1, 2, 4]]


@pytest.mark.parametrize("size", [32, 64])
def test_codes_equal_brute_force(spark, size):
    rng = np.random.default_rng(size)
    rows = [(int(i), [float(np.float32(x)) for x in rng.standard_normal(size) / 4], [None, 0, 1, 2][i % 4]) for i in rng.permutation(150)]
    rows += [(200 + i, [0.25] * size, 1) for i in range(60)] + rows[:3] + [(5, [0.0] * size, 2), (None, [0.5] * size, 3)]
    rows += [(300, None, 1), (301, [None] * size, 1), (302, [float("nan")] * size, 1), (303, [float("-inf")] * size, None), (304, [], None)][:-1]
    codes, books = vector_codes(frame(spark, rows), 16, 64, 2)
    want_books, want = brute(rows, 16, 64, 2)
    assert [b.tolist() for b in books] == want_books
    got = sorted((tuple(r) for r in with_label_error(hex_code(codes)).select("vec_id", "code", "error", "label_error").collect()), key=str)
    assert got == want
    assert len(codebooks_sha256(books)) == 64


def test_few_and_no_rows(spark):
    codes, books = vector_codes(frame(spark, []))
    assert with_label_error(hex_code(codes)).count() == 0 and books == []
    rows = [(7, [0.5] * 16, None), (3, [-0.25] * 16, None)]
    codes, books = vector_codes(frame(spark, rows))
    assert sorted(tuple(r) for r in with_label_error(hex_code(codes)).select("vec_id", "code", "error", "label_error").collect()) == brute(rows, 16, 64, 2)[1]
    assert codes.drop("label").count() == 2


def test_lengths_that_differ_are_an_error(spark):
    with pytest.raises(ValueError, match="differ"):
        vector_codes(frame(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)]))
    with pytest.raises(ValueError, match="divide"):
        vector_codes(frame(spark, [(1, [1.0] * 17, 1)]))
    with pytest.raises(Exception, match="differ"):
        vector_codes(frame(spark, [(i, [1.0] * 16, 1) for i in range(64)] + [(99, [1.0] * 32, 1)]))
