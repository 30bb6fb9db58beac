"""Approximate neighbours and whitening against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from saidso.llm import ann, queries, whitening

TABLE = "vec_id long, embedding array<float>, label int, leaf string"


def exact_neighbours(rows, asked, k):
    out = {}
    for q, x in asked:
        scores = [(-float(np.sum(np.array(x, float) * np.array(y, float))), v) for v, y in rows if v != q and len(x) == len(y)]
        out[q] = [(v, -s) for s, v in sorted(scores)[:k]]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("longest", [1.0, 5.0])
def test_forest_finds_most_neighbours(spark, monkeypatch, longest):
    monkeypatch.setattr(ann.fit, "__defaults__", (1 << 12, 64))
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(30, 24))
    points = centres[draw.integers(0, 30, 6000)] + 0.3 * draw.normal(size=(6000, 24))
    points[2000:4000] = points[7]  # a third of all rows are one vector
    points *= draw.uniform(1, longest, (6000, 1)) / np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame([(i, p, 0, "x") for i, p in rows], TABLE)
    got = grouped(ann.nearest(df, df.where("vec_id % 100 = 0"), 20))
    want = exact_neighbours(rows, rows[::100], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    values = dict(rows)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(float(np.dot(np.array(values[q]), np.array(values[v]))), abs=1e-12) for v, s in found)


def test_neighbours_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, -0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [2.0, 0.0, 0.0]), (None, [1.0, 1.0]), (10, [-1.0, 0.5]), (11, [1.0, -0.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], TABLE)
    got = grouped(ann.nearest(df, df, 20))
    assert got == {1: [(2, 1.0), (11, 1.0), (10, -1.0)], 2: [(1, 1.0), (11, 1.0), (10, -1.0)], 10: [(1, -1.0), (2, -1.0), (11, -1.0)], 11: [(1, 1.0), (2, 1.0), (10, -1.0)]}
    assert grouped(ann.nearest(df, df, 1))[1] == [(2, 1.0)]
    empty = df.limit(0)
    assert ann.nearest(empty, df, 20).count() == 0 and ann.nearest(df, empty, 20).count() == 0


def test_op11_recall_on_the_driver_tables(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = exact_neighbours(table, [r for r in table if r.vec_id % 20 == 0], 20)
    got = grouped(queries.op11_approximate_neighbours(spark, sf))
    assert got.keys() == want.keys() and recall(got, want) >= 0.9


def plain_whitening(rows):
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, [int(t) for t in total], e[::-1], u[:, ::-1]


def test_op12_equals_dense_solver(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    kept, n, total, e, u = plain_whitening(rows)
    got = queries.op12_embedding_whitening(spark, sf).collect()
    assert len(got) == 4 * len(kept)
    vectors, signs = dict(kept), {}
    for r in got:
        x, c = vectors[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, total))
        want = (np.array(x) - np.array(total) / n) @ u[:, c] / np.sqrt(e[c])
        if abs(want) > 1e-6:
            assert signs.setdefault(c, np.sign(want) * np.sign(r.whitened)) == np.sign(want) * np.sign(r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-9)
        assert r.explained == pytest.approx(e[c] / e.sum(), rel=1e-10) and 0 <= r.identity_error < 1e-9


def test_whitening_of_awkward_rows(spark):
    nan = float("nan")
    rows = [(1, [0.1, -0.1]), (1, [0.1, -0.1]), (2, [0.5, 0.25]), (3, [-1.0, 1.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1e5, -1e5])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, component int, n string")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert {r.n for r in got} == {4}
    big = 256 * 10**5
    xs = [(25, -26), (128, 64), (-256, 256), (big, -big)]
    total = [sum(c) for c in zip(*xs)]
    assert {int(r.deviation) for r in got if r.vec_id == 2} == {sum((4 * a - s) ** 2 for a, s in zip(xs[1], total))}
    huge = df.unionByName(df.where("vec_id = 1").withColumn("embedding", F.expr("array(1e300D, -1e300D)")))
    assert {r.n for r in whitening.whiten(huge).collect()} == {5} and {r.deviation for r in whitening.whiten(huge).collect()} == {None}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    assert whitening.whiten(line.limit(1)).count() == 0 and whitening.whiten(df.limit(0)).count() == 0


def test_slices_count_and_number_eigenvalues():
    draw = np.random.default_rng(0)
    for size in (1, 2, 3, 17, 40):
        a = draw.normal(size=(size, size))
        v = a @ a.T
        e = np.linalg.eigvalsh(v)[::-1]
        for shift in [*(e[:-1] + e[1:]) / 2, 0.0, e[0] + 1]:
            assert whitening.above(v, shift) == (e > shift).sum()
        values, vectors = whitening.leading(v, 4)
        assert np.allclose(np.array(values, float), e[:4], rtol=1e-11)
        assert all(np.abs(v @ u - x * u).max() < 1e-14 * e[0] for x, u in zip(values, vectors))
    same, vectors = whitening.leading(np.diag([5.0, 5, 5, 2, 0]), 4)
    assert np.allclose(np.array(same, float), [5, 5, 5, 2]) and np.allclose(np.array(vectors, float) @ np.array(vectors, float).T, np.eye(4), atol=1e-15)
    assert whitening.leading(np.zeros((3, 3)), 4) == ([], [])
