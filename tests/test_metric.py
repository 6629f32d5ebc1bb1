"""Neighbours by pivots against brute force, with pieces and blocks of a few rows."""

import numpy as np
import pytest

from pointloom.operators import metric, neighbors


@pytest.fixture
def small(monkeypatch):
    for name, n in (("PIECE_ROWS", 16), ("QUERY_ROWS", 24), ("MATRIX", 300)):
        monkeypatch.setattr(metric, name, n)


def clusters(r, n, dims):
    centres = r.normal(size=(6, dims)) * 20
    v = centres[r.integers(0, 6, n)] + r.normal(size=(n, dims))
    v[3] = v[4] = v[5]  # equal vectors
    return np.round(v, 3)


@pytest.mark.parametrize("k", [1, 3, 40])
def test_knn(spark, small, k):
    v = clusters(np.random.default_rng(k), 150, 12)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12)], "id long, v array<double>")
    got = {}
    for r in neighbors.knn(df, df, k, "v", "id", "id").orderBy("a_id", "rank").collect():
        got.setdefault(r["a_id"], []).append((r["b_id"], r["d2"]))
    d = metric.squared(v, v)
    for i in range(150):
        order = sorted((d[i, j], j) for j in range(150) if j != i)[:k]
        assert [b for b, _ in got[i]] == [j for _, j in order] and [x for _, x in got[i]] == [x for x, _ in order]
    assert set(got) == set(range(150))


def test_queries_apart_from_rows_and_too_few_rows(spark, small):
    r = np.random.default_rng(8)
    rows, queries = r.normal(size=(5, 4)), r.normal(size=(30, 4)) * 3
    a, b = (spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>") for v in (queries, rows))
    got = {(x["a_id"], x["b_id"]) for x in neighbors.knn(a, b, 9, "v", "id", "id", skip_self=False).collect()}
    assert got == {(i, j) for i in range(30) for j in range(5)}
    assert neighbors.knn(a, b.limit(0), 3, "v", "id", "id").count() == 0 and neighbors.knn(a.limit(0), b, 3, "v", "id", "id").count() == 0


def test_bounds_leave_most_cells_of_clustered_rows(spark):
    v = clusters(np.random.default_rng(2), 4000, 12)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    r, pivots, radii, sizes = metric.indexed(df, "id", {"v": "v"}, "v")
    near = metric.cells_within(r.select("id", "v"), "v", pivots, radii, 3.0, sizes > 0)
    met = sum(len(x["cells"]) for x in near.select("cells").collect())
    assert met < 0.5 * len(v) * (sizes > 0).sum()
    d = metric.squared(v[:200], v)
    cell = {x["id"]: x["cell"] for x in r.select("id", "cell").collect()}
    cells = {x["id"]: set(x["cells"]) for x in near.filter("id < 200").select("id", "cells").collect()}
    assert all(cell[j] in cells[i] for i in range(200) for j in np.flatnonzero(d[i] <= 9))


def test_gates(spark, small):
    r = np.random.default_rng(5)
    p, a = np.round(r.normal(size=(120, 3)), 3), r.normal(size=(120, 3))
    a[7] = 0
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(p, a))], "id long, p array<double>, a array<double>")
    got = {}
    for x in neighbors.gated_neighbors(df, "p", "a", "id", far=1.2, degrees=60.0, most=4).orderBy("a_id", "rank").collect():
        got.setdefault(x["a_id"], []).append(x["b_id"])
    want = {}
    for i in range(120):
        found = []
        for j in range(120):
            d = np.sqrt(((p[i] - p[j]) ** 2).sum())
            n = np.linalg.norm(a[i]) * np.linalg.norm(a[j])
            if i != j and n and 0.01 < d < 1.2 and np.degrees(np.arccos(a[i] @ a[j] / n)) < 60:
                found.append((d, j))
        if found:
            want[i] = [j for _, j in sorted(found)[:4]]
    assert got == want and 7 not in got
