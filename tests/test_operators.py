import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import graph, lifecycle, metrics, neighbors, order, raster, reliability, select, state


def cloud(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "pid long, x double, y double, z double")


def brute_knn(points, k):
    out = {}
    for i, p in enumerate(points):
        d = sorted((float(((p - q) ** 2).sum()), j) for j, q in enumerate(points) if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


@pytest.mark.parametrize("n", [1, 2, 4, 200])
def test_knn_grid_is_brute_force(spark, n):
    points = np.random.default_rng(n).uniform(-1, 1, size=(n, 3))
    if n > 4:
        points[5] = points[6]
    got = {}
    for r in neighbors.knn_grid(cloud(spark, points), 3, 0.2).orderBy("a_id", "rank").collect():
        got.setdefault(r["a_id"], []).append(r["b_id"])
    assert got == {i: v for i, v in brute_knn(points, 3).items() if v}


def test_block_knn_and_mean(spark):
    points = np.random.default_rng(0).normal(size=(60, 8))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    near = neighbors.knn(df, df, 3, "v", "id", "id")
    got = {}
    for r in near.orderBy("a_id", "rank").collect():
        got.setdefault(r["a_id"], []).append(r["b_id"])
    assert got == brute_knn(points, 3)
    few = neighbors.mean_nearest(neighbors.knn(df.limit(2), df.limit(2), 3, "v", "id", "id"))
    assert all(r["mean_d2"] is None for r in few.collect())


def test_radius_includes_self_and_far_cells(spark):
    points = [(0, 0, 0), (0.3, 0, 0), (-0.3, 0, 0), (5, 5, 5), (0, 0, 0)]
    p = cloud(spark, points)
    got = {(r["a_id"], r["b_id"]) for r in neighbors.radius_pairs(p, p, 0.3).collect()}
    want = {(i, j) for i, a in enumerate(points) for j, b in enumerate(points) if math.dist(a, b) <= 0.3}
    assert got == want


def test_gates(spark):
    places = [(0.0, 1.0), (1.0, 1.0), (1.5, 1.0), (0.5, -1.0), (0.0, 1.0), (0.2, 0.0)]
    rows = [(i, [x, 0.0, 0.0], [0.0, 0.0, z]) for i, (x, z) in enumerate(places)]
    df = spark.createDataFrame(rows, "cid long, c array<double>, a array<double>")
    got = [(r["b_id"], r["rank"]) for r in neighbors.gated_neighbors(df, "c", "a", "cid").filter("a_id = 0").collect()]
    assert got == [(1, 1)]  # 2 is at 1.5 exactly, 3 looks away, 4 coincides, 5 has no axis


def test_quantiles_with_ties_and_nan(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 2, 3, 4, 5, 100)], "v double")
    flags = [r["flag"] for r in select.dual_end_flag(df, "v", ceiling=1.5).orderBy("v").collect()]
    assert flags == [True] + [False] * 6 + [True]
    assert sorted(r["v"] for r in select.budget_select(df, "v", 2.0, cap=2).collect()) == [5.0, 100.0]
    assert select.budget_select(df, "v", 2.0, cap=100).count() == 7
    assert select.budget_select(df, "v", 2.0, cap=0).count() == 0
    with pytest.raises(ValueError):
        select.budget_select(df, "v", 2.0, cap=1, current=2)
    picks = {r["fraction"]: r["v"] for r in select.rank_pick(df, "v", [0.0, 0.5, 1.0], "v").collect()}
    assert picks == {0.0: 1.0, 0.5: 3.0, 1.0: 100.0}
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert nan.filter(select.above_plane([F.col("v"), F.lit(0.0), F.lit(0.0)], [1, 0, 0, 0])).count() == 1


def test_codebook_is_nearest_rank(spark):
    values = [3.0, 1.0, 2.0, 2.0, 10.0]
    got = {r["level"]: r["value"] for r in select.quantile_codebook(spark.createDataFrame([(v,) for v in values], "v double"), "v", 9).collect()}
    s = sorted(values)
    for level in range(9):
        place = level / 8 * 4
        assert got[level] in {s[math.floor(place + 0.5)], s[math.ceil(place - 0.5)]}


def test_holdout(spark):
    df = spark.createDataFrame([(f"n{i:03}",) for i in np.random.default_rng(0).permutation(50)], "name string")
    assert sorted(r["name"] for r in select.holdout(df, "name").filter("held_out").collect()) == [f"n{i:03}" for i in range(0, 50, 8)]


def test_polygon_and_faces(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5), (2.0, 0.5, 0.5), (0.5, 0.5, 9.0)], "x double, y double, z double")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert df.filter(select.in_polygon_volume([F.col(c) for c in "xyz"], square, 2, 0.0, 1.0)).count() == 1
    faces = spark.createDataFrame([(0, 1, 2, 3), (1, 2, 3, 4)], "fid int, v0 int, v1 int, v2 int")
    assert [r["fid"] for r in select.faces_of(faces, spark.createDataFrame([(1,), (2,), (3,)], "vid int")).collect()] == [0]


def sequential(alphas, colours, background):
    t, c, last, first = 1.0, 0.0, 0, None
    for i, (a, v) in enumerate(zip(alphas, colours), 1):
        if a < 1 / 255:
            continue
        if t * (1 - a) < 1e-4:
            break
        c += v * a * t
        t *= 1 - a
        last, first = i, first or i
    return c + t * background, t, last, min(first, 128) if first else None


def test_compositing_is_the_sequential_loop(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for pixel in range(40):
        n = int(rng.integers(1, 60))
        alphas = np.minimum(0.99, rng.choice([0.001, 0.1, 0.5, 0.999], n))
        colours = rng.uniform(size=n)
        rows += [(pixel, 1.0, i, float(a), float(c)) for i, (a, c) in enumerate(zip(alphas, colours))]
        want[pixel] = sequential(alphas, colours, 0.25)
    df = spark.createDataFrame(rows, "pixel int, depth double, gid int, alpha double, c double")
    got = {r["pixel"]: r for r in raster.composite(df, ["pixel"], ["depth", "gid"], ["c"], background=0.25).collect()}
    for p, (c, t, last, first) in want.items():
        if first is None:
            assert p not in got
            continue
        assert math.isclose(got[p]["c"], c, rel_tol=1e-9) and math.isclose(got[p]["t_final"], t, rel_tol=1e-9)
        assert (got[p]["n_contrib"], got[p]["first_contrib"]) == (last, first)


def test_tiles(spark):
    df = spark.createDataFrame([(0, 20.0, 20.0, 8), (1, -100.0, 5.0, 3), (2, 5.0, 5.0, 0)], "gid int, px double, py double, radius int")
    got = {(r["gid"], r["tile_id"]) for r in raster.tile_lists(df, 4, 4).collect()}
    assert got == {(0, 0), (0, 1), (0, 4), (0, 5), (2, 0)}


def test_normals_of_a_plane(spark):
    rows = [(0, x, y, [float(x), float(y), 0.5 * x]) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(rows, "view int, x int, y int, point array<double>")
    got = {(r["x"], r["y"]): r["normal"] for r in raster.depth_normals(df).collect()}
    np.testing.assert_allclose(got[1, 1], np.array([-0.5, 0, 1]) / math.sqrt(1.25))
    assert got[0, 1] == [0.0, 0.0, 0.0]


def test_scores(spark):
    a = spark.createDataFrame([(0.1,), (0.5,), (2.0,)], "dist double")
    none = a.limit(0)
    r = metrics.f_score(a, a, 0.5).first()
    assert math.isclose(r["precision"], 1 / 3) and math.isclose(r["f_score"], 1 / 3)
    assert tuple(metrics.f_score(a, none, 0.5).first()) == (0.0, 0.0, 0.0)
    h = metrics.cumulative_histogram(a, 0.5, stretch=2, bins=10).orderBy("bin").collect()
    assert len(h) == 19 and h[-1]["share"] == pytest.approx(2 / 3)
    c = metrics.chamfer(a, a, 1.0).first()
    assert c["overall"] == pytest.approx(0.3)


def test_ssim_of_equal_images_is_one(spark):
    rng = np.random.default_rng(0)
    rows = [(0, x, y, float(v := rng.uniform()), v) for x in range(16) for y in range(12)]
    df = spark.createDataFrame([(a, b, c, float(d), float(e)) for a, b, c, d, e in rows], "image int, x int, y int, a double, b double")
    assert metrics.ssim(df, "image", "x", "y", "a", "b").first()["ssim"] == pytest.approx(1.0)
    r = np.random.default_rng(8)
    p, q = r.random((2, 37, 23))
    other = spark.createDataFrame([(1, x, y, float(p[y, x]), float(q[y, x])) for y in range(37) for x in range(23)], "image int, x int, y int, a double, b double")
    whole, tiled = (metrics.ssim(other, "image", "x", "y", "a", "b", tile=t).first()["ssim"] for t in (256, 7))
    kernel = metrics._gaussian()
    blur = lambda m: np.array([[(np.pad(m, 5)[i : i + 11, j : j + 11] * np.outer(kernel, kernel)).sum() for j in range(23)] for i in range(37)])
    mp, mq = blur(p), blur(q)
    s = ((2 * mp * mq + 1e-4) * (2 * (blur(p * q) - mp * mq) + 9e-4)) / ((mp * mp + mq * mq + 1e-4) * (blur(p * p) - mp * mp + blur(q * q) - mq * mq + 9e-4))
    assert whole == pytest.approx(s.mean()) and tiled == pytest.approx(s.mean())


def test_bounds(spark):
    for sign in (1, -1):
        p = cloud(spark, sign * np.array([[1, 1, 1], [3, 1, 1], [2, 4, 1.0]]))
        r = metrics.origin_box(p).first()
        assert r["lo"] == ([0.0, 0.0, 0.0] if sign > 0 else [-3.0, -4.0, -1.0])
    axes = spark.createDataFrame([([1.0, 2.0, 0.0], [0.0, 0.0, 1.0]), ([0.0, 2.0, 3.0], [1.0, 0.0, 0.0]), ([1.0, 0.0, 3.0], [0.0, 1.0, 0.0])], "o array<double>, d array<double>")
    np.testing.assert_allclose(metrics.focus_point(axes, "o", "d").first()["focus"], [1, 2, 3], atol=1e-9)


def test_densify_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.0, 0.0, 0.0], rng.uniform(0, 2, 3).tolist(), 0.5, float(rng.uniform()), 3.0) for i in range(200)]
    df = spark.createDataFrame(rows, "gid long, xyz array<double>, scales array<double>, opacity double, grad double, denom double")
    out = lifecycle.densify_step(df, "grad", 0.5, 1.0, 0.0, seed=1)
    clones = sum(g >= 0.5 and max(s) <= 1.0 for _, _, s, _, g, _ in rows)
    splits = sum(g >= 0.5 and max(s) > 1.0 for _, _, s, _, g, _ in rows)
    assert out.count() == 200 + clones + splits
    assert out.filter("denom <> 0 OR grad <> 0").count() == 0
    assert out.filter("origin = 'split'").count() == 2 * splits


def test_components_and_clusters(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5), (3, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 5: 5}
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3), (2, 3, 8, 9)], "fid long, v0 long, v1 long, v2 long")
    by_edge = {r["fid"]: r["cluster"] for r in graph.triangle_clusters(faces).collect()}
    assert by_edge == {0: 0, 1: 0, 2: 2}
    assert len({r["cluster"] for r in graph.triangle_clusters(faces, "vertex").collect()}) == 1


def test_thinning_is_the_greedy_pass(spark):
    points = np.random.default_rng(4).uniform(size=(80, 3))
    keep = []
    for i, p in enumerate(points):
        if all(np.linalg.norm(p - points[j]) > 0.25 for j in keep):
            keep.append(i)
    assert sorted(r["pid"] for r in graph.greedy_thin(cloud(spark, points), 0.25).collect()) == keep


def test_alignment(spark):
    rng = np.random.default_rng(5)
    src = rng.normal(size=(40, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.linalg.det(q)
    dst = 2.5 * src @ q.T + [1, -2, 3]
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(src, dst)], "s array<double>, d array<double>")
    f, r, t = graph.similarity(pairs, "s", "d")
    assert f == pytest.approx(2.5)
    np.testing.assert_allclose(r, q, atol=1e-9)
    np.testing.assert_allclose(t, [1, -2, 3], atol=1e-9)
    noisy = dst.copy()
    noisy[:10] += 50
    matched = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(src, noisy))], "id long, s array<double>, d array<double>")
    best = graph.ransac_similarity(matched, "id", "s", "d", trials=64, threshold=0.01, batch=16).first()
    assert best["inliers"] == 30 and best["scale"] == pytest.approx(2.5) and best["trials"] < 64
    every = graph.ransac_similarity(matched, "id", "s", "d", trials=64, threshold=0.01, batch=10, confidence=None).first()
    assert every["trials"] == 64 and every["trial"] == best["trial"]
    np.testing.assert_allclose(best["translation"], [1, -2, 3], atol=1e-9)
    assert graph.ransac_similarity(matched.limit(2), "id", "s", "d").count() == 0
    noise = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(rng.normal(size=(30, 3)), rng.normal(size=(30, 3)) * 9))], matched.schema)
    assert graph.ransac_similarity(noise, "id", "s", "d", trials=40, threshold=1e-6, batch=16).first()["trials"] == 40
    moved = src @ np.array([[0.999, -0.0447, 0], [0.0447, 0.999, 0], [0, 0, 1.0]]).T + 0.01
    total, rmse = graph.icp(cloud(spark, moved), cloud(spark, src), 1.0, steps=6)
    assert rmse < 1e-2


def test_folds(spark):
    rows = [(1, i, s, v) for i, (s, v) in enumerate([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0), ("b", 2.0), ("a", None)])]
    df = spark.createDataFrame(rows, "k int, t int, s string, v double")
    e = 1.0
    for x in (3, 5, 5, 2):
        e = 0.9 * e + 0.1 * x
    assert state.ema(df, "k", ["t"], "v").first()["ema"] == pytest.approx(e)
    assert [r["committed"] for r in state.hysteresis(df, "k", ["t"], "s").orderBy("t").collect()] == [None] * 4 + ["b", "b"]
    assert state.cooldown(df, "k", ["t"], F.col("v") > 0, 2).first()["fired"] == 2


def test_quantiles_are_numpys(spark):
    draw = np.random.default_rng(3)
    values = [float(v) for v in np.round(draw.normal(size=400), 1)] + [7.0] * 200
    groups = ["hot" if i % 3 else f"g{i % 5}" for i in range(len(values))]
    df = spark.createDataFrame([*zip(groups, values), ("hot", None), (None, 1.0)], "g string, v double").repartition(7)
    known = [*values, 1.0]
    assert order.quantiles(df, "v", [0.0, 0.1, 0.77, 1.0]).first()["_q"] == pytest.approx(np.quantile(known, [0.0, 0.1, 0.77, 1.0]))
    got = {r["g"]: r["_q"] for r in order.group_quantiles(df.filter("g IS NOT NULL"), ["g"], "v", 0.37).collect()}
    want = {g: np.quantile([v for k, v in zip(groups, values) if k == g], 0.37) for g in set(groups)}
    assert got == pytest.approx(want)
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    assert order.quantiles(nan, "v", [0.5]).first()["_q"] == [2.0]
    assert order.quantiles(nan.filter("v < 0"), "v", [0.5]).first()["_q"] == [None]


def test_places_and_chunks(spark):
    values = [int(v) for v in np.random.default_rng(1).permutation(101)]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    assert {r["v"]: r["at"] for r in order.numbered(df, ["v"], "at").collect()} == {v: v for v in values}
    chunks = graph.chunk_windows(df, "v", 11).collect()
    assert sorted(r["chunk"] for r in chunks if r["anchor"]) == list(range(10)) and len(chunks) == 110


@pytest.mark.parametrize("rest", [0, 1, 3])
def test_folds_over_blocks(spark, rest):
    draw = np.random.default_rng(rest)
    rows = [(["hot", "b", None][k], i, bool(f), float(v)) for i, (k, f, v) in enumerate(zip(draw.choice(3, 300, p=[0.8, 0.1, 0.1]), draw.random(300) < 0.6, draw.normal(size=300)))]
    fired, smooth = {}, {}
    for key in ("hot", "b", None):
        left, n, e = 0, 0, None
        for _, _, f, v in [r for r in rows if r[0] == key]:
            now = f and left == 0
            left, n = (rest if now else max(left - 1, 0)), n + now
            e = v if e is None else 0.9 * e + 0.1 * v
        fired[key], smooth[key] = n, e
    df = spark.createDataFrame(rows, "k string, t int, f boolean, v double").repartition(5)
    assert {r["k"]: r["fired"] for r in state.cooldown(df, "k", ["t"], F.col("f"), rest, block=16).collect()} == fired
    assert {r["k"]: r["ema"] for r in state.ema(df, "k", ["t"], "v").collect()} == pytest.approx(smooth)
    assert state.cooldown(df.filter("t < 0"), "k", ["t"], F.col("f"), rest).collect() == []


def test_staged_alignment(spark):
    draw = np.random.default_rng(5)
    target = draw.uniform(-1, 1, size=(400, 3))
    angle, factor, shift = 0.02, 1.01, np.array([0.02, -0.01, 0.015])
    turn = np.array([[math.cos(angle), -math.sin(angle), 0], [math.sin(angle), math.cos(angle), 0], [0, 0, 1]])
    source = (target - shift) @ turn / factor
    total, rmse = graph.staged_icp(cloud(spark, source), cloud(spark, target), 0.01, inside=F.col("x") < 2, steps=8)
    moved = source @ total[:3, :3].T + total[:3, 3]
    assert rmse < 1e-6 and np.abs(moved - target).max() < 1e-6
    thin = graph._thinned(cloud(spark, target), None, 100)
    assert sorted(r["pid"] for r in thin.collect()) == list(range(0, 400, 4))
    with pytest.raises(ValueError):
        reliability.ablated_gradient(4, *[F.lit(0.0)] * 6)
