"""Cases of the fourth round's finding, on small tables."""

import re

import numpy as np
import pytest

from pointloom.operators import visibility


def seen_by(c, depth, p, margin):
    """Whether a camera sees each point: every point by itself."""
    wide, high = int(c[16]), int(c[17])
    with np.errstate(all="ignore"):
        v = [c[3 * i] * p[0] + c[3 * i + 1] * p[1] + c[3 * i + 2] * p[2] + c[9 + i] for i in range(3)]
        u, t = c[12] * v[0] / v[2] + c[14], c[13] * v[1] / v[2] + c[15]
        on = (v[2] > 0) & (u >= 0) & (u <= wide - 1) & (t >= 0) & (t <= high - 1)
        q, r = (np.minimum(np.floor(np.where(on, x, 0)), n - 2).astype(int) for x, n in ((u, wide), (t, high)))
        d, f, g = depth.reshape(high, wide), u - q, t - r
        d = (d[r, q] * (1 - f) + d[r, q + 1] * f) * (1 - g) + (d[r + 1, q] * (1 - f) + d[r + 1, q + 1] * f) * g
        return on & ~((d > 0) & (v[2] >= d + margin))


@pytest.mark.parametrize("case", ["smooth", "rough", "odd", "missing", "lattice", "far"])
def test_boxes_settle_what_single_points_would(monkeypatch, case):
    r = np.random.default_rng(len(case))
    monkeypatch.setattr(visibility, "LEAF", 4)
    monkeypatch.setattr(visibility, "TESTS", 256)
    p = r.uniform(-1, 1, size=(3, 3000))
    if case == "lattice":
        p = np.round(p * 4) / 4
    if case == "odd":
        p[:, :20] = r.choice([np.nan, np.inf, -np.inf, 0.0, 1e300], size=(3, 20))
    cameras, maps = [], []
    for k in range(40):
        a, wide, high = (k // 10 * np.pi / 2 if case == "lattice" else k), int(r.integers(2, 9)), int(r.integers(2, 9))
        turn = np.round([np.cos(a), 0, -np.sin(a), 0, 1, 0, np.sin(a), 0, np.cos(a)], 12)
        focal = -6.0 if case == "odd" and k % 5 == 0 else 6.0
        cameras.append([*turn, 0, 0, r.uniform(0, 3) if case == "smooth" else 2, focal, 5.0, (wide - 1) / 2, (high - 1) / 2, wide, high])
        d = 2 + np.add.outer(np.arange(high), np.arange(wide)) / 10 if case == "smooth" else r.integers(4, 13, size=(high, wide)) / 4
        if case == "odd":
            d = np.where(r.random(d.shape) < 0.3, r.choice([0.0, -1.0, np.nan, np.inf, -np.inf], size=d.shape), d)
        if case == "missing":
            d = np.where(np.arange(wide) < wide // 2, np.nan if k % 2 else 0.0, d)
        maps.append(d.ravel())
    cameras = np.array(cameras).T
    if case == "far":
        p, cameras[9:12] = p + 1e6, cameras[9:12] - np.einsum("ijk,j->ik", cameras[:9].reshape(3, 3, -1), np.full(3, 1e6))
    sizes = np.array([len(d) for d in maps])
    got = visibility._sights(cameras, np.concatenate(maps), np.cumsum(sizes) - sizes, p, 0.005)
    want = sum(seen_by(c, d, p, 0.005).astype(int) for c, d in zip(cameras.T, maps, strict=True))
    assert got.tolist() == want.tolist() and want.sum() > 1000


def test_nothing_that_grows_with_views_is_broadcast(spark, monkeypatch, tmp_path):
    r = np.random.default_rng(2)
    turn = [[float(x) for x in (np.cos(a), 0, -np.sin(a), 0, 1, 0, np.sin(a), 0, np.cos(a))] for a in range(30)]
    tables = {
        "cameras": ([(i, m, [0.0, 0.0, 3.0], 6.0, 6.0, 3.5, 2.5, 8.0, 6.0) for i, m in enumerate(turn)], "view long, r array<double>, t array<double>, fx double, fy double, cx double, cy double, width double, height double"),
        "depths": ([(i, x, y, 2 + float(r.random())) for i in range(30) for x in range(8) for y in range(6)], "view long, x long, y long, depth double"),
        "points": ([(i, *map(float, p)) for i, p in enumerate(r.uniform(-1, 1, size=(300, 3)))], "pid long, x double, y double, z double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    points, cameras, depths = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("points", "cameras", "depths"))
    plans, cut = [], visibility.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(visibility, "cut", lambda df: plans.append(plan(df)) or cut(df))
    out = visibility.visible(points, cameras, depths, 0.7, least=9)
    plans.append(plan(out))
    joins = [j for p in plans for j in re.findall(r"BroadcastHashJoin \[[^\]]*\], \[[^\]]*\]", p)]
    assert joins and not [j for j in joins if re.search(r"view|_w#", j)]
    want = {x["pid"]: x["count"] for x in visibility.sightings(points, cameras, depths, 0.7).groupBy("pid").count().collect()}
    assert {tuple(x) for x in out.collect()} == {(i, want.get(i, 0), want.get(i, 0) >= 9) for i in range(300)} and len(want) > 100
