"""Segmented scans over several ranges, one key filling most of them, against plain loops; visibility and evidence against plain loops."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import evidence, raster, reliability, scan, state, visibility


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    data = []
    for k in [1] * 300 + [2] * 40 + [None] * 20 + [3]:
        data.append((k, len(data), r.choice(["a", "a", "b", None]), r.random(), float(r.randint(1, 9))))
    shuffled = data[:]
    r.shuffle(shuffled)
    return data, spark.createDataFrame(shuffled, "k long, t long, s string, alpha double, w double")


def by_key(data):
    out = defaultdict(list)
    for r in data:
        out[r[0]].append(r)
    return out


def test_a_hot_key_is_in_several_ranges(rows):
    parts = scan.ranges(rows[1], ["k"], ["t"])
    assert parts.filter("k = 1").select(scan.PART).distinct().count() >= 3


def test_running_sums(rows):
    data, df = rows
    got = {r["t"]: (r["n"], r["n_all"]) for r in scan.running_sums(scan.ranges(df, ["k"], ["t"]), ["k"], ["t"], {"n": F.col("w")}).collect()}
    for g in by_key(data).values():
        total = 0.0
        for r in g:
            total += r[4]
            assert got[r[1]] == (total, sum(x[4] for x in g))


@pytest.mark.parametrize("repeats", [1, 2, 5])
def test_hysteresis(rows, repeats):
    data, df = rows
    got = {r["t"]: r["committed"] for r in state.hysteresis(df, "k", ["t"], "s", repeats).collect()}
    for g in by_key(data).values():
        last, n, held = object(), 0, None
        for r in g:
            n = n + 1 if r[2] == last else 1
            last = r[2]
            held = last if n >= repeats and last is not None else held
            assert got[r[1]] == held


def test_transitions_and_dwell(rows):
    data, df = rows
    got = Counter({(r["before"], r["after"]): r["n"] for r in state.transitions(df, "k", ["t"], "s").collect()})
    assert got == Counter((a[2], b[2]) for g in by_key(data).values() for a, b in zip(g, g[1:]) if a[2] is not None)
    runs, n = Counter(), Counter(r[2] for r in data)
    for g in by_key(data).values():
        runs.update(r[2] for i, r in enumerate(g) if i == 0 or g[i - 1][2] != r[2])
    assert {r["s"]: (r["runs"], r["mean_rows"]) for r in state.dwell_times(df, "k", ["t"], "s").collect()} == {s: (runs[s], n[s] / runs[s]) for s in n}


def test_compositing(rows):
    data, df = rows
    df = df.withColumn("alpha", F.when(F.col("t") % 9 == 0, None).otherwise(F.col("alpha") / 40))
    got = {r["t"]: (r["place"], r["t_before"]) for r in raster.contributions(df, ["k"], ["t"]).collect()}
    seen = 0
    for g in by_key(data).values():
        light = 1.0
        for i, r in enumerate(g, 1):
            a = None if r[1] % 9 == 0 else r[3] / 40
            if a is None or a < 1 / 255:
                assert r[1] not in got
                continue
            if light * (1 - a) < 1e-4:
                light = 0
            if light:
                assert got[r[1]][0] == i and math.isclose(got[r[1]][1], light, rel_tol=1e-9)
                seen += 1
            light *= 1 - a
    assert seen == len(got)


def test_front_set(rows):
    data, df = rows
    got = {r["t"]: r["z_f"] for r in raster.front_set(df, ["k"], ["t"], "w", "t", band=0.1).collect()}
    want = {}
    for g in by_key(data).values():
        total, upto = sum(r[4] for r in g), np.cumsum([r[4] for r in g])
        z = min(r[1] for r, u in zip(g, upto) if u >= 0.5 * total)
        want |= {r[1]: z for r in g if r[4] >= 0.01 * total and abs(r[1] - z) <= 0.1 * z}
    assert got == want


def cameras(r, n, width, height):
    out = []
    for v in range(n):
        q, _ = np.linalg.qr(r.normal(size=(3, 3)))
        q = q if np.linalg.det(q) > 0 else -q
        out.append((v, q, np.array([r.normal() * 0.2, r.normal() * 0.2, 2 + r.random()]), 6.0, 7.0, (width - 1) / 2, (height - 1) / 2, width, height))
    return out


def camera_table(spark, cams):
    return spark.createDataFrame([(v, q.ravel().tolist(), t.tolist(), *map(float, k)) for v, q, t, *k in cams], "view long, r array<double>, t array<double>, fx double, fy double, cx double, cy double, width double, height double")


@pytest.mark.parametrize("whole", [True, False])
def test_visibility(spark, whole):
    r = np.random.default_rng(6)
    w, h = 6, 5
    cams = cameras(r, 8, w, h)
    depth = {(v, x, y): r.uniform(1.5, 3.5) for v in range(8) for x in range(w) for y in range(h)}
    if not whole:
        depth = {k: (0.0 if r.random() < 0.1 else d) for k, d in depth.items() if r.random() < 0.95}
    points = [(i, *r.normal(size=3)) for i in range(200)]
    want = set()
    for i, *p in points:
        for v, q, t, fx, fy, cx, cy, *_ in cams:
            a, b, z = q @ p + t
            if z <= 0:
                continue
            x, y = fx * a / z + cx, fy * b / z + cy
            if not (0 <= x <= w - 1 and 0 <= y <= h - 1):
                continue
            i0, j0 = min(int(x), w - 2), min(int(y), h - 2)
            four = [depth.get((v, i0 + m, j0 + n)) for n in (0, 1) for m in (0, 1)]
            f, g = x - i0, y - j0
            d = None if None in four else (four[0] * (1 - f) + four[1] * f) * (1 - g) + (four[2] * (1 - f) + four[3] * f) * g
            if d is None or d <= 0 or z < d + 0.005:
                want.add((i, v))
    pts = spark.createDataFrame([(i, *map(float, p)) for i, *p in points], "pid long, x double, y double, z double")
    maps = spark.createDataFrame([(*k, float(d)) for k, d in depth.items()], "view long, x long, y long, depth double")
    for width in (0.3, 1.7):
        got = visibility.sightings(pts, camera_table(spark, cams), maps, width).select("pid", "view").collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    n = Counter(i for i, _ in want)
    seen = {x["pid"]: (x["views"], x["seen"]) for x in visibility.visible(pts, camera_table(spark, cams), maps, 0.5, least=3).collect()}
    assert seen == {i: (n[i], n[i] >= 3) for i, *_ in points}


def test_cross_view(spark):
    r = np.random.default_rng(9)
    cams = [(v, np.eye(3), np.array([0.1 * v, 0.05 * v, 0.0]), 6.0, 6.0, 3.5, 2.5, 8, 6) for v in range(4)]
    pixels = [(v, x, y, [2 + 0.1 * r.random(), 0.0, float("nan"), float("inf"), None][0 if r.random() < 0.8 else r.integers(1, 5)], (n := r.normal(size=3)) / np.linalg.norm(n)) for v in range(4) for x in range(8) for y in range(6)]
    at = {(v, x, y): (d, n) for v, x, y, d, n in pixels if d is not None and 0 < d < float("inf")}
    want = {}
    for (v, x, y), (d, n) in at.items():
        for u in range(4):
            if u != v and abs(u - v) < 3:
                p = np.array([(x - 3.5) / 6 * d, (y - 2.5) / 6 * d, d]) - cams[v][2] + cams[u][2]
                i, j = math.floor(6 * p[0] / p[2] + 4), math.floor(6 * p[1] / p[2] + 3)
                if (u, i, j) in at and p[2] <= 1.05 * at[u, i, j][0]:
                    other, m = at[u, i, j]
                    e, f = abs(p[2] - other) / (p[2] + other + 1e-8), 1 - abs(float(n @ m))
                    want[v, x, y, u] = (i, j, math.exp(-(e / 0.05 + f / 0.1) / 2))
    df = spark.createDataFrame([(v, x, y, d, n.tolist()) for v, x, y, d, n in pixels], "view long, x long, y long, depth double, normal array<double>")
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(4) if a != b and abs(a - b) < 3], "a_id long, b_id long")
    got = {(x["view"], x["x"], x["y"], x["other"]): x for x in evidence.cross_view(df, camera_table(spark, cams), pairs).collect()}
    assert got.keys() == want.keys()
    assert all((got[k]["ox"], got[k]["oy"]) == w[:2] and math.isclose(got[k]["score"], w[2], rel_tol=1e-9) for k, w in want.items())


def test_confidence_between_quantiles(spark):
    values = [(1, float(i)) for i in range(101)] + [(2, 5.0), (2, None)]
    got = evidence.normalised_confidence(spark.createDataFrame(values, "v long, c double"), "c", "v", "n").collect()
    for r in got:
        if r["v"] == 1:
            assert abs(r["n"] - min(1, max(0, (r["c"] - 5) / 90))) < 1e-6
    assert {(r["c"], r["n"]) for r in got if r["v"] == 2} == {(5.0, 0.0), (None, None)}


def test_routes_and_limits(spark):
    df = spark.createDataFrame([(0.5, 0.9, 0.9, 0.9, True, True), (0.6, 0.9, 0.9, 0.6, True, True), (0.6, 0.9, 0.9, 0.1, True, None), (0.6, 0.9, 0.7, 0.1, True, True), (0.6, 0.5, 0.9, 0.1, False, False)], "n double, p double, g double, k double, vp boolean, vg boolean")
    c = F.col
    got = [r[0] for r in df.select(state.arbitrate(c("n"), c("p"), c("g"), c("k"), c("vp"), c("vg"))).collect()]
    assert got == ["bypass", "consensus", "prior", "prior", "abstain"]
    weights = {s: [r[0] for r in spark.range(1).select(F.array(*[reliability.routed(F.lit(s), g, F.lit(1.0), F.lit(10.0)) for g in ("pose", "scale", "opacity", "colour")])).collect()][0] for s in reliability.ROUTES}
    assert weights == {"bypass": [1, 1, 1, 1], "consensus": [6, 2, 1, 1], "prior": [10.25, 2.6, 0, 1], "geometry": [1, 1, 1, 1], "abstain": [0, 0, 0, 1]}
