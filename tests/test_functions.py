import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import camera, harmonics, keys, pose
from pointloom.functions import vectors as V


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(a):
    return F.array(*[F.lit(float(x)) for x in np.asarray(a).ravel()])


def rotation(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else -q


def test_matrices_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, b, v, w = rng.normal(size=(3, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    r = one(spark, mm=V.matmul(lit(a), lit(b)), inv=V.inverse3(lit(a)), mv=V.matvec(lit(a), lit(v)), c=V.cross(lit(v), lit(w)), n=V.norm(lit(v)), g=V.angle_degrees(lit(v), lit(w)), none=V.inverse3(lit(np.zeros(9))))
    np.testing.assert_allclose(r["mm"], (a @ b).ravel())
    np.testing.assert_allclose(r["inv"], np.linalg.inv(a).ravel())
    np.testing.assert_allclose(r["mv"], a @ v)
    np.testing.assert_allclose(r["c"], np.cross(v, w))
    assert r["none"] is None and math.isclose(r["n"], np.linalg.norm(v))
    assert math.isclose(r["g"], math.degrees(math.acos(v @ w / np.linalg.norm(v) / np.linalg.norm(w))))


def test_poses(spark):
    rng = np.random.default_rng(2)
    rows = [(rotation(rng), rng.normal(size=3)) for _ in range(6)]
    df = spark.createDataFrame([(m.ravel().tolist(), t.tolist()) for m, t in rows], "r array<double>, t array<double>")
    out = df.select(pose.rotation_to_quaternion(F.col("r")).alias("q"), pose.world_to_view(F.col("r"), F.col("t")).alias("view"), pose.camera_centre(F.col("r"), F.col("t")).alias("c")).collect()
    more = spark.createDataFrame([(r["q"], r["view"]) for r in out], "q array<double>, view array<double>")
    back = more.select(pose.quaternion_to_rotation(F.col("q")).alias("r"), pose.inverse_rigid(F.col("view")).alias("inv")).collect()
    for (m, t), o, b in zip(rows, out, back):
        full = np.eye(4)
        full[:3, :3], full[:3, 3] = m, t
        np.testing.assert_allclose(b["r"], m.ravel(), atol=1e-9)
        assert o["q"][0] >= 0
        np.testing.assert_allclose(np.reshape(b["inv"], (4, 4)) @ full, np.eye(4), atol=1e-9)
        np.testing.assert_allclose(o["view"], full.ravel(), atol=1e-9)
        np.testing.assert_allclose(o["c"], -m.T @ t, atol=1e-9)
    a, b = pose.closest_points(lit([0, 0, 0]), lit([1, 0, 0]), lit([0, 1, 5]), lit([0, 1, 0]))
    r = one(spark, a=a, b=b)
    np.testing.assert_allclose(r["a"], [0, 0, 0])
    np.testing.assert_allclose(r["b"], [0, 0, 5])


def test_projection_round_trips(spark):
    k = [F.lit(x) for x in (500.0, 510.0, 320.0, 240.0)]
    p = camera.unproject(F.lit(100.0), F.lit(50.0), F.lit(2.0), *k)
    r = one(spark, px=camera.project(p, *k), fov=camera.fov_to_focal(camera.focal_to_fov(F.lit(300.0), F.lit(640)), F.lit(640)), zero=camera.project(lit([1, 2, 0]), *k))
    np.testing.assert_allclose(r["px"], [100, 50])
    assert math.isclose(r["fov"], 300.0) and r["zero"] == [0.0, 0.0]
    rng = np.random.default_rng(3)
    uv = rng.uniform(-0.3, 0.3, size=(20, 2))
    for n, params in ((1, [0.05]), (2, [0.05, -0.01]), (4, [0.05, -0.01, 0.001, 0.002])):
        df = spark.createDataFrame([(float(u), float(v), params) for u, v in uv], "u double, v double, p array<double>")
        du, dv = camera.distort(F.col("u"), F.col("v"), F.col("p"), n)
        back = df.withColumns({"du": du, "dv": dv}).select("u", "v", camera.undistort_udf(n)("du", "dv", "p").alias("x")).collect()
        np.testing.assert_allclose([b["x"] for b in back], [[b["u"], b["v"]] for b in back], atol=1e-6)


def test_splats(spark):
    rng = np.random.default_rng(4)
    s, m = rng.uniform(0.1, 1, 3), rotation(rng)
    full = (m * s) @ (m * s).T
    r = one(spark, c=camera.covariance(lit(s), lit(m)))
    np.testing.assert_allclose(r["c"], full[np.triu_indices(3)])
    t, fx, fy = np.array([0.2, -0.1, 3.0]), 400.0, 410.0
    j = np.array([[fx / t[2], 0, -fx * t[0] / t[2] ** 2], [0, fy / t[2], -fy * t[1] / t[2] ** 2]])
    want = j @ m @ full @ m.T @ j.T + 0.3 * np.eye(2)
    cov = camera.projected_covariance(lit(t), lit(full[np.triu_indices(3)]), lit(m), F.lit(fx), F.lit(fy), F.lit(1.0), F.lit(1.0))
    r = one(spark, cov=cov, conic=camera.conic(cov), radius=camera.splat_radius(cov), none=camera.conic(lit([1, 1, 1])))
    np.testing.assert_allclose(r["cov"], [want[0, 0], want[0, 1], want[1, 1]])
    inv = np.linalg.inv(want)
    np.testing.assert_allclose(r["conic"], [inv[0, 0], inv[0, 1], inv[1, 1]])
    assert r["radius"] == math.ceil(3 * math.sqrt(np.linalg.eigvalsh(want)[1])) and r["none"] is None


def test_tile_rect_cuts_toward_zero(spark):
    r = one(spark, a=F.array(*camera.tile_rect(F.lit(-20.0), F.lit(8.0), F.lit(3), 10, 10)), b=F.array(*camera.tile_rect(F.lit(20.0), F.lit(20.0), F.lit(8), 10, 10)))
    assert r["a"] == [0, 0, 0, 1] and r["b"] == [0, 0, 2, 2]


def test_harmonics(spark):
    rng = np.random.default_rng(5)
    d = rng.normal(size=(400, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    df = spark.createDataFrame([(x.tolist(),) for x in d], "d array<double>")
    b = np.array([r["b"] for r in df.select(F.array(*harmonics.basis(F.col("d"), 3)).alias("b")).collect()])
    np.testing.assert_allclose((b[:, 1:4] ** 2).sum(1), 3 / (4 * math.pi), rtol=1e-9)  # the addition theorem, per degree
    np.testing.assert_allclose((b[:, 4:9] ** 2).sum(1), 5 / (4 * math.pi), rtol=1e-9)
    np.testing.assert_allclose((b[:, 9:] ** 2).sum(1), 7 / (4 * math.pi), rtol=1e-9)
    r = one(spark, e=harmonics.energy(lit(np.ones(15)), "sobolev", 1), z=harmonics.energy(lit(np.zeros(45)), "equal"), c=harmonics.to_colour(harmonics.from_colour(F.lit(0.3))))
    assert math.isclose(r["e"], math.sqrt(3 * 2 + 5 * 6 + 7 * 12)) and math.isclose(r["z"], 1e-4) and math.isclose(r["c"], 0.3)
    with pytest.raises(ValueError):
        harmonics.energy(F.col("x"), "other")


def test_keys(spark):
    rows = [(1, 2), (2, 1), (2**31 - 2, 5), (7, 7)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("p", keys.pair_id(F.col("a"), F.col("b")))
    x, y = keys.unpair(F.col("p"))
    for r in df.select("a", "b", "p", x.alias("x"), y.alias("y")).collect():
        assert (r["x"], r["y"]) == (min(r["a"], r["b"]), max(r["a"], r["b"]))
    blobs = spark.createDataFrame([(b"\1\0\0\0\2\0\0\0",), (None,)], "d binary").select(keys.blob_to_array("<u4", "long")("d").alias("v")).collect()
    assert blobs[0]["v"] == [1, 2] and blobs[1]["v"] is None
    m = one(spark, m=keys.morton3(F.lit(1.0), F.lit(0.0), F.lit(0.0), [F.lit(0.0)] * 3, [F.lit(1.0)] * 3))
    assert m["m"] == sum(1 << 3 * i for i in range(10))


def test_schedules(spark):
    steps = spark.createDataFrame([(-1,), (0,), (50,), (100,), (200,)], "s int")
    got = [r[0] for r in steps.select(camera.learning_rate(F.col("s"), 1e-2, 1e-4, 100)).collect()]
    np.testing.assert_allclose(got, [0, 1e-2, 1e-3, 1e-4, 1e-4])


def test_decomposition(spark):
    rng = np.random.default_rng(6)
    k, m, c = np.array([[500, 2, 320], [0, 510, 240], [0, 0, 1.0]]), rotation(rng), rng.normal(size=3)
    p = k @ np.hstack([m, (-m @ c)[:, None]])
    got = spark.createDataFrame([(p.ravel().tolist(),)], "p array<double>").select(camera.decompose_projection_udf()("p").alias("x")).first()["x"]
    np.testing.assert_allclose(got[:9], k.ravel(), atol=1e-6)
    np.testing.assert_allclose(got[9:18], m.ravel(), atol=1e-9)
    np.testing.assert_allclose(got[18:], c, atol=1e-9)
