"""Keyed orders of epochs, eigenvectors and frames of poses against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import eigen, pose
from pointloom.operators import epochs, select


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_every_epoch_is_a_permutation(spark, n):
    df = spark.range(n).select("id", epochs.place_of(F.col("id"), F.lit(n), 5, 0).alias("a"), epochs.place_of(F.col("id"), F.lit(n), 5, 1).alias("b"))
    df = df.select("*", epochs.number_at(F.col("a"), F.lit(n), 5, 0).alias("back"))
    rows = df.collect()
    assert sorted(r["a"] for r in rows) == sorted(r["b"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)
    if n >= 64:
        a, b = np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows])
        assert (a == b).mean() < 0.1 and (a == np.arange(n)).mean() < 0.1
        assert abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.35 and abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.35


def test_orders_are_resumed_and_caps_are_their_beginnings(spark):
    df = spark.createDataFrame([(f"k{i:03d}", i) for i in range(200)], "k string, v long").repartition(5)
    whole = {r["k"]: r["place"] for r in select.shuffled(df, ["k"], 3, 1).collect()}
    assert sorted(whole.values()) == list(range(200))
    part = {r["k"]: r["place"] for r in select.shuffled(df, ["k"], 3, 1, begin=50, size=30).collect()}
    assert part == {k: p for k, p in whole.items() if 50 <= p < 80}
    assert {r["k"] for r in select.random_cap(df, ["k"], 20, 3, 1).collect()} == {k for k, p in whole.items() if p < 20}
    assert select.random_cap(df, ["k"], 999).count() == 200 and select.shuffled(df.limit(0), ["k"]).count() == 0


def test_eigenvectors(spark):
    r = np.random.default_rng(1)
    matrices = [(b := r.normal(size=(3, 3))) @ b.T for _ in range(40)] + [np.diag([3.0, 1.0, 2.0]), np.eye(3) * 2, np.zeros((3, 3)), np.diag([1e-9, 1e6, 1.0]), np.array([[1.0, 2, 0], [2, -5, 0], [0, 0, 1]])]
    rows = [(i, [float(m[a, b]) for a in range(3) for b in range(a, 3)]) for i, m in enumerate(matrices)] + [(99, None)]
    for x in spark.createDataFrame(rows, "i int, m array<double>").select("i", eigen.symmetric3(F.col("m")).alias("e")).collect():
        if x["i"] == 99:
            assert x["e"] is None
            continue
        m, values, vectors = matrices[x["i"]], [e["value"] for e in x["e"]], np.array([e["vector"] for e in x["e"]])
        np.testing.assert_allclose(values, np.linalg.eigvalsh(m), atol=1e-12 * max(1, abs(m).max()))
        np.testing.assert_allclose(vectors @ vectors.T, np.eye(3), atol=1e-9)
        np.testing.assert_allclose(m @ vectors.T, vectors.T * values, atol=1e-9 * max(1, abs(m).max()))
        assert all(v[np.abs(v).argmax()] > 0 for v in vectors)


def test_frames_of_poses(spark):
    r = np.random.default_rng(2)
    poses = [np.concatenate([np.linalg.qr(r.normal(size=(3, 3)))[0], r.normal(size=(3, 1)) * [[5], [2], [1]]], 1) for _ in range(30)]
    df = spark.createDataFrame([(p.ravel().tolist(),) for p in poses], "p array<double>")
    t = np.array(pose.principal_frame(df, "p").first()["transform"]).reshape(4, 4)
    moved = [t[:3, :3] @ p[:, :3] for p in poses]
    at = np.array([t[:3, :3] @ p[:, 3] + t[:3, 3] for p in poses])
    np.testing.assert_allclose(at.mean(0), 0, atol=1e-9)
    c = np.cov(at.T)
    np.testing.assert_allclose(c - np.diag(np.diag(c)), 0, atol=1e-9)
    assert c[0, 0] > c[1, 1] > c[2, 2] and np.linalg.det(t) == pytest.approx(1) and np.mean(moved, 0)[2, 1] >= 0
    m = np.array(pose.average_pose(df, "p").first()["pose"]).reshape(3, 4)
    mean = np.mean(poses, 0)
    z = mean[:, 2] / np.linalg.norm(mean[:, 2])
    x = np.cross(mean[:, 1], z)
    x /= np.linalg.norm(x)
    np.testing.assert_allclose(m, np.stack([x, np.cross(z, x), z, mean[:, 3]], 1), atol=1e-9)
