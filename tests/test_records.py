"""Files read in small ranges and written by several tasks, against the bytes that they should have."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.sources import formats, ply, records, sfm_model


@pytest.fixture(autouse=True)
def small(monkeypatch, spark):
    monkeypatch.setattr(records, "HELD_BYTES", 150)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def model(spark, n=120):
    r = random.Random(3)
    cameras = [(i, "PINHOLE", 10 + i, 8, [r.random() for _ in range(4)]) for i in range(n)]
    images = [(i, [r.random() for _ in range(4)], [r.random() for _ in range(3)], i, r.choice(["a b.png", "ü.jpg", "x" * 40]), [(r.random(), r.random(), r.randint(-1, 2**40)) for _ in range(r.choice([0, 0, 1, 30]))]) for i in range(n)]
    points = [(i + 2**33, [r.random() for _ in range(3)], [r.randint(0, 255) for _ in range(3)], r.random(), [(r.randint(0, 9), j) for j in range(r.choice([0, 2, 50]))]) for i in range(n)]
    return {"cameras": spark.createDataFrame(cameras, sfm_model.CAMERAS), "images": spark.createDataFrame(images, sfm_model.IMAGES), "points3D": spark.createDataFrame(points, sfm_model.POINTS)}


@pytest.mark.parametrize("kind", ["bin", "txt"])
def test_models_in_ranges(spark, tmp_path, kind):
    before = model(spark)
    sfm_model.write_model({t: df.repartition(5) for t, df in before.items()}, str(tmp_path), kind)
    for t, df in before.items():
        key = df.columns[0]
        want = df.orderBy(key).collect()
        whole = [r for r in sfm_model._PARSERS[t, kind]((tmp_path / f"{t}.{kind}").read_bytes())]  # the file itself, record by record
        assert [r[0] for r in whole] == [r[0] for r in want]
        after = sfm_model.read_model(spark, str(tmp_path), kind, range_bytes=700)[t]
        assert after.orderBy(key).collect() == want
        if kind == "bin":
            assert after.rdd.glom().map(len).filter(lambda n: n > 0).count() > 2


@pytest.mark.parametrize("size", [1, 7, 30, 10_000])
def test_pairs_of_lines(spark, tmp_path, size):
    text = "# about\n1 a\ntail 1\n\n  \n2 b\n\n# between\n3 c\n# inside\ntail 3\n\n4 " + "d" * 400 + "\n" + "t" * 300 + "\n5 e"
    (tmp_path / "x").write_text(text)
    got = sorted((r["head"], r["tail"]) for r in records.paired_lines(spark, str(tmp_path / "x"), size).collect())
    assert got == [("1 a", "tail 1"), ("2 b", ""), ("3 c", "tail 3"), ("4 " + "d" * 400, "t" * 300), ("5 e", "")]
    (tmp_path / "none").write_text("")
    assert records.paired_lines(spark, str(tmp_path / "none"), size).count() == 0


def test_vertices_and_faces(spark, tmp_path):
    r = np.random.default_rng(1)
    n, path = 1000, str(tmp_path / "m.ply")
    rows = [(i, float(np.float32(r.normal())), float(r.normal()), int(r.integers(0, 256))) for i in range(n)]
    df = spark.createDataFrame(rows, "vid long, x double, y double, red int").repartition(7)
    ply.write_ply(df, path, {"x": "float", "y": "double", "red": "uchar"}, "vid")
    data = (tmp_path / "m.ply").read_bytes()
    body = b"".join(struct.pack("<fdB", x, y, red) for _, x, y, red in rows)
    assert data.endswith(b"end_header\n" + body)
    got = ply.read_columns(spark, path, ["y", "red"], range_bytes=1300)
    assert got.columns == ["vid", "y", "red"] and got.rdd.getNumPartitions() == 10
    assert [tuple(x) for x in got.orderBy("vid").collect()] == [(i, y, red) for i, _, y, red in rows]
    faces = [list(map(int, r.integers(0, n, k))) for k in r.integers(3, 40, 200)]
    head = data[: data.index(b"end_header")] + f"element face {len(faces)}\nproperty uchar flags\nproperty list uchar int vertex_indices\nend_header\n".encode()
    (tmp_path / "f.ply").write_bytes(head + body + b"".join(struct.pack(f"<BB{len(f)}i", 7, len(f), *f) for f in faces))
    got = ply.read_faces(spark, str(tmp_path / "f.ply"), range_bytes=900)
    assert [(x["fid"], x["vertices"]) for x in got.orderBy("fid").collect()] == list(enumerate(faces))
    assert got.rdd.glom().map(len).filter(lambda k: k > 0).count() > 2


def test_files_that_end_too_early(spark, tmp_path):
    path = str(tmp_path / "m.ply")
    ply.write_ply(spark.createDataFrame([(i, 1.0) for i in range(50)], "vid long, x double"), path, {"x": "double"}, "vid")
    (tmp_path / "m.ply").write_bytes((tmp_path / "m.ply").read_bytes()[:-3])
    with pytest.raises(Exception, match="ends before record"):
        ply.read_columns(spark, path).collect()
    sfm_model.write_model({"points3D": model(spark, 20)["points3D"]}, str(tmp_path))
    short = (tmp_path / "points3D.bin").read_bytes()[:-2]
    (tmp_path / "points3D.bin").write_bytes(short)
    with pytest.raises(Exception, match="ends within a record"):
        records.read_indexed(spark, str(tmp_path / "points3D.bin"), 8, 20, sfm_model._point_size, lambda d: sfm_model._point(sfm_model._Bytes(d)), sfm_model.POINTS).count()


def test_dense_values(spark, tmp_path):
    h, w, c = 5, 7, 2
    data = np.random.default_rng(2).normal(size=(h, w, c)).astype("<f4")
    formats.write_dense(spark.createDataFrame([("d", h, w, c, data.ravel().tolist())], "name string, height int, width int, channels int, data array<float>"), str(tmp_path))
    got = {(r["y"], r["x"], r["channel"]): r["value"] for r in formats.read_dense_values(spark, str(tmp_path / "d"), 40).collect()}
    assert got == {(y, x, k): float(data[y, x, k]) for y in range(h) for x in range(w) for k in range(c)}


def test_nothing_and_one_row(spark, tmp_path):
    for n in (0, 1):
        df = spark.createDataFrame([(i, [1, 2]) for i in range(n)], "vid long, visible array<bigint>")
        formats.write_visibility(df, str(tmp_path / f"v{n}"))
        assert (tmp_path / f"v{n}").read_bytes() == struct.pack("<Q", n) + b"".join(struct.pack("<I2I", 2, 1, 2) for _ in range(n))
        assert formats.read_visibility(spark, str(tmp_path / f"v{n}")).count() == n


def test_columns_are_pruned_in_the_plan(spark, tmp_path):
    path = str(tmp_path / "m.ply")
    ply.write_ply(spark.createDataFrame([(0, 1.0, 2.0)], "vid long, x double, y double"), path, {"x": "double", "y": "double"}, "vid")
    assert ply.read_columns(spark, path, ["y"]).select(F.sum("y")).first()[0] == 2.0
