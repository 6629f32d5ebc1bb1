import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.sources import database, formats, ply, sfm_model


def model(spark):
    cameras = spark.createDataFrame([(1, "PINHOLE", 100, 80, [90.0, 91.0, 50.0, 40.0]), (2, "SIMPLE_RADIAL", 64, 48, [60.0, 32.0, 24.0, 0.1])], sfm_model.CAMERAS)
    images = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 2.0], 1, "a b.png", [(1.5, 2.5, 7), (3.0, 4.0, -1)]), (2, [0.0, 1.0, 0.0, 0.0], [5.0, 1.0, 2.0], 2, "ü.png", [])], sfm_model.IMAGES)
    points = spark.createDataFrame([(7, [1.0, 2.0, 3.0], [255, 0, 9], 0.5, [(1, 0)]), (2**33, [0.0, -2.0, 3.5], [1, 2, 3], 9.5, [])], sfm_model.POINTS)
    return {"cameras": cameras, "images": images, "points3D": points}


@pytest.mark.parametrize("kind", ["bin", "txt"])
def test_model_round_trip(spark, tmp_path, kind):
    before = model(spark)
    sfm_model.write_model(before, str(tmp_path), kind)
    assert sfm_model.detect_format(spark, str(tmp_path)) == kind
    after = sfm_model.read_model(spark, str(tmp_path))
    for t, df in before.items():
        key = df.columns[0]
        assert df.orderBy(key).collect() == after[t].orderBy(key).collect()


def test_text_points_filter_and_binary_bytes(spark, tmp_path):
    sfm_model.write_model(model(spark), str(tmp_path), "txt")
    assert sfm_model.read_points_text(spark, f"{tmp_path}/points3D.txt").count() == 1
    assert sfm_model.read_points_text(spark, f"{tmp_path}/points3D.txt", None).count() == 2
    sfm_model.write_model(model(spark), str(tmp_path), "bin")
    data = (tmp_path / "cameras.bin").read_bytes()
    assert data[:8] == struct.pack("<Q", 2) and len(data) == 8 + 2 * 24 + 8 * 8


def test_unknown_models_raise(spark):
    cameras = model(spark)["cameras"]
    with pytest.raises(Exception, match="SIMPLE_RADIAL"):
        sfm_model.require_models(cameras).collect()


@pytest.mark.parametrize("binary", [True, False])
def test_ply_round_trip(spark, tmp_path, binary):
    rows = [(i, float(i), float(-i), 0.5 * i, i % 256) for i in range(50)]
    df = spark.createDataFrame(rows, "vid long, x double, y double, z double, red int")
    ply.write_ply(df, f"{tmp_path}/a.ply", {"x": "double", "y": "float", "z": "double", "red": "uchar"}, "vid", binary)
    got = ply.read_vertices(spark, f"{tmp_path}/a.ply").orderBy("vid").collect()
    assert [(r["vid"], r["properties"]["x"], r["properties"]["y"], r["properties"]["z"], int(r["properties"]["red"])) for r in got] == rows


def test_particles_and_clouds(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0], 0.5, [0.1, 0.2, 0.3], [float(i) for i in range(45)], [0.0, 1.0, 2.0], [1.0, 0.0, 0.0, 0.0])], "gid long, xyz array<double>, opacity double, f_dc array<double>, f_rest array<double>, log_scales array<double>, rotation array<double>")
    ply.write_particles(df, f"{tmp_path}/p.ply")
    row = ply.read_particles(spark, f"{tmp_path}/p.ply").first()
    assert row["f_rest"] == [float(i) for i in range(45)] and row["rotation"] == [1.0, 0.0, 0.0, 0.0]
    assert b"property float f_rest_44" in (tmp_path / "p.ply").read_bytes()
    cloud = spark.createDataFrame([(0, 1.0, 2.0, 3.0, [255, 0, 51])], "vid long, x double, y double, z double, rgb array<int>")
    ply.write_point_cloud(cloud, f"{tmp_path}/c.ply")
    back = ply.read_point_cloud(spark, f"{tmp_path}/c.ply")
    assert back.first()["rgb"] == [1.0, 0.0, 0.2]
    assert [r["vid"] for r in ply.concat_point_clouds([back, back]).orderBy("vid").collect()] == [0, 1]


def test_faces(spark, tmp_path):
    (tmp_path / "f.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0\n1\n2\n3 0 1 2\n")
    assert ply.read_faces(spark, f"{tmp_path}/f.ply").first()["vertices"] == [0, 1, 2]


def test_dense_visibility_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("d.bin", 2, 3, 1, [float(i) for i in range(6)])], "name string, height int, width int, channels int, data array<float>")
    formats.write_dense(df, str(tmp_path))
    assert formats.read_dense(spark, f"{tmp_path}/d.bin").select("height", "width", "channels", "data").first() == df.select("height", "width", "channels", "data").first()
    raw = (tmp_path / "d.bin").read_bytes()
    assert raw.startswith(b"3&2&1&") and np.frombuffer(raw[6:], "<f4").tolist() == [0, 1, 2, 3, 4, 5]
    vis = spark.createDataFrame([(0, [1, 2]), (1, [])], "vid long, visible array<bigint>")
    formats.write_visibility(vis, f"{tmp_path}/v")
    assert formats.read_visibility(spark, f"{tmp_path}/v").orderBy("vid").collect() == vis.collect()
    log = spark.createDataFrame([(0, [0, 0, 1], [float(i) for i in range(16)]), (1, [1, 1, -1], [0.0] * 16)], formats.POSE)
    formats.write_trajectory(log, f"{tmp_path}/t.log")
    got = formats.read_trajectory(spark, f"{tmp_path}/t.log")
    assert got.orderBy("frame").collect() == log.collect()
    assert [r["frame"] for r in formats.valid_frames(got).collect()] == [0]
    (tmp_path / "m").write_text("2 2\n0 2\n1 1\n")
    assert [r["meta"] for r in formats.sampled_trajectory(formats.read_mapping(spark, f"{tmp_path}/m"), got).orderBy("frame").collect()] == [[1, 1, -1], [0, 0, 1]]


def test_small_formats(spark, tmp_path):
    np.savez(tmp_path / "a.npz", d=np.arange(6).reshape(2, 3))
    assert formats.read_numpy(spark, f"{tmp_path}/a.npz").first()["shape"] == [2, 3]
    (tmp_path / "e.csv").write_text("# c\n0.5,0.05\n2.0,0.01\n")
    assert formats.read_errors(spark, f"{tmp_path}/e.csv").count() == 2
    (tmp_path / "t.json").write_text(json.dumps({"camera_angle_x": 0.5, "frames": [{"file_path": "a", "transform_matrix": np.eye(4).tolist()}]}))
    assert formats.read_frames_json(spark, f"{tmp_path}/t.json").first()["transform"] == np.eye(4).ravel().tolist()
    (tmp_path / "s.json").write_text(json.dumps({"train": ["a"], "test": ["b", "c"]}))
    assert formats.read_split_json(spark, f"{tmp_path}/s.json").count() == 3
    for n in (3, 30, 7):
        (tmp_path / f"iter_{n}").mkdir()
    assert formats.latest_version(spark, f"{tmp_path}/iter_*") == 30
    (tmp_path / "b.out").write_text("# v\n1 1\n1 0 0\n1 0 0\n0 1 0\n0 0 1\n0 0 0\n1.5 2 3\n9 8 7\n2 0 5 1.0 2.0 1 6 3.0 4.0\n")
    row = formats.read_bundle(spark, f"{tmp_path}/b.out").first()
    assert row["xyz"] == [1.5, 2.0, 3.0] and len(row["track"]) == 2
    (tmp_path / "x.nvm").write_text("NVM_V3\n1\ncam 1 0 0 0 0 0 0 0 0 0\n1\n1 2 3 9 8 7 1 0 4 0.5 0.25\n")
    assert formats.read_nvm(spark, f"{tmp_path}/x.nvm").first()["track"][0]["y"] == 0.25
    (tmp_path / "p.ppm").write_bytes(b"P6 2 1 255\n" + bytes([255, 0, 0, 0, 51, 255]))
    assert formats.image_pixels(spark, f"{tmp_path}/p.ppm").filter("x = 1").first()["g"] == 0.2


def test_database(spark, tmp_path):
    images = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "image_id int, name string, camera_id int")
    cameras = spark.createDataFrame([(1, 1, 64, 48, np.arange(4.0).tobytes(), 0)], "camera_id int, model int, width int, height int, params binary, prior_focal_length int")
    blob = np.array([[1, 2], [3, 4]], "<u4").tobytes()
    pairs = [(1 * 2147483647 + 2, 2, blob), (1 * 2147483647 + 3, 0, None)]
    geometries = spark.createDataFrame([(p, n, 2, d, 2) for p, n, d in pairs], "pair_id bigint, rows int, cols int, data binary, config int")
    path = f"{tmp_path}/db"
    database.write_database(spark, path, {"images": images, "cameras": cameras, "two_view_geometries": geometries})
    assert database.scan(spark, path, "images").orderBy("image_id").collect() == images.collect()
    assert database.scan(spark, path, "two_view_geometries", ["pair_id"], "rows >= 1").count() == 1
    database.write_database(spark, f"{tmp_path}/shards", {"images": images, "cameras": cameras}, shards=3)
    assert len(list((tmp_path / "shards").glob("*.db"))) == 3
    assert database.scan(spark, f"{tmp_path}/shards/*", "images").orderBy("image_id").collect() == images.collect()
    assert database.scan(spark, f"{tmp_path}/shards/*", "matches").count() == 0
    g, i = database.scan(spark, path, "two_view_geometries"), database.scan(spark, path, "images")
    assert database.inlier_pairs(g, i, 1).collect() == [("a", "b", 2)]
    assert database.match_lines(g, i, 1).first()["text"] == "a b\n1 2\n3 4\n"
    decoded = g.filter("rows > 0").select(database.match_rows(F.col("data")).alias("m")).first()["m"]
    assert [tuple(x) for x in decoded] == [(1, 2), (3, 4)]
    assert database.images_with_cameras(i, database.scan(spark, path, "cameras")).count() == 3
    with pytest.raises(Exception, match="no camera_id 9"):
        database.images_with_cameras(spark.createDataFrame([(4, "d", 9)], images.schema), cameras).collect()
    swapped = database.new_matches(spark.createDataFrame([(5, 2, [(7, 8)])], "image_id1 int, image_id2 int, matches array<struct<idx1:int,idx2:int>>")).first()
    assert swapped["pair_id"] == 2 * 2147483647 + 5 and tuple(swapped["matches"][0]) == (8, 7)
    keypoints = spark.createDataFrame([(1, 0, 2, None), (2, 1, 2, b"12345678")], "image_id int, rows int, cols int, data binary")
    descriptors = spark.createDataFrame([(2, 1, 128, b"d")], "image_id int, rows int, cols int, data binary")
    got = database.keypoints_of(i.filter("image_id < 3"), keypoints, descriptors).orderBy("image_id").collect()
    assert [r["n"] for r in got] == [0, 1] and bytes(got[0]["descriptors"]) == b""


def test_feature_files(spark):
    points, marks = np.arange(12, dtype="<f4").reshape(2, 6), np.arange(256, dtype=np.uint8).reshape(2, 128)
    rows = [(1, points.tobytes(), marks.tobytes()), (2, b"", b"")]
    images = spark.createDataFrame([(i, bytearray(k), bytearray(d)) for i, k, d in rows], "image_id int, keypoints binary, descriptors binary")
    got = {r["image_id"]: bytes(r["content"]) for r in formats.sift_files(images).collect()}
    head = np.frombuffer(got[1][:20], "<i4").tolist()
    assert head == [1413892435, 808334422, 2, 4, 128] and np.frombuffer(got[1][-4:], "<i4")[0] == 1179600383
    assert np.array_equal(np.frombuffer(got[1][20:52], "<f4").reshape(2, 4), points[:, :4]) and got[1][52:-4] == marks.tobytes()
    assert len(got[2]) == 24
    text = {r["image_id"]: bytes(r["content"]).decode() for r in formats.sift_files(images, binary=False).collect()}
    assert text[1].splitlines()[:2] == ["2 128", "0.000000 1.000000 0 0 " + " ".join(map(str, range(128)))] and text[2] == "0 128\n"


def test_result_files(spark):
    df = spark.createDataFrame([("b", 0.5, 20.0), ("a", 0.25, 30.0)], "view string, ssim double, psnr double")
    assert json.loads(formats.per_view_json(df, "view", ["ssim", "psnr"]).first()["value"]) == {"ssim": {"a": 0.25, "b": 0.5}, "psnr": {"a": 30.0, "b": 20.0}}
    assert json.loads(formats.result_json(df.agg(F.avg("ssim").alias("ssim"))).first()["value"]) == {"ssim": 0.375}
    lines = [r["value"] for r in formats.curve_lines(df, "view", "ssim").orderBy("view").collect()]
    assert lines == ["%.18e" % 0.25, "%.18e" % 0.5]
