"""Smaller formats: dense arrays, fused points with visibility, trajectories, mappings, transforms, exchange files."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.sources import ply
from pointloom.sources.files import parse_files
from pointloom.sources.records import RANGE_BYTES, beginning, in_reach, located, read_fixed, read_indexed, write_rows

POSE = "frame int, meta array<int>, pose array<double>"


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data): row-major values of `w&h&c&` arrays, which files hold column-major."""

    def parse(data: bytes) -> Iterator[tuple]:
        w, h, c, body = data.split(b"&", 3)
        w, h, c = int(w), int(h), int(c)
        values = np.frombuffer(body, "<f4").reshape((w, h, c), order="F").transpose(1, 0, 2)
        yield h, w, c, values.ravel().tolist()

    return parse_files(spark, path, parse, "height int, width int, channels int, data array<float>")


def dense_bytes(height: int, width: int, channels: int, data: list[float]) -> bytes:
    values = np.asarray(data, "<f4").reshape(height, width, channels).transpose(1, 0, 2)
    return f"{width}&{height}&{channels}&".encode() + values.ravel(order="F").tobytes()


def read_dense_values(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(y, x, channel, value) of one dense array, read in ranges of bytes, so that an array of any size is split."""
    head = beginning(path, 1 << 12)
    w, h, c, _ = head.split(b"&", 3)
    start = len(w) + len(h) + len(c) + 3
    w, h, c = int(w), int(h), int(c)
    rows, i = read_fixed(spark, path, start, w * h * c, [("value", "<f4")], range_bytes=range_bytes), F.col("row")
    return rows.select((F.floor(i / w) % h).cast("int").alias("y"), (i % w).cast("int").alias("x"), F.floor(i / (w * h)).cast("int").alias("channel"), "value")


def write_dense(df: DataFrame, folder: str) -> None:
    """A file per row of (name, height, width, channels, data), written by the task that has the row."""

    def written(batches):
        for b in batches:
            for r in b.to_pylist():
                system, where = located(f"{folder}/{r['name']}")
                with system.open_output_stream(where) as f:
                    f.write(dense_bytes(r["height"], r["width"], r["channels"], r["data"]))
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(b)], pa.int64())})

    df.select("name", "height", "width", "channels", "data").mapInArrow(written, "n long").agg(F.sum("n")).collect()


def read_visibility(spark: SparkSession, path: str) -> DataFrame:
    """(vid, visible) of a visibility file, by place; one that is in reach is walked over once and then read in ranges."""
    if in_reach(path):
        size = lambda data, at: n if at + 4 <= len(data) and at + (n := 4 + 4 * struct.unpack_from("<I", data, at)[0]) <= len(data) else -1
        values = lambda data: (list(struct.unpack_from(f"<{len(data) // 4 - 1}I", data, 4)),)
        return read_indexed(spark, path, 8, struct.unpack("<Q", beginning(path, 8))[0], size, values, "visible array<bigint>", number="vid")

    def parse(data: bytes) -> Iterator[tuple]:
        at = 8
        for i in range(struct.unpack_from("<Q", data)[0]):
            n = struct.unpack_from("<I", data, at)[0]
            yield i, list(struct.unpack_from(f"<{n}I", data, at + 4))
            at += 4 + 4 * n

    return parse_files(spark, path, parse, "vid bigint, visible array<bigint>").drop("path")


def read_fused(spark: SparkSession, points: str, visibility: str) -> DataFrame:
    """Points joined with their visibility by place; counts that differ raise."""
    p = ply.read_vertices(spark, points).select("vid", "properties")
    both = p.join(read_visibility(spark, visibility), "vid", "full")
    ok = F.col("properties").isNotNull() & F.col("visible").isNotNull()
    return both.withColumn("visible", F.when(ok, F.col("visible")).otherwise(F.raise_error(F.lit("points and visibility differ in number"))))


def write_visibility(df: DataFrame, path: str) -> None:
    """(vid, visible) by vid."""
    write_rows(df.select("vid", "visible"), path, struct.pack("<Q", df.count()), lambda r: struct.pack(f"<I{len(r['visible'])}I", len(r["visible"]), *r["visible"]), "vid")


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """(frame, meta of three, pose of 16) of a log with five lines a frame."""

    def parse(data: bytes) -> Iterator[tuple]:
        lines = [x for x in data.decode().split("\n") if x.strip()]
        for f in range(len(lines) // 5):
            pose = [float(v) for x in lines[5 * f + 1 : 5 * f + 5] for v in x.split()]
            yield f, [int(float(v)) for v in lines[5 * f].split()], pose

    return parse_files(spark, path, parse, POSE).drop("path")


def valid_frames(trajectory: DataFrame) -> DataFrame:
    """Frames without -1 in their header."""
    return trajectory.filter(~F.array_contains("meta", -1))


def write_trajectory(df: DataFrame, path: str) -> None:
    def text(r) -> bytes:
        rows = [" ".join(f"{v:.12f}" for v in r["pose"][4 * i : 4 * i + 4]) for i in range(4)]
        return ("\n".join([" ".join(map(str, r["meta"])), *rows]) + "\n").encode()

    write_rows(df.select("frame", "meta", "pose"), path, b"", text, "frame")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(i, sample, frame) of a file with two numbers in front and then pairs."""

    def parse(data: bytes) -> Iterator[tuple]:
        v = [int(x) for x in data.split()]
        yield from ((i, a, b) for i, (a, b) in enumerate(zip(v[2::2], v[3::2], strict=True)))

    return parse_files(spark, path, parse, "i int, sample int, frame int").drop("path")


def sampled_trajectory(mapping: DataFrame, trajectory: DataFrame) -> DataFrame:
    """The trajectory's poses of the mapping's frames, which count from 1."""
    return mapping.join(trajectory, mapping["frame"] - 1 == trajectory["frame"]).select(mapping["i"].alias("frame"), trajectory["meta"], trajectory["pose"])


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, values) of white-space separated numbers."""
    return parse_files(spark, path, lambda data: [([float(x) for x in data.split()],)], "values array<double>")


def read_numpy(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, data) of .npy files and of the arrays in .npz files."""

    def parse(data: bytes) -> Iterator[tuple]:
        found = np.load(io.BytesIO(data))
        for name, a in ({"": found} if isinstance(found, np.ndarray) else dict(found)).items():
            yield name, list(a.shape), a.astype(float).ravel().tolist()

    return parse_files(spark, path, parse, "name string, shape array<int>, data array<double>")


def from_codebook(index: Column, codebook: Column) -> Column:
    return F.element_at(codebook, index + 1)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(point, xyz, rgb, track of (camera, key, x, y)) of a bundle file."""

    def parse(data: bytes) -> Iterator[tuple]:
        lines = [x for x in data.decode().split("\n") if not x.startswith("#") and x.strip()]
        cameras, points = map(int, lines[0].split())
        at = 1 + 5 * cameras
        for i in range(points):
            xyz, rgb, view = (lines[at + 3 * i + j].split() for j in range(3))
            v = view[1:]
            track = [{"camera": int(v[k]), "key": int(v[k + 1]), "x": float(v[k + 2]), "y": float(v[k + 3])} for k in range(0, 4 * int(view[0]), 4)]
            yield i, [float(x) for x in xyz], [int(x) for x in rgb], track

    return parse_files(spark, path, parse, "point int, xyz array<double>, rgb array<int>, track array<struct<camera:int,key:int,x:double,y:double>>").drop("path")


def read_nvm(spark: SparkSession, path: str) -> DataFrame:
    """(point, xyz, rgb, track of (camera, key, x, y)) of an NVM file."""

    def parse(data: bytes) -> Iterator[tuple]:
        lines = [x for x in data.decode().split("\n")[1:] if x.strip()]
        at = 1 + int(lines[0].split()[0])
        for i, line in enumerate(lines[at + 1 : at + 1 + int(lines[at].split()[0])]):
            w = line.split()
            v = w[7:]
            track = [{"camera": int(v[k]), "key": int(v[k + 1]), "x": float(v[k + 2]), "y": float(v[k + 3])} for k in range(0, 4 * int(w[6]), 4)]
            yield i, [float(x) for x in w[:3]], [int(x) for x in w[3:6]], track

    return parse_files(spark, path, parse, "point int, xyz array<double>, rgb array<int>, track array<struct<camera:int,key:int,x:double,y:double>>").drop("path")


def long_tracks(points: DataFrame, least: int, track: str = "track") -> DataFrame:
    return points.filter(F.size(track) >= least)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="rotation_error double, proj_center_error double", comment="#")


def read_frames_json(spark: SparkSession, path: str) -> DataFrame:
    """(camera_angle_x, file_path, transform of 16) of a transforms file."""
    schema = "camera_angle_x double, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("camera_angle_x", F.explode("frames").alias("f"))
    return rows.select("camera_angle_x", "f.file_path", F.flatten("f.transform_matrix").alias("transform"))


def read_split_json(spark: SparkSession, path: str) -> DataFrame:
    """(split, image_name)."""
    rows = spark.read.schema("train array<string>, test array<string>").json(path, multiLine=True)
    return rows.select(F.explode(F.map_from_arrays(F.array(F.lit("train"), F.lit("test")), F.array("train", "test"))).alias("split", "names")).select("split", F.explode("names").alias("image_name"))


def latest_version(spark: SparkSession, pattern: str, suffix: str = r"_(\d+)") -> int | None:
    """The greatest number at the end of the names that pattern (with wildcards) finds."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    names = [s.getPath().getName() for s in found or []]
    if not names:
        return None
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    return rows.agg(F.max(F.nullif(F.regexp_extract("name", suffix + r"(?:\.[^.]*)?$", 1), F.lit("")).cast("int"))).first()[0]


def image_name(path: Column) -> Column:
    """A path's base name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of portable pixmaps (P6, P5): (path, x, y, r, g, b) from 0 to 1. Other codecs need a decoder Spark lacks."""

    def parse(data: bytes) -> Iterator[tuple]:
        kind, w, h, top = data.split(maxsplit=4)[:4]
        w, h, top = int(w), int(h), int(top)
        bands = 3 if kind == b"P6" else 1
        a = np.frombuffer(data[len(data) - w * h * bands :], np.uint8).reshape(h, w, bands) / top
        for y in range(h):
            for x in range(w):
                v = a[y, x]
                yield x, y, float(v[0]), float(v[-2 if bands == 3 else 0]), float(v[-1])

    return parse_files(spark, path, parse, "x int, y int, r double, g double, b double")


def cameras_json(cameras: DataFrame) -> DataFrame:
    """A JSON object a line (columns id, img_name, width, height, position, rotation, fx, fy as they are)."""
    return cameras.select(F.to_json(F.struct(*cameras.columns)).alias("value"))


def neighbours_json(edges: DataFrame, cameras: DataFrame) -> DataFrame:
    """{"ref_name", "nearest_name": [...]} a line, neighbours by rank, from (a_id, b_id, rank) and (cid, name)."""
    a = cameras.select(F.col("cid").alias("a_id"), F.col("name").alias("ref_name"))
    b = cameras.select(F.col("cid").alias("b_id"), F.col("name").alias("_name"))
    listed = edges.join(b, "b_id").groupBy("a_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_name"))), lambda s: s["_name"]).alias("nearest_name"))
    full = a.join(listed, "a_id", "left").withColumn("nearest_name", F.coalesce("nearest_name", F.array().cast("array<string>")))
    return full.select(F.to_json(F.struct("ref_name", "nearest_name")).alias("value"))


def transforms_json(frames: DataFrame, **constants: float) -> DataFrame:
    """One JSON document of all frames (file_path, transform of 16) and constants; frames by file_path."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("transform", i * 4 + 1, 4))
    listed = frames.select(F.struct("file_path", rows.alias("transform_matrix")).alias("f"))
    whole = listed.agg(F.sort_array(F.collect_list("f")).alias("frames"))
    return whole.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in constants.items()], "frames")).alias("value"))


def key_file(keypoints: DataFrame) -> DataFrame:
    """Lines of a key file from (x, y, scale, angle): y before x, and 128 descriptor places of 0."""
    return keypoints.select(F.concat(F.format_string("%.2f %.2f %.3f %.3f", "y", "x", "scale", "angle"), F.lit("\n"), F.repeat(F.lit("0 "), 128)).alias("value"))


def result_json(row: DataFrame) -> DataFrame:
    """A row of scores as one JSON document, indented."""
    return row.select(F.to_json(F.struct(*row.columns), {"pretty": "true"}).alias("value"))


def per_view_json(scores: DataFrame, name: str, values: list[str]) -> DataFrame:
    """One JSON document {value: {name: score}} of all views, by name: a file by nature."""
    rows = scores.agg(F.sort_array(F.collect_list(F.struct(name, *values))).alias("_rows"))
    maps = [F.map_from_arrays(F.col("_rows")[name], F.col("_rows")[v]).alias(v) for v in values]
    return rows.select(F.to_json(F.struct(*maps)).alias("value"))


def curve_lines(curve: DataFrame, order: str, value: str) -> DataFrame:
    """(order, value): a number a line in scientific notation with 18 digits, to be written in this order."""

    @F.pandas_udf("string")
    def text(numbers: pd.Series) -> pd.Series:
        return pd.Series([f"{v:.18e}" for v in numbers], dtype=object)

    return curve.select(order, text(F.col(value).cast("double")).alias("value"))


#: Fixed values of the binary feature file: its name, its version and its end mark.
SIFT_NAME, SIFT_VERSION, SIFT_END = 1413892435, 808334422, 1179600383


def sift_files(images: DataFrame, binary: bool = True) -> DataFrame:
    """(image_id, content) from `database.keypoints_of`: a feature file of each image's first four keypoint columns and its descriptors.

    Keypoints have `cols` columns (six where that is missing). As text only places are written, with 0 for scale and angle.
    """
    @F.pandas_udf("binary")
    def content(keypoints: pd.Series, descriptors: pd.Series, cols: pd.Series) -> pd.Series:
        out = []
        for k, d, c in zip(keypoints, descriptors, cols, strict=True):
            at, marks = np.frombuffer(k, "<f4").reshape(-1, int(c)), np.frombuffer(d, np.uint8).reshape(-1, 128)
            if binary:
                head = np.array([SIFT_NAME, SIFT_VERSION, len(at), 4, 128], "<i4")
                out.append(head.tobytes() + at[:, :4].tobytes() + marks.tobytes() + np.array([SIFT_END], "<i4").tobytes())
            else:
                lines = [f"{x:f} {y:f} 0 0 {' '.join(map(str, m))}" for (x, y), m in zip(at[:, :2].tolist(), marks.tolist(), strict=True)]
                out.append("\n".join([f"{len(at)} 128", *lines, ""]).encode())
        return pd.Series(out, dtype=object)

    cols = F.coalesce(F.col("cols"), F.lit(6)) if "cols" in images.columns else F.lit(6)
    return images.select("image_id", content("keypoints", "descriptors", cols).alias("content"))


def match_columns(matched: DataFrame) -> DataFrame:
    """(text): "name1 name2 n", a line of the first indices and one of the second, from (name1, name2, matches array<struct<idx1, idx2>>)."""
    line = lambda c: F.concat(*[F.array_join(F.transform("matches", lambda m: F.concat(m[c].cast("string"), F.lit(" "))), ""), F.lit("\n")])
    head = F.concat_ws(" ", "name1", "name2", F.size("matches").cast("string"))
    return matched.select(F.concat(head, F.lit("\n"), line("idx1"), line("idx2")).alias("text"))
