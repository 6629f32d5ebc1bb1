"""Reconstruction models: cameras, images and points with tracks, as binary or text files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.sources.files import parse_files
from pointloom.sources.records import RANGE_BYTES, beginning, in_reach, paired_lines, read_indexed, write_rows

# Camera models by id, and their numbers of parameters.
CAMERA_MODELS = (
    ("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8),
    ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12),
)

CAMERAS = "camera_id int, model string, width bigint, height bigint, params array<double>"
IMAGES = "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, obs array<struct<x:double,y:double,point3d_id:bigint>>"
POINTS = "point3d_id bigint, xyz array<double>, rgb array<int>, error double, track array<struct<image_id:int,point2d_idx:int>>"


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def name(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out


def _camera(b: _Bytes) -> tuple:
    cid, model, width, height = b.take("iiQQ")
    name, n = CAMERA_MODELS[model]
    return cid, name, width, height, list(b.take(f"{n}d"))


def _image(b: _Bytes) -> tuple:
    iid, *pose, cid = b.take("i7di")
    name = b.name()
    flat = b.take("ddq" * b.take("Q")[0])
    return iid, pose[:4], pose[4:], cid, name, [{"x": x, "y": y, "point3d_id": p} for x, y, p in zip(flat[::3], flat[1::3], flat[2::3], strict=True)]


def _point(b: _Bytes) -> tuple:
    pid, x, y, z, r, g, blue, error = b.take("Q3d3Bd")
    flat = b.take("ii" * b.take("Q")[0])
    return pid, [x, y, z], [r, g, blue], error, [{"image_id": i, "point2d_idx": j} for i, j in zip(flat[::2], flat[1::2], strict=True)]


_RECORDS = {"cameras": _camera, "images": _image, "points3D": _point}


def _whole(table: str):
    def parse(data: bytes) -> Iterator[tuple]:
        b = _Bytes(data)
        for _ in range(b.take("Q")[0]):
            yield _RECORDS[table](b)

    return parse


def _ends(data: bytes, at: int, size: int) -> int:
    """size, or -1 if data end before it does."""
    return size if at + size <= len(data) else -1


def _camera_size(data: bytes, at: int) -> int:
    return _ends(data, at, 24 + 8 * CAMERA_MODELS[struct.unpack_from("<i", data, at + 4)[0]][1]) if at + 8 <= len(data) else -1


def _image_size(data: bytes, at: int) -> int:
    name = data.find(b"\0", at + 64)
    if name < 0 or name + 9 > len(data):
        return -1
    return _ends(data, at, name + 9 - at + 24 * struct.unpack_from("<Q", data, name + 1)[0])


def _point_size(data: bytes, at: int) -> int:
    return _ends(data, at, 51 + 8 * struct.unpack_from("<Q", data, at + 43)[0]) if at + 51 <= len(data) else -1


_SIZES = {"cameras": _camera_size, "images": _image_size, "points3D": _point_size}


def _lines(data: bytes) -> list[str]:
    return [x for x in data.decode().split("\n") if not x.startswith("#")]


def _cameras_txt(data: bytes) -> Iterator[tuple]:
    for line in filter(str.strip, _lines(data)):
        cid, model, width, height, *params = line.split()
        yield int(cid), model, int(width), int(height), [float(p) for p in params]


def _images_txt(data: bytes) -> Iterator[tuple]:
    """Two lines an image; the second may be empty."""
    lines = _lines(data)
    at = 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        parts = lines[at].split(maxsplit=9)
        flat = lines[at + 1].split() if at + 1 < len(lines) else []
        obs = [{"x": float(x), "y": float(y), "point3d_id": int(p)} for x, y, p in zip(flat[::3], flat[1::3], flat[2::3], strict=True)]
        yield int(parts[0]), [float(x) for x in parts[1:5]], [float(x) for x in parts[5:8]], int(parts[8]), parts[9].strip(), obs
        at += 2


def _points_txt(data: bytes) -> Iterator[tuple]:
    for line in filter(str.strip, _lines(data)):
        p = line.split()
        track = [{"image_id": int(i), "point2d_idx": int(j)} for i, j in zip(p[8::2], p[9::2], strict=True)]
        yield int(p[0]), [float(x) for x in p[1:4]], [int(x) for x in p[4:7]], float(p[7]), track


_PARSERS = {**{(t, "bin"): _whole(t) for t in _RECORDS}, ("cameras", "txt"): _cameras_txt, ("images", "txt"): _images_txt, ("points3D", "txt"): _points_txt}
_SCHEMAS = {"cameras": CAMERAS, "images": IMAGES, "points3D": POINTS}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def detect_format(spark: SparkSession, folder: str) -> str:
    """'bin' if the folder has all three binary files, 'txt' if all three text files."""
    for kind in ("bin", "txt"):
        if all(_exists(spark, f"{folder}/{t}.{kind}") for t in _SCHEMAS):
            return kind
    raise FileNotFoundError(f"no model in {folder}")


def _numbers(words: Column, first: int, every: int, kind: str) -> Column:
    """words[first], words[first + every], ..., as numbers."""
    return F.transform(F.filter(words, lambda _, i: (i >= first) & ((i - first) % every == 0)), lambda x: x.cast(kind))


def _text_rows(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A text file's rows, read line by line (images: by pairs of lines) in ranges."""
    zipped = lambda fields, *columns: F.transform(F.arrays_zip(*columns), lambda z: F.struct(*[z[str(i)].alias(n) for i, n in enumerate(fields)]))
    if table == "images":
        w, v = F.split(F.trim("head"), r"\s+", 10), F.filter(F.split("tail", r"\s+"), lambda x: x != "")
        at = lambda i, kind: w[i].cast(kind)
        obs = zipped(("x", "y", "point3d_id"), _numbers(v, 0, 3, "double"), _numbers(v, 1, 3, "double"), _numbers(v, 2, 3, "long"))
        return paired_lines(spark, path).select(at(0, "int").alias("image_id"), F.array(*[at(i, "double") for i in range(1, 5)]).alias("qvec"), F.array(*[at(i, "double") for i in range(5, 8)]).alias("tvec"), at(8, "int").alias("camera_id"), F.trim(w[9]).alias("name"), obs.alias("obs"))
    lines = spark.read.text(path).filter(~F.startswith(F.col("value"), F.lit("#")) & (F.trim("value") != ""))
    w = F.split(F.trim("value"), r"\s+")
    if table == "cameras":
        return lines.select(w[0].cast("int").alias("camera_id"), w[1].alias("model"), w[2].cast("long").alias("width"), w[3].cast("long").alias("height"), _numbers(w, 4, 1, "double").alias("params"))
    track = zipped(("image_id", "point2d_idx"), _numbers(w, 8, 2, "int"), _numbers(w, 9, 2, "int"))
    return lines.select(w[0].cast("long").alias("point3d_id"), F.transform(F.slice(w, 2, 3), lambda x: x.cast("double")).alias("xyz"), F.transform(F.slice(w, 5, 3), lambda x: x.cast("int")).alias("rgb"), w[7].cast("double").alias("error"), track.alias("track"))


def read_model(spark: SparkSession, folder: str, kind: str = "auto", range_bytes: int = RANGE_BYTES) -> dict[str, DataFrame]:
    """The model's three tables. Files are read in ranges of bytes; only what pyarrow can't reach is read whole, a file a task."""
    kind = detect_format(spark, folder) if kind == "auto" else kind
    out = {}
    for t, schema in _SCHEMAS.items():
        path = f"{folder}/{t}.{kind}"
        if not in_reach(path):
            out[t] = parse_files(spark, path, _PARSERS[t, kind], schema).drop("path")
        elif kind == "txt":
            out[t] = _text_rows(spark, t, path)
        else:
            out[t] = read_indexed(spark, path, 8, struct.unpack("<Q", beginning(path, 8))[0], _SIZES[t], lambda data, t=t: _RECORDS[t](_Bytes(data)), schema, range_bytes)
    return out


def read_points_text(spark: SparkSession, path: str, most_error: float | None = 2.0) -> DataFrame:
    """(xyz, rgb, error) of a points text file, line by line; only errors up to `most_error`, if given."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.startswith(F.col("value"), F.lit("#")) & (F.trim("value") != ""))
    rows = rows.select(F.transform(F.slice(p, 2, 3), lambda x: x.cast("double")).alias("xyz"), F.transform(F.slice(p, 5, 3), lambda x: x.cast("int")).alias("rgb"), p[7].cast("double").alias("error"))
    return rows.filter(F.col("error") <= most_error) if most_error is not None else rows


def require_models(cameras: DataFrame, models: tuple[str, ...] = ("PINHOLE", "SIMPLE_PINHOLE")) -> DataFrame:
    """cameras, raising on the first row of another model when the plan runs."""
    return cameras.withColumn("model", F.when(F.col("model").isin(*models), F.col("model")).otherwise(F.raise_error(F.concat(F.lit("camera model "), F.col("model")))))


def _camera_bytes(r) -> bytes:
    model = next(i for i, (name, _) in enumerate(CAMERA_MODELS) if name == r["model"])
    return struct.pack(f"<iiQQ{len(r['params'])}d", r["camera_id"], model, r["width"], r["height"], *r["params"])


def _image_bytes(r) -> bytes:
    head = struct.pack("<i7di", r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0"
    return head + struct.pack("<Q", len(r["obs"])) + b"".join(struct.pack("<ddq", o["x"], o["y"], o["point3d_id"]) for o in r["obs"])


def _point_bytes(r) -> bytes:
    return struct.pack("<Q3d3BdQ", r["point3d_id"], *r["xyz"], *r["rgb"], r["error"], len(r["track"])) + b"".join(struct.pack("<ii", t["image_id"], t["point2d_idx"]) for t in r["track"])


def _camera_text(r) -> str:
    return " ".join(map(str, (r["camera_id"], r["model"], r["width"], r["height"], *r["params"])))


def _image_text(r) -> str:
    head = " ".join(map(str, (r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"], r["name"])))
    return head + "\n" + " ".join(f"{o['x']} {o['y']} {o['point3d_id']}" for o in r["obs"])


def _point_text(r) -> str:
    return " ".join(map(str, (r["point3d_id"], *r["xyz"], *r["rgb"], r["error"], *[x for t in r["track"] for x in (t["image_id"], t["point2d_idx"])])))


_KEYS = {"cameras": "camera_id", "images": "image_id", "points3D": "point3d_id"}
_BYTES = {"cameras": _camera_bytes, "images": _image_bytes, "points3D": _point_bytes}
_TEXT = {"cameras": _camera_text, "images": _image_text, "points3D": _point_text}
_ABOUT = {"cameras": "CAMERA_ID MODEL WIDTH HEIGHT PARAMS[]", "images": "IMAGE_ID QW QX QY QZ TX TY TZ CAMERA_ID NAME, then POINTS2D[] as X Y POINT3D_ID", "points3D": "POINT3D_ID X Y Z R G B ERROR TRACK[] as IMAGE_ID POINT2D_IDX"}


def mean_list_size(df: DataFrame, column: str) -> float:
    """Observations an image, or images a track; 0 for an empty table."""
    return df.agg(F.avg(F.size(column))).first()[0] or 0.0


def write_model(model: dict[str, DataFrame], folder: str, kind: str = "bin") -> None:
    """The model's three files by id, each record encoded and written by a task."""
    for t, df in model.items():
        n = df.count()
        if kind == "bin":
            head, encode = struct.pack("<Q", n), _BYTES[t]
        else:
            extra = {"images": "obs", "points3D": "track"}.get(t)
            head = (f"# {_ABOUT[t]}\n# Number: {n}" + (f", mean list: {mean_list_size(df, extra)}" if extra else "") + "\n").encode()
            encode = lambda r, t=t: f"{_TEXT[t](r)}\n".encode()
        write_rows(df, f"{folder}/{t}.{kind}", head, encode, _KEYS[t])
