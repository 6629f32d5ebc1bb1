"""PLY vertex and face tables, ASCII and binary little-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.sources.files import parse_files
from pointloom.sources.records import RANGE_BYTES, beginning, in_reach, read_fixed, read_indexed, write_records

#: A header is no longer.
HEADER_BYTES = 1 << 16

# PLY's scalar types as struct codes.
CODES = {"char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d"}


def header(data: bytes) -> tuple[str, list[tuple[str, int, list[tuple]]], int]:
    """(format, elements as (name, count, properties), where the data begin)."""
    end = data.index(b"end_header")
    body = data.index(b"\n", end) + 1
    form, elements = "", []
    for line in data[:end].decode().splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append(("list", CODES[w[2]], CODES[w[3]], w[4]) if w[1] == "list" else ("scalar", CODES[w[1]], w[2]))
    return form, elements, body


def records(data: bytes, element: str) -> Iterator[dict]:
    form, elements, at = header(data)
    if form not in ("ascii", "binary_little_endian"):
        raise ValueError(f"PLY format {form}")
    tokens = iter(data[at:].split()) if form == "ascii" else None
    for name, count, props in elements:
        flat = all(p[0] == "scalar" for p in props)
        layout = struct.Struct("<" + "".join(p[1] for p in props)) if flat else None
        for _ in range(count):
            row: dict = {}
            if tokens is not None:
                for p in props:
                    read = lambda code: float(next(tokens)) if code in "fd" else int(next(tokens))
                    row[p[-1]] = [read(p[2]) for _ in range(int(next(tokens)))] if p[0] == "list" else read(p[1])
            elif flat:
                row = dict(zip((p[2] for p in props), layout.unpack_from(data, at), strict=True))
                at += layout.size
            else:
                for p in props:
                    if p[0] == "scalar":
                        row[p[2]] = struct.unpack_from("<" + p[1], data, at)[0]
                        at += struct.calcsize(p[1])
                    else:
                        n = struct.unpack_from("<" + p[1], data, at)[0]
                        at += struct.calcsize(p[1])
                        row[p[3]] = list(struct.unpack_from(f"<{n}{p[2]}", data, at))
                        at += n * struct.calcsize(p[2])
            if name == element:
                yield row


def _flat_start(data: bytes, element: str) -> tuple[int, int, list[tuple[str, str]]] | None:
    """(where the element's records begin, their number, numpy's types) if all before it and itself have records of one length."""
    form, elements, at = header(data)
    if form != "binary_little_endian":
        return None
    for name, count, props in elements:
        if any(p[0] != "scalar" for p in props):
            return None
        if name == element:
            return at, count, [(p[2], np.dtype("<" + p[1]).str) for p in props]
        at += count * struct.calcsize("<" + "".join(p[1] for p in props))
    return None


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame | None:
    """(vid, columns...) of one binary file's vertices, read in ranges of bytes, only the wanted columns unpacked; None for others."""
    found = _flat_start(beginning(path, HEADER_BYTES), "vertex") if in_reach(path) else None
    if not found:
        return None
    names = [n for n, _ in found[2]]
    return read_fixed(spark, path, *found, [c for c in (columns or names) if c in names], range_bytes).withColumnRenamed("row", "vid")


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(path, vid, properties): every vertex with its numbers by name, so that files of any layout fit one schema."""
    rows = read_columns(spark, path)
    if rows is not None:
        named = [x for c in rows.columns if c != "vid" for x in (F.lit(c), F.col(f"`{c}`").cast("double"))]
        return rows.select(F.lit(path).alias("path"), "vid", F.create_map(*named).alias("properties"))
    parse = lambda data: ((i, {k: float(v) for k, v in r.items()}) for i, r in enumerate(records(data, "vertex")))
    return parse_files(spark, path, parse, "vid bigint, properties map<string,double>")


def _list_size(props: list[tuple]):
    """The length of a record with lists among its properties."""

    def size(data: bytes, at: int) -> int:
        begin = at
        for p in props:
            if at + struct.calcsize("<" + p[1]) > len(data):
                return -1
            n = struct.unpack_from("<" + p[1], data, at)[0] if p[0] == "list" else 0
            at += struct.calcsize("<" + p[1]) + (n * struct.calcsize("<" + p[2]) if p[0] == "list" else 0)
        return at - begin if at <= len(data) else -1

    return size


def _list_of(props: list[tuple]):
    """The first list of a record."""

    def parse(data: bytes) -> tuple:
        at = 0
        for p in props:
            if p[0] == "list":
                n = struct.unpack_from("<" + p[1], data, at)[0]
                return (list(struct.unpack_from(f"<{n}{p[2]}", data, at + struct.calcsize("<" + p[1]))),)
            at += struct.calcsize("<" + p[1])
        raise ValueError("no list among the properties")

    return parse


def read_faces(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, fid, vertices). A binary file with vertices and then faces is walked over once for the ranges of its faces, which are
    parsed side by side; other files are read whole, a file a task."""
    if in_reach(path):
        data = beginning(path, HEADER_BYTES)
        form, elements, at = header(data)
        if form == "binary_little_endian" and [e[0] for e in elements[:2]] == ["vertex", "face"] and _flat_start(data, "vertex"):
            at += elements[0][1] * struct.calcsize("<" + "".join(p[1] for p in elements[0][2]))
            rows = read_indexed(spark, path, at, elements[1][1], _list_size(elements[1][2]), _list_of(elements[1][2]), "vertices array<int>", range_bytes, number="fid")
            return rows.select(F.lit(path).alias("path"), "fid", "vertices")

    def parse(data: bytes):
        for i, r in enumerate(records(data, "face")):
            yield i, next(v for v in r.values() if isinstance(v, list))

    return parse_files(spark, path, parse, "fid bigint, vertices array<int>")


def read_point_cloud(spark: SparkSession, path: str) -> DataFrame:
    """(vid, x, y, z, rgb in [0, 1])."""
    rows = read_columns(spark, path, ["x", "y", "z", "red", "green", "blue"])
    if rows is not None:
        return rows.select("vid", *[F.col(c).cast("double") for c in "xyz"], F.array(*[F.col(c).cast("double") / 255 for c in ("red", "green", "blue")]).alias("rgb"))
    p = F.col("properties")
    return read_vertices(spark, path).select("vid", *[p[c].alias(c) for c in "xyz"], F.array(*[p[c] / 255 for c in ("red", "green", "blue")]).alias("rgb"))


def numbered(prefix: str):
    """The properties called prefix0, prefix1, ... in the order of their numbers, as an array."""
    names = F.filter(F.map_keys("properties"), lambda k: F.startswith(k, F.lit(prefix)))
    order = F.array_sort(F.transform(names, lambda k: F.struct(F.substring_index(k, "_", -1).cast("int").alias("i"), k.alias("k"))))
    return F.transform(order, lambda s: F.col("properties")[s["k"]])


def read_particles(spark: SparkSession, path: str) -> DataFrame:
    """(gid, xyz, opacity, f_dc, f_rest, log_scales, rotation)."""
    p = F.col("properties")
    return read_vertices(spark, path).select(F.col("vid").alias("gid"), F.array(*[p[c] for c in "xyz"]).alias("xyz"), p["opacity"].alias("opacity"), *[numbered(f"{n}_").alias(out) for n, out in (("f_dc", "f_dc"), ("f_rest", "f_rest"), ("scale", "log_scales"), ("rot", "rotation"))])


def write_ply(df: DataFrame, path: str, columns: dict[str, str], order: str, binary: bool = True) -> None:
    """One PLY file of vertices; columns: names to PLY types, in order. Records are packed and written by tasks."""
    form = "binary_little_endian" if binary else "ascii"
    head = "".join([f"ply\nformat {form} 1.0\nelement vertex {df.count()}\n", *[f"property {t} {c}\n" for c, t in columns.items()], "end_header\n"]).encode()
    if not binary:
        words = [F.col(f"`{c}`").cast("long" if CODES[t] not in "fd" else "double").cast("string") for c, t in columns.items()]
        return write_records(df, path, head, F.encode(F.concat(F.concat_ws(" ", *words), F.lit("\n")), "UTF-8"), [order])
    layout = np.dtype([(c, "<" + CODES[t]) for c, t in columns.items()])

    def packed(batches):
        for b in batches:
            block = np.empty(len(b), layout)
            for c in columns:
                block[c] = b.column(c).to_numpy(zero_copy_only=False)
            data = block.tobytes()
            yield pa.RecordBatch.from_pydict({"_order": b.column("_order"), "record": pa.array([data[i : i + layout.itemsize] for i in range(0, len(data), layout.itemsize)], pa.binary())})

    rows = df.select(F.col(order).alias("_order"), *[F.col(f"`{c}`") for c in columns])
    write_records(rows.mapInArrow(packed, f"_order {dict(df.dtypes)[order]}, record binary"), path, head, "record", ["_order"])


def write_particles(df: DataFrame, path: str) -> None:
    """Particles of read_particles' columns; normals are written as zeros."""
    first = df.first()
    sizes = {n: len(first[c]) if first else k for n, c, k in (("f_dc", "f_dc", 3), ("f_rest", "f_rest", 45), ("scale", "log_scales", 3), ("rot", "rotation", 4))}
    flat = {c: F.col("xyz")[i] for i, c in enumerate("xyz")} | {f"n{c}": F.lit(0.0) for c in "xyz"}
    for n, c in (("f_dc", "f_dc"), ("f_rest", "f_rest")):
        flat |= {f"{n}_{i}": F.col(c)[i] for i in range(sizes[n])}
    flat["opacity"] = F.col("opacity")
    for n, c in (("scale", "log_scales"), ("rot", "rotation")):
        flat |= {f"{n}_{i}": F.col(c)[i] for i in range(sizes[n])}
    write_ply(df.select("gid", *[v.alias(k) for k, v in flat.items()]), path, {k: "float" for k in flat}, "gid")


def write_point_cloud(df: DataFrame, path: str) -> None:
    """(vid, x, y, z, rgb 0 to 255)."""
    colours = {c: F.col("rgb")[i].cast("int").alias(c) for i, c in enumerate(("red", "green", "blue"))}
    flat = df.select("vid", "x", "y", "z", *[F.lit(0.0).alias(f"n{c}") for c in "xyz"], *colours.values())
    write_ply(flat, path, {**{c: "float" for c in ("x", "y", "z", "nx", "ny", "nz")}, **{c: "uchar" for c in colours}}, "vid")


def concat_point_clouds(frames: list[DataFrame]) -> DataFrame:
    """All points of several clouds, numbered anew by cloud and place."""
    from functools import reduce

    from pyspark.sql import Window

    union = reduce(DataFrame.unionByName, [f.withColumn("_cloud", F.lit(i)) for i, f in enumerate(frames)])
    sizes = union.groupBy("_cloud").agg((F.max("vid") + 1).alias("_n"))
    base = sizes.select("_cloud", F.coalesce(F.sum("_n").over(Window.orderBy("_cloud").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return union.join(F.broadcast(base), "_cloud").withColumn("vid", F.col("vid") + F.col("_b")).drop("_cloud", "_b")  # a row per cloud
