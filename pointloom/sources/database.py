"""Feature databases in SQLite: scans with pushed projection and filter, inserts, and the statements over them."""

from __future__ import annotations

import pickle
import sqlite3
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.keys import ordered_match, pair_id, unpair
from pointloom.sources.records import located

# The tables, as SQLite's and Spark's column types.
TABLES = {
    "cameras": (("camera_id", "INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL", "int"), ("model", "INTEGER NOT NULL", "int"), ("width", "INTEGER NOT NULL", "int"), ("height", "INTEGER NOT NULL", "int"), ("params", "BLOB", "binary"), ("prior_focal_length", "INTEGER NOT NULL", "int")),
    "images": (("image_id", "INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL", "int"), ("name", "TEXT NOT NULL UNIQUE", "string"), ("camera_id", "INTEGER NOT NULL", "int")),
    "pose_priors": (("image_id", "INTEGER PRIMARY KEY NOT NULL", "int"), ("position", "BLOB", "binary"), ("coordinate_system", "INTEGER NOT NULL", "int"), ("position_covariance", "BLOB", "binary")),
    "keypoints": (("image_id", "INTEGER PRIMARY KEY NOT NULL", "int"), ("rows", "INTEGER NOT NULL", "int"), ("cols", "INTEGER NOT NULL", "int"), ("data", "BLOB", "binary")),
    "descriptors": (("image_id", "INTEGER PRIMARY KEY NOT NULL", "int"), ("rows", "INTEGER NOT NULL", "int"), ("cols", "INTEGER NOT NULL", "int"), ("data", "BLOB", "binary")),
    "matches": (("pair_id", "INTEGER PRIMARY KEY NOT NULL", "bigint"), ("rows", "INTEGER NOT NULL", "int"), ("cols", "INTEGER NOT NULL", "int"), ("data", "BLOB", "binary")),
    "two_view_geometries": (("pair_id", "INTEGER PRIMARY KEY NOT NULL", "bigint"), ("rows", "INTEGER NOT NULL", "int"), ("cols", "INTEGER NOT NULL", "int"), ("data", "BLOB", "binary"), ("config", "INTEGER NOT NULL", "int"), ("F", "BLOB", "binary"), ("E", "BLOB", "binary"), ("H", "BLOB", "binary"), ("qvec", "BLOB", "binary"), ("tvec", "BLOB", "binary")),
}


def create_statements() -> list[str]:
    return [f"CREATE TABLE IF NOT EXISTS {t} ({', '.join(f'{c} {kind}' for c, kind, _ in columns)})" for t, columns in TABLES.items()]


def scan(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A table's rows; the projection and the SQL condition are run by SQLite."""
    kinds = {c: k for c, _, k in TABLES[table]}
    columns = columns or list(kinds)
    statement = f"SELECT {', '.join(columns)} FROM {table}" + (f" WHERE {where}" if where else "")

    def rows(batches) -> Iterator:
        for pdf in batches:
            for content in pdf["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                cursor = db.execute(statement)
                while part := cursor.fetchmany(1000):
                    yield pd.DataFrame(part, columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"{c} {kinds[c]}" for c in columns))


def write_database(spark: SparkSession, path: str, tables: dict[str, DataFrame], shards: int = 1) -> None:
    """A new database with the given tables' rows; other tables are empty. Tasks build and write it, not the driver.

    A SQLite file has one writer, so a file is one task's work and is held in its memory; with more shards path becomes a folder of that
    many databases, which have the rows by hash of their first column, and which scan reads together as path/*.
    """
    union = None
    for t, df in tables.items():
        kinds = {c: k for c, _, k in TABLES[t]}
        typed = df.select(*[F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
        key = F.col(next(iter(kinds))).cast("long")
        rows = typed.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.lit(t).alias("table"), key.alias("key"), *[F.col(c) for c in kinds])

        def packed(batches, names=tuple(kinds)):
            for b in batches:
                values = [pickle.dumps(tuple(r[n] for n in names)) for r in b.select(list(names)).to_pylist()]
                yield pa.RecordBatch.from_pydict({"shard": b.column("shard"), "table": b.column("table"), "key": b.column("key"), "row": pa.array(values, pa.binary())})

        part = rows.mapInArrow(packed, "shard int, table string, key long, row binary")
        union = part if union is None else union.unionByName(part)
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit("").alias("table"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("row"))
    union = every if union is None else union.unionByName(every)

    def written(batches):
        db, now = None, None

        def close():
            db.commit()
            system, where = located(path if shards == 1 else f"{path}/{now:05d}.db")
            with system.open_output_stream(where) as f:
                f.write(db.serialize())
            db.close()

        for b in batches:
            for shard, table, row in zip(b.column("shard").to_pylist(), b.column("table").to_pylist(), b.column("row").to_pylist(), strict=True):
                if shard != now:
                    if db:
                        close()
                    db, now = sqlite3.connect(":memory:"), shard
                    for statement in create_statements():
                        db.execute(statement)
                if row is not None:
                    values = pickle.loads(row)
                    db.execute(f"INSERT INTO {table} VALUES ({', '.join('?' * len(values))})", values)
        if db:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    if shards > 1:
        system, where = located(path)
        system.create_dir(where)
    union.repartition(shards, "shard").sortWithinPartitions("shard", "table", "key").mapInArrow(written, "n long").agg(F.sum("n")).collect()


def require_keys(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with table on key; a row whose key is missing raises when the plan runs."""
    marked = rows.join(table.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return marked.withColumn("_there", F.when(F.col("_there"), F.lit(True)).otherwise(missing)).filter("_there").drop("_there")


def images_with_cameras(images: DataFrame, cameras: DataFrame) -> DataFrame:
    return require_keys(images, cameras, "camera_id")


def inlier_pairs(geometries: DataFrame, images: DataFrame, least: int = 0) -> DataFrame:
    """(name1, name2, rows) of geometries with at least `least` rows."""
    a, b = unpair(F.col("pair_id"))
    g = geometries.filter(F.col("rows") >= least).select(a.cast("int").alias("id1"), b.cast("int").alias("id2"), "rows")
    one = images.select(F.col("image_id").alias("id1"), F.col("name").alias("name1"))
    two = images.select(F.col("image_id").alias("id2"), F.col("name").alias("name2"))
    return g.join(one, "id1").join(two, "id2").select("name1", "name2", "rows")


def pair_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.concat_ws(" ", "name1", "name2").alias("line"))


def match_rows(data: Column) -> Column:
    """Unsigned 32-bit index pairs of a match blob, as array<struct<idx1, idx2>>."""
    word = lambda i: F.conv(F.hex(F.reverse(F.substring(data, i * 4 + 1, F.lit(4)))), 16, 10).cast("bigint")
    n = (F.octet_length(data) / 8).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(word(i * 2).alias("idx1"), word(i * 2 + 1).alias("idx2")))).otherwise(F.array().cast("array<struct<idx1:bigint,idx2:bigint>>"))


def match_lines(geometries: DataFrame, images: DataFrame, least: int = 0) -> DataFrame:
    """A text per geometry: both names, then a line of two indices for each match, then an empty line."""
    @F.pandas_udf("string")
    def text(data: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(f"{a} {b}" for a, b in np.frombuffer(d or b"", "<u4").reshape(-1, 2)) for d in data], dtype=object)

    a, b = unpair(F.col("pair_id"))
    g = geometries.filter(F.col("rows") >= least).select(a.cast("int").alias("id1"), b.cast("int").alias("id2"), text("data").alias("body"))
    one = images.select(F.col("image_id").alias("id1"), F.col("name").alias("name1"))
    two = images.select(F.col("image_id").alias("id2"), F.col("name").alias("name2"))
    return g.join(one, "id1").join(two, "id2").select("name1", "name2", F.concat("name1", F.lit(" "), "name2", F.lit("\n"), "body", F.lit("\n")).alias("text"))


def new_matches(pairs: DataFrame) -> DataFrame:
    """(pair_id, matches) from (image_id1, image_id2, matches array<struct<idx1, idx2>>), indices swapped with the ids."""
    a, b = F.col("image_id1"), F.col("image_id2")
    swapped = F.transform("matches", lambda m: ordered_match(a, b, m["idx1"], m["idx2"]))
    return pairs.select(pair_id(a, b).alias("pair_id"), swapped.alias("matches"))


def keypoints_of(images: DataFrame, keypoints: DataFrame, descriptors: DataFrame) -> DataFrame:
    """images with their keypoint and descriptor blobs: a null keypoint blob is none of either, a missing row raises."""
    k = require_keys(images, keypoints.select("image_id", F.col("rows").alias("n"), "cols", F.col("data").alias("keypoints")), "image_id")
    d = k.join(descriptors.select("image_id", F.col("data").alias("descriptors")), "image_id", "left")
    none = F.col("keypoints").isNull()
    missing = F.raise_error(F.concat(F.lit("no descriptors "), F.col("image_id").cast("string")))
    return d.withColumns({"n": F.when(none, 0).otherwise(F.col("n")), "descriptors": F.when(none, F.lit(b"")).when(F.col("descriptors").isNotNull(), F.col("descriptors")).otherwise(missing), "keypoints": F.coalesce("keypoints", F.lit(b""))})
