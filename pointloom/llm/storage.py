"""Lineage cuts and gapless numbering that several operators share."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import is_remote


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs in one process (tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset: executors of {master or 'a cluster'} need a folder that all of them see")
        found = tempfile.mkdtemp(prefix="pointloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the driver's JVM ends (a remote session leaves it to its cluster)."""
    path = f"{shared_dir(spark)}/pointloom/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    if is_remote():
        return path
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lineage cut that outlives any executor."""
    spark, schema = df.sparkSession, df.schema
    path = fresh_path(spark, name)
    df.write.parquet(path)
    del df
    gc.collect()
    if not is_remote():
        spark.sparkContext._jvm.System.gc()  # Spark drops the shuffle files of plans that are no longer referenced
    out = spark.read.schema(schema).parquet(path)
    out._pl_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what materialise wrote for these tables; nothing may read them any more. Others are left alone."""
    for df in tables:
        path = getattr(df, "_pl_path", None)
        if path:
            drop_paths(df.sparkSession, [path])


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        if path in _MADE:
            _MADE.remove(path)
        if not is_remote():
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Paths that are in use, in the order in which they were made.
_MADE: list[str] = []


def in_use() -> list[str]:
    return list(_MADE)


def number_gapless(df: DataFrame, out: str, groups: list[str], lot: Column, order: list[Column]) -> DataFrame:
    """Add `out`: 0, 1, 2, ... within each combination of `groups`, by `lot` and then by `order`.

    `lot` is an integer expression that cuts a group into lots; only the rows of one lot meet in a
    task, so a hot group never does. The lots' sizes are counted first and their running sum gives
    every lot its first number. The counts (groups x lots rows) are joined back, not collected.
    """
    df = df.withColumn("_ng_lot", lot)
    sizes = df.groupBy(*groups, "_ng_lot").agg(F.count(F.lit(1)).alias("_ng_size"))
    before = Window.partitionBy(*groups).orderBy("_ng_lot").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*groups, "_ng_lot", F.coalesce(F.sum("_ng_size").over(before), F.lit(0)).alias("_ng_base"))
    bases = bases.select(*[F.col(c).alias(f"_ng_g{i}") for i, c in enumerate(groups)], F.col("_ng_lot").alias("_ng_glot"), "_ng_base")
    on = F.col("_ng_lot") == F.col("_ng_glot")
    for i, c in enumerate(groups):
        on = on & F.col(c).eqNullSafe(F.col(f"_ng_g{i}"))
    inside = Window.partitionBy(*groups, "_ng_lot").orderBy(*order)
    ranked = df.withColumn("_ng_rank", F.row_number().over(inside).cast("long"))
    joined = ranked.join(bases, on, "inner")
    return joined.withColumn(out, F.col("_ng_base") + F.col("_ng_rank") - 1).drop("_ng_lot", "_ng_rank", "_ng_base", "_ng_glot", *[f"_ng_g{i}" for i in range(len(groups))])
