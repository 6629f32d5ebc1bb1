"""Where lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import is_remote


def _folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them see")
        found = tempfile.mkdtemp(prefix="pointloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared folder, deleted when the driver's JVM ends."""
    path = f"{_folder(spark)}/pointloom/{name}-{uuid.uuid4().hex}"
    if not is_remote():
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the session's shared folder and read back; deleted when the driver's JVM ends."""
    spark, schema = df.sparkSession, df.schema
    path = fresh_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
