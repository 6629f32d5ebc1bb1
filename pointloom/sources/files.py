"""Whole files as rows, through Spark's own file systems."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def parse_files(spark: SparkSession, path: str, parse: Callable[[bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of parse(content) of every file that path names, each file in one task, with `path` in front."""
    names = [x.split()[0] for x in _columns(schema)]

    def rows(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                out: list[tuple] = []
                for row in parse(bytes(content)):
                    out.append((file, *row))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["path", *names])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["path", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, f"path string, {schema}")


def _columns(schema: str) -> list[str]:
    """The top-level columns of a DDL string."""
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]
