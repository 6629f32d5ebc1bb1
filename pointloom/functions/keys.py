"""Pair ids, Morton codes and binary columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ids are below it.
PAIR_BASE = 2147483647


def unknown_key(key: Column) -> Column:
    """A long key as an expression that Spark can't tell to be the key.

    A join on it of rows with an aggregate by the same key shuffles the aggregate once more, so that both sides are plain
    shuffles. Only then does adaptive execution split the rows of a hot key.
    """
    return key.bitwiseXOR(F.lit(0).cast("long"))


def pair_id(a: Column, b: Column) -> Column:
    return F.least(a, b).cast("bigint") * F.lit(PAIR_BASE).cast("bigint") + F.greatest(a, b).cast("bigint")


def unpair(pair: Column) -> tuple[Column, Column]:
    """The two ids in whole numbers."""
    b = pair % F.lit(PAIR_BASE).cast("bigint")
    return ((pair - b).cast("decimal(20,0)") / F.lit(PAIR_BASE).cast("decimal(20,0)")).cast("bigint"), b


def ordered_match(a: Column, b: Column, first: Column, second: Column) -> Column:
    """(idx1, idx2) of a match for the pair id of images a and b: swapped where a > b."""
    return F.when(a > b, F.struct(second.alias("idx1"), first.alias("idx2"))).otherwise(F.struct(first.alias("idx1"), second.alias("idx2")))


def _spread(v: Column) -> Column:
    v = v.cast("bigint")
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def morton3(x: Column, y: Column, z: Column, lo: list[Column], hi: list[Column]) -> Column:
    """30-bit Morton code, ten bits an axis, of a point within the box lo to hi."""

    def cell(v: Column, a: Column, b: Column) -> Column:
        return F.when(b > a, ((v - a) / F.nullif(b - a, F.lit(0.0)) * 1023)).otherwise(0).cast("bigint")

    cells = [_spread(cell(v, a, b)) for v, a, b in zip((x, y, z), lo, hi, strict=True)]
    return cells[0].bitwiseOR(F.shiftleft(cells[1], 1)).bitwiseOR(F.shiftleft(cells[2], 2))


def blob_to_array(dtype: str, element: str = "double"):
    """Arrow UDF: little-endian binary to a flat array; null stays null."""

    @F.pandas_udf(f"array<{element}>")
    def decode(blob: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.frombuffer(b, dtype) for b in blob], dtype=object)

    return decode


def array_to_blob(dtype: str):
    """Arrow UDF: a flat array to little-endian binary; null stays null."""

    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v).astype(dtype).tobytes() for v in values], dtype=object)

    return encode
