"""Places, running sums and quantiles in the order of a column, without a task that sees the whole table.

Rows are written out in range partitions once; what lies before a partition is the sum of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.checkpoints import cut


def in_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """df range-partitioned by keys, with the partition's number `_order_part`, written out once.

    Both uses of it must see the same ranges: sampled again, their bounds would differ.
    """
    return cut(df.repartitionByRange(*keys).withColumn("_order_part", F.spark_partition_id()))


def _before(parts: DataFrame, each: Column) -> DataFrame:
    """(_order_of, _order_sum, _order_before): the sum of `each` over a partition and over those before; a row per partition."""
    sums = parts.groupBy("_order_part").agg(each.alias("_order_sum"))
    earlier = Window.orderBy("_order_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("_order_part").alias("_order_of"), "_order_sum", F.coalesce(F.sum("_order_sum").over(earlier), F.lit(0)).alias("_order_before"))


def prefix_sum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over all rows up to and with this one in the order of key (rows of one key together).

    Null keys come first.
    """
    parts = in_ranges(df, key)
    inside = parts.withColumn("_order_run", F.sum(value).over(Window.partitionBy("_order_part").orderBy(key)))
    joined = inside.join(F.broadcast(_before(parts, F.sum(value))), F.col("_order_part") == F.col("_order_of"))  # a row per partition
    return joined.withColumn(out, F.col("_order_before") + F.col("_order_run")).drop("_order_part", "_order_of", "_order_sum", "_order_before", "_order_run")


def numbered(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Add `out`: the row's place, from 0, in the order of keys. Rows of equal keys are numbered in any order."""
    parts = in_ranges(df, *keys)
    inside = parts.withColumn("_order_place", F.row_number().over(Window.partitionBy("_order_part").orderBy(*keys)) - 1)
    joined = inside.join(F.broadcast(_before(parts, F.count(F.lit(1)))), F.col("_order_part") == F.col("_order_of"))  # a row per partition
    return joined.withColumn(out, F.col("_order_before") + F.col("_order_place")).drop("_order_part", "_order_place", "_order_of", "_order_sum", "_order_before")


def value_ends(df: DataFrame, value: str) -> DataFrame:
    """(value, _n, _end, _total): each value that isn't null, its rows, the rows up to it, and all rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ends = prefix_sum(counts, value, "_n", "_end")
    return ends.join(F.broadcast(ends.agg(F.sum("_n").alias("_total"))))  # one row


def _between(a: Column, b: Column, position: Column) -> Column:
    low, high = F.floor(position), F.ceil(position)
    return F.when((low == high) | (a == b), a).otherwise((high - position) * a + (position - low) * b)


def quantiles(df: DataFrame, value: str, fractions: list[float], out: str = "_q") -> DataFrame:
    """One row with `out`, the exact linearly interpolated quantiles as an array; nulls don't count, NaN is the largest.

    Values are counted, the counts put in ranges, and of these only the ranges that hold a wanted place are sorted.
    Without values all quantiles are null.
    """
    counts = df.select(F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    parts = in_ranges(counts, "_v")
    places = [(F.col("_total") - 1) * float(p) for p in fractions]
    ends = [(f"_{side}{i}", end(place)) for i, place in enumerate(places) for side, end in (("a", F.floor), ("b", F.ceil))]
    spans = _before(parts, F.sum("_n"))
    spans = spans.join(F.broadcast(spans.agg(F.sum("_order_sum").alias("_total"))))  # one row
    held = F.lit(False)
    for _, place in ends:
        held = held | ((place >= F.col("_order_before")) & (place < F.col("_order_before") + F.col("_order_sum")))
    rows = parts.join(F.broadcast(spans.filter(held)), F.col("_order_part") == F.col("_order_of"))  # a row per partition at most
    through = F.col("_order_before") + F.sum("_n").over(Window.partitionBy("_order_part").orderBy("_v"))
    row = rows.withColumn("_end", through).agg(F.max("_total").alias("_total"), *[F.min(F.when(F.col("_end") > place, F.col("_v"))).alias(name) for name, place in ends])
    return row.select(F.array(*[_between(F.col(f"_a{i}"), F.col(f"_b{i}"), place) for i, place in enumerate(places)]).alias(out))


def group_quantiles(df: DataFrame, by: list[str], value: str, fraction: float, out: str = "_q") -> DataFrame:
    """(by..., out): each group's quantile. Counts of (group, value) are put in order, so that a hot group is split."""
    counts = df.select(*by, F.col(value).cast("double").alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")).filter("_v IS NOT NULL")
    ends = prefix_sum(counts.withColumn("_at", F.struct(*by, "_v")), "_at", "_n", "_end").drop("_at")
    groups = ends.groupBy(*by).agg(F.sum("_n").alias("_total"), F.min(F.col("_end") - F.col("_n")).alias("_start"))
    inside = ends.join(groups, by).withColumn("_end", F.col("_end") - F.col("_start"))
    place = (F.col("_total") - 1) * float(fraction)
    picked = inside.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        F.min(F.when(F.col("_end") > F.floor(place), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_end") > F.ceil(place), F.col("_v"))).alias("_b"),
    )
    return picked.select(*by, _between(F.col("_a"), F.col("_b"), place).alias(out))
