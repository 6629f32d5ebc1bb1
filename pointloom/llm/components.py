"""Connected components of a graph of long ids by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.keys import unknown_key
from pointloom.llm.storage import discard, materialise


def _least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and all v of u; minima are taken before rows meet, and the join splits hubs."""
    m = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_v")).select("_u", F.least("_u", "_v").alias("m"))
    return edges.join(m, F.col("u") == unknown_key(F.col("_u"))).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = _least(down)
    return least.select("v", "m").filter("v <> m").toDF("u", "v").unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node u that isn't its component's least node v. edges: columns u and v, in any direction."""
    now, before = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now
        before, last = mark, now
        now = materialise(_small_star(_large_star(now).distinct()).distinct(), "edges")
        discard(last)
