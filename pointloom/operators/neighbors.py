"""Nearest, radius and gated neighbours.

In a few dimensions points are hashed to cells as wide as the search radius, so a search is an equi-join on the 27
cells around a point. In many dimensions cells go by pivots, and the triangle inequality says which a query has to meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions import eigen
from pointloom.functions import vectors as V
from pointloom.operators import metric
from pointloom.operators.checkpoints import cut


def _cells(width: float, xyz: tuple[str, ...]) -> list[Column]:
    return [F.floor(F.col(c) / width).cast("long") for c in xyz]


def radius_pairs(a: DataFrame, b: DataFrame, radius: float, a_id: str = "pid", b_id: str = "pid", xyz: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(a_id, b_id, dist): every pair within the radius, equal points included."""
    names = [f"_c{i}" for i in range(len(xyz))]
    left = a.select(F.col(a_id).alias("a_id"), *[F.col(c).alias(f"_a{i}") for i, c in enumerate(xyz)], *[c.alias(n) for c, n in zip(_cells(radius, xyz), names, strict=True)])
    right = b.select(F.col(b_id).alias("b_id"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(xyz)], *[c.alias(f"_o{i}") for i, c in enumerate(_cells(radius, xyz))])
    for i, n in enumerate(names):
        right = right.withColumn(n, F.explode(F.array(*[F.col(f"_o{i}") + d for d in (-1, 0, 1)])))
    dist = F.sqrt(V.total([(F.col(f"_a{i}") - F.col(f"_b{i}")) * (F.col(f"_a{i}") - F.col(f"_b{i}")) for i in range(len(xyz))]))
    return left.join(right, names).withColumn("dist", dist).filter(F.col("dist") <= radius).select("a_id", "b_id", "dist")


def nearest_within(a: DataFrame, b: DataFrame, cap: float, a_id: str = "pid", b_id: str = "pid", xyz: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(a_id, b_id, dist): the nearest b of each a up to the cap, the smaller b_id on ties; a alone has none.

    Only the nearest of a point and a tile of rows become rows (see `knn`), so dense points don't meet in pairs.
    """
    near = knn(_vectors(a, a_id, xyz), _vectors(b, b_id, xyz), 1, "v", "id", "id", skip_self=False)
    return near.select("a_id", "b_id", F.sqrt("d2").alias("dist")).filter(F.col("dist") <= cap)


def _vectors(points: DataFrame, pid: str, xyz: tuple[str, ...]) -> DataFrame:
    return points.select(F.col(pid).alias("id"), F.array(*[F.col(c).cast("double") for c in xyz]).alias("v"))


def _merge_nearest(df: DataFrame, k: int, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("d2", "b_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, rows: DataFrame, k: int, vector: str, q_id: str, r_id: str, skip_self: bool = True) -> DataFrame:
    """(a_id, b_id, d2, rank): exact k nearest rows of each query by squared distance, smaller ids first on ties.

    A query first meets the tiles of the cells whose pivots are nearest and which hold k others together; the k-th distance there bounds
    the cells that it has to meet at all (see operators.metric). Only the k best of a query and a piece of a tile become
    rows. Vectors with nulls or NaN are left out.
    """
    r, pivots, radii, sizes = metric.indexed(rows, r_id, {"v": vector}, "v")
    q = metric.sound(queries.select(F.col(q_id).cast("long").alias("id"), F.col(vector).alias("v")), ["v"])
    empty = q.select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank")).limit(0)
    if not len(pivots):
        return empty
    tile = metric.tiles(pivots, sizes)

    def search(a, b):
        i, j, d = metric.k_nearest(a, b, "v", k, skip_self, a.get("most"))
        return i, j, [d]

    first = cut(_home(q, pivots, sizes, k + 1).withColumn("tiles", metric.tiles_met("cells", tile)).drop("cells"))
    near = cut(_merge_nearest(metric.meet(first, r, sizes, tile, ["v"], search, "d2 double"), k, ["a_id"]).drop("rank"))
    reach = near.groupBy("a_id").agg(F.when(F.count(F.lit(1)) == k, F.sqrt(F.max("d2"))).alias("_most"))
    bounded = first.join(reach, F.col("id") == F.col("a_id"), "left").withColumn("most", F.coalesce("_most", F.lit(float("inf")))).select("id", "v", F.col("tiles").alias("seen"), "most")
    rest = _rest(bounded, "v", pivots, radii, sizes, tile)
    return _merge_nearest(near.unionByName(metric.meet(rest, r, sizes, tile, ["v"], search, "d2 double", ["most"])), k, ["a_id"])


def _home(q: DataFrame, pivots: np.ndarray, sizes: np.ndarray, enough: int, by: str = "v") -> DataFrame:
    """q with cells: those of the nearest pivots, as many as hold `enough` rows together."""

    def home(batches):
        for x in batches:
            if len(x):
                v, lists = metric.matrix(x.column(by)), []
                for at in range(0, len(v), max(1, metric.MATRIX // len(pivots))):
                    d = metric.squared(v[at : at + max(1, metric.MATRIX // len(pivots))], pivots)
                    d[:, sizes == 0] = np.inf
                    order = np.argsort(d, axis=1, kind="stable")
                    n = (np.cumsum(sizes[order], axis=1) < enough).sum(1) + 1
                    lists += [o[:m].astype(np.int32).tolist() for o, m in zip(order, np.minimum(n, (sizes > 0).sum()))]
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(lists, pa.list_(pa.int32()))], [*x.schema.names, "cells"])

    return q.mapInArrow(home, metric.wider(q, cells=T.ArrayType(T.IntegerType())))


def _rest(bounded: DataFrame, by: str, pivots: np.ndarray, radii: np.ndarray, sizes: np.ndarray, tile: np.ndarray) -> DataFrame:
    """bounded (..., seen, most) with the other tiles of the cells that may hold a row within `most`; queries without any are gone."""
    near = metric.cells_within(bounded, by, pivots, radii, "most", sizes > 0)
    left = near.withColumn("tiles", F.array_except(metric.tiles_met("cells", tile), "seen")).drop("cells", "seen")
    return cut(left.filter(F.size("tiles") > 0))


def knn_grid(points: DataFrame, k: int, width: float, pid: str = "pid", xyz: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(a_id, b_id, d2, rank): exact k nearest others of each point in a few dimensions, by `knn`.

    A grid of fixed cells holds ever more points in each as a cloud grows denser, and meets them in pairs; the cells around pivots
    follow the points. `width` says how wide such cells were and has no effect.
    """
    v = _vectors(points, pid, xyz)
    return knn(v, v, k, "v", "id", "id")


def mean_nearest(neighbours: DataFrame, k: int = 3) -> DataFrame:
    """(a_id, mean_d2): the mean squared distance of the k nearest; null where there are fewer."""
    g = neighbours.groupBy("a_id").agg(F.avg("d2").alias("_m"), F.count(F.lit(1)).alias("_n"))
    return g.select("a_id", F.when(F.col("_n") >= k, F.col("_m")).alias("mean_d2"))


def gated_neighbors(cameras: DataFrame, centre: str, axis: str, cid: str, near: float = 0.01, far: float = 1.5, degrees: float = 30.0, most: int = 8) -> DataFrame:
    """(a_id, b_id, dist, angle, rank): of each camera up to `most` others with near < dist < far and angle < degrees,
    by distance and then angle. NaN angles and cameras without an axis pass no gate.

    A camera first meets the tile of its own centre; where `most` pass there, the last one's distance bounds the cells of centres that it
    has to meet at all, else `far` does (see operators.metric).
    """
    c, pivots, radii, sizes = metric.indexed(cameras, cid, {"p": centre, "v": axis}, "p")
    if not len(pivots):
        return c.select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.lit(0.0).alias("dist"), F.lit(0.0).alias("angle"), F.lit(0).alias("rank")).limit(0)
    tile = metric.tiles(pivots, sizes)
    cosine = float(np.cos(np.radians(min(degrees, 180.0)))) if degrees > 0 else 2.0

    def unit(v):
        with np.errstate(invalid="ignore", divide="ignore"):
            return (v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32)

    def turned(a, b):
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.degrees(np.arccos(np.einsum("ij,ij->i", a, b) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))))

    def search(a, b):
        d, off = metric.rough(a["p"], b, "p")
        if "_unit" not in b:
            b["_unit"] = unit(b["v"]).T
        with np.errstate(invalid="ignore"):
            g = unit(a["v"]) @ b["_unit"]
        doubt = (a["v"].shape[1] + 8) * 2.0**-22
        open_ = g >= cosine - doubt
        own = np.minimum(np.searchsorted(b["id"], a["id"]), len(b["id"]) - 1)
        same = np.flatnonzero(b["id"][own] == a["id"])
        open_[same, own[same]] = False
        limit = np.minimum(a["most"], far) ** 2 * (1 + 1e-9) + off
        found = open_ & (d <= limit[:, None])
        if np.count_nonzero(found) > 8 * most * len(d):
            sure = found & (g >= cosine + doubt) & (d > (near * near + off)[:, None]) & (d < (far * far - off)[:, None])
            found &= d <= np.minimum(limit, metric.kth_of(np.where(sure, d, np.inf), most) + 2 * off)[:, None] if d.shape[1] >= most else True
        i, j = np.nonzero(found)
        dist = np.sqrt(metric.of_pairs(metric.apart, a["p"], b["p"], i, j))
        angle = metric.of_pairs(turned, a["v"], b["v"], i, j)
        ok = np.flatnonzero((angle < degrees) & (dist > near) & (dist < far))
        i, j, dist, angle = i[ok], j[ok], dist[ok], angle[ok]
        keep = metric.first_of(i, most, dist, angle, j)
        return i[keep], j[keep], [dist[keep], angle[keep]]

    order = Window.partitionBy("a_id").orderBy("dist", "angle", "b_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    first = _home(c.select("id", "p", "v"), pivots, sizes, 1, "p").withColumns({"tiles": metric.tiles_met("cells", tile), "most": F.lit(float(far))}).drop("cells")
    first = cut(first)
    met = cut(best(metric.meet(first, c, sizes, tile, ["p", "v"], search, "dist double, angle double", ["most"])).drop("rank"))
    reach = met.groupBy("a_id").agg(F.when(F.count(F.lit(1)) == most, F.max("dist")).alias("_most"))
    bounded = first.join(reach, F.col("id") == F.col("a_id"), "left").withColumn("most", F.coalesce("_most", F.lit(float(far)))).select("id", "p", "v", F.col("tiles").alias("seen"), "most")
    rest = _rest(bounded, "p", pivots, radii, sizes, tile)
    return best(met.unionByName(metric.meet(rest, c, sizes, tile, ["p", "v"], search, "dist double, angle double", ["most"])))


def statistical_outliers(neighbours: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """(a_id, mean_dist, outlier) from k nearest neighbours: mean distance over the mean of all plus sigmas deviations."""
    means = neighbours.groupBy("a_id").agg(F.avg(F.sqrt("d2")).alias("mean_dist"))
    limits = means.agg((F.avg("mean_dist") + sigmas * F.stddev_samp("mean_dist")).alias("_limit"))
    return means.join(F.broadcast(limits)).select("a_id", "mean_dist", (F.col("mean_dist") > F.col("_limit")).alias("outlier"))  # one row


def normals_by_neighbours(neighbours: DataFrame, points: DataFrame, pid: str = "pid", xyz: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(a_id, normal, values): the direction of least variance among a point's neighbours and itself, and all three variances, least first."""
    own = points.select(F.col(pid).alias("a_id"), F.col(pid).alias("b_id"))
    coordinates = points.select(F.col(pid).alias("b_id"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(xyz)])
    rows = neighbours.select("a_id", "b_id").unionByName(own).join(coordinates, "b_id")
    moments = [F.covar_pop(f"_{i}", f"_{j}").alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)]
    g = rows.groupBy("a_id").agg(*moments)
    matrix = F.array(*[F.col(f"m{i}{j}") for i in range(3) for j in range(i, 3)])
    return g.select("a_id", eigen.symmetric3(matrix).alias("_e")).select("a_id", F.col("_e")[0]["vector"].alias("normal"), F.transform("_e", lambda x: x["value"]).alias("values"))
