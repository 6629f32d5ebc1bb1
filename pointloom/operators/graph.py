"""Connected components, greedy thinning, and alignment of point sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.checkpoints import cut as _cut
from pointloom.operators.metrics import voxel_downsample
from pointloom.operators.neighbors import nearest_within, radius_pairs
from pointloom.operators.order import numbered as _numbered
from pointloom.operators.select import systematic


#: Edges that a task of a step meets, about, and edges of one node beyond which its least goes to them by broadcast.
TASK_EDGES, HUB_EDGES = 1 << 17, 1 << 20


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that each node reaches.

    Large-star and small-star steps alternate until nothing changes; hubs are reduced to minima before rows meet, and a hub's rows never
    meet. Edges lead down (u > v), so only what a lower end itself leads down to is joined to them. Partitions go by the number of
    edges: by bytes a task would hold the more rows the better these compress, as they do when most lead to one node.
    """
    pairs = _cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    parts = lambda rows: max(1, -(-rows // TASK_EDGES))
    down = pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = _cut(down.repartition(parts(pairs.count()), "u", "v").distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, n = mark, parts(mark[0])
        large = _to_least(now, "v", n).select("u", F.col("m").alias("v")).repartition(n, "u", "v").distinct()
        small = _to_least(large, "u", n)
        rows = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).filter("u <> v")
        now = _cut(rows.repartition(n, "u", "v").distinct())
    linked = now.toDF("node", "component").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    lone = pairs.filter("NOT coalesce(u <> v, false)").select(F.explode(F.array("u", "v")).alias("node")).distinct()
    lone = lone.join(linked.select(F.col("node").alias("_linked")), F.col("node") == F.col("_linked"), "left_anti")
    return linked.unionByName(lone.select("node", F.col("node").alias("component")))


def _to_least(edges: DataFrame, end: str, parts: int) -> DataFrame:
    """Edges (u, v), u > v, with m: the least that their end `end` leads down to, the end itself where it leads nowhere."""
    ends = [F.struct(F.col("u").alias("_at"), F.col("v").alias("_to"), F.lit(int(end == "u")).alias("_one"))]
    if end == "v":
        ends.append(F.struct(F.col("v").alias("_at"), F.col("v").alias("_to"), F.lit(1).alias("_one")))
    least = edges.select(F.explode(F.array(*ends)).alias("e")).groupBy("e._at").agg(F.min("e._to").alias("m"), F.sum("e._one").alias("_n"))
    hubs = F.broadcast(least.filter(F.col("_n") > HUB_EDGES).select("_at", "m"))  # a row for so many edges at most
    others = least.filter((F.col("_n") > 0) & (F.col("_n") <= HUB_EDGES)).select("_at", "m")
    on = F.col(end) == F.col("_at")
    rest = edges.join(hubs, on, "left_anti").repartition(parts, end)
    return rest.join(others, on).select("u", "v", "m").unionByName(edges.join(hubs, on).select("u", "v", "m"))


def triangle_clusters(faces: DataFrame, by: str = "edge") -> DataFrame:
    """(fid, cluster): triangles (fid, v0, v1, v2) joined by shared edges, or by shared vertices."""
    v = [F.col(c) for c in ("v0", "v1", "v2")]
    keys = [F.array(F.least(x, y), F.greatest(x, y)) for x, y in ((v[0], v[1]), (v[1], v[2]), (v[0], v[2]))] if by == "edge" else [F.array(x) for x in v]
    shared = faces.select("fid", F.explode(F.array(*keys)).alias("key"))
    first = shared.groupBy("key").agg(F.min("fid").alias("_first"))
    links = shared.join(first, "key").select("fid", "_first")  # every triangle of a key with its first
    return connected_components(links, "fid", "_first").select(F.col("node").alias("fid"), F.col("component").alias("cluster"))


def largest_clusters(clusters: DataFrame, keep: int, least: int = 50) -> DataFrame:
    """Rows of clusters at least as large as the keep-th largest and as `least`; ties stay."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    limit = sizes.orderBy(F.desc("n")).limit(keep).agg(F.greatest(F.min("n"), F.lit(least)).alias("_limit"))
    return clusters.join(sizes.join(F.broadcast(limit)).filter("n >= _limit").select("cluster"), "cluster", "left_semi")  # one row


#: Points that are thinned at first, and the sum over cells of their points squared beyond which fewer are thinned at once.
THIN_FIRST, THIN_PAIRS = 8192, 1 << 25


def greedy_thin(points: DataFrame, radius: float, pid: str = "pid", xyz: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The points that a pass in pid order keeps, each dropping all later ones within the radius.

    The order is cut into lots, each up to four times the one before. Points near one kept before them go first, by a join with those kept, which
    lie at least a radius apart; pairs are formed of the others only. Where these still crowd, the lot is made smaller.
    """
    rows = _cut(_numbered(points.select(F.col(pid).alias("pid"), *[F.col(c).cast("double").alias(n) for c, n in zip(xyz, "xyz", strict=True)]), ["pid"], "place"))
    cell = [F.floor(F.col(c) / radius) for c in "xyz"]
    n, at, size, kept = rows.count(), 0, THIN_FIRST, None
    while at < n:
        lot = rows.filter((F.col("place") >= at) & (F.col("place") < at + size)).drop("place")
        if kept is not None:
            lot = _cut(lot.join(radius_pairs(lot, kept, radius).select(F.col("a_id").alias("pid")), "pid", "left_anti"))
        if size > THIN_FIRST:
            crowd = lot.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.col("_n") * F.col("_n"))).first()[0]
            if (crowd or 0) > THIN_PAIRS:
                size = max(THIN_FIRST, size // 4)
                continue
        stay = lot.join(_first_of_all(lot, radius), F.col("pid") == F.col("id"), "left_semi")
        kept = _cut(stay if kept is None else kept.unionByName(stay))
        at, size = at + size, size * 4
    return points.join(kept.select(F.col("pid").alias("id")), F.col(pid) == F.col("id"), "left_semi") if kept is not None else points


def _first_of_all(points: DataFrame, radius: float) -> DataFrame:
    """(id): the points that the pass keeps. Rounds of local minima give that set: one stays when no undecided neighbour comes before it."""
    pairs = _cut(radius_pairs(points, points, radius).filter("a_id < b_id").select("a_id", "b_id"))
    undecided, kept = _cut(points.select(F.col("pid").alias("id"))), points.select(F.col("pid").alias("id")).limit(0)
    while not undecided.isEmpty():
        ahead = pairs.select(F.col("b_id").alias("id"))
        stay = _cut(undecided.join(ahead, "id", "left_anti"))
        gone = pairs.join(stay, F.col("a_id") == F.col("id"), "left_semi").select(F.col("b_id").alias("id")).distinct()
        decided = stay.unionByName(gone)
        undecided = _cut(undecided.join(decided, "id", "left_anti"))
        pairs = _cut(pairs.join(decided, F.col("a_id") == F.col("id"), "left_anti").join(decided, F.col("b_id") == F.col("id"), "left_anti"))
        kept = kept.unionByName(stay)
    return kept


def _similarity(src: np.ndarray, dst: np.ndarray, with_scale: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    ms, md = src.mean(0), dst.mean(0)
    cov = (dst - md).T @ (src - ms) / len(src)
    return _from_moments(ms, md, cov, ((src - ms) ** 2).sum() / len(src), with_scale)


def _from_moments(ms, md, cov, var, with_scale: bool = True):
    u, s, vt = np.linalg.svd(cov)
    sign = np.ones(3)
    if np.linalg.det(u @ vt) < 0:
        sign[2] = -1
    rotation = (u * sign) @ vt
    factor = float((s * sign).sum() / var) if with_scale and var > 0 else 1.0
    return factor, rotation, md - factor * rotation @ ms


def similarity(pairs: DataFrame, src: str, dst: str, with_scale: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """(scale, 3x3 rotation, translation) of least squares from src to dst (arrays of three); only moments reach the driver."""
    s, d = [F.col(src)[i] for i in range(3)], [F.col(dst)[i] for i in range(3)]
    aggs = [F.avg(x) for x in (*s, *d)] + [F.covar_pop(d[i], s[j]) for i in range(3) for j in range(3)] + [F.var_pop(x) for x in s]
    row = np.array(pairs.agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)]).first(), float)
    return _from_moments(row[:3], row[3:6], row[6:15].reshape(3, 3), row[15:].sum(), with_scale)


def ransac_similarity(pairs: DataFrame, key: str, src: str, dst: str, threshold: float = 0.1, trials: int = 20000, confidence: float | None = 0.99999, sample: int = 3, batch: int = 256, seed: int = 0) -> DataFrame:
    """(trial, trials, inliers, scale, rotation, translation) of the best trial, the first on ties, refitted on its inliers; one row, or
    none from fewer than `sample` rows.

    Each trial draws `sample` of the rows' places from its own number, so a task that is run again gives the same. Trials come in
    batches: their few rows are looked up, fitted in the driver, and counted side by side over all rows, a row for each trial and task. After
    a batch the trials are enough when a draw of inliers alone was likely enough to be among them (confidence; None runs all).
    """
    numbered = _numbered(pairs.select(key, F.col(src).alias("src"), F.col(dst).alias("dst")), [key], "place").select("place", "src", "dst")
    rows = _cut(numbered)
    n = rows.count()
    spark, schema = pairs.sparkSession, "trial long, trials long, inliers long, scale double, rotation array<double>, translation array<double>"
    if n < sample:
        return spark.createDataFrame([], schema)
    best, done, needed = None, 0, trials
    while done < min(trials, needed):
        numbers = range(done, min(done + batch, trials))
        picks = {t: _distinct(seed, t, n, sample) for t in numbers}
        wanted = spark.createDataFrame([(int(p),) for p in sorted({int(p) for x in picks.values() for p in x})], "wanted long")
        found = {r["place"]: (r["src"], r["dst"]) for r in rows.join(F.broadcast(wanted), F.col("place") == F.col("wanted")).collect()}  # sample * batch rows at most
        fits = [_similarity(np.array([found[int(p)][0] for p in picks[t]], float), np.array([found[int(p)][1] for p in picks[t]], float)) for t in numbers]
        matrices, shifts = np.stack([f * r for f, r, _ in fits]), np.stack([t for *_, t in fits])

        def counted(batches, matrices=matrices, shifts=shifts, first=done):
            total = np.zeros(len(shifts), np.int64)
            for b in batches:
                a, d = (np.asarray(b.column(c).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, 3) for c in ("src", "dst"))
                for at in range(0, len(a), 2048):
                    off = np.einsum("tij,nj->tni", matrices, a[at : at + 2048]) + shifts[:, None] - d[None, at : at + 2048]
                    total += (np.einsum("tni,tni->tn", off, off) < threshold * threshold).sum(1)
            yield pa.RecordBatch.from_pydict({"trial": np.arange(first, first + len(total)), "inliers": total})

        top = rows.mapInArrow(counted, "trial long, inliers long").groupBy("trial").agg(F.sum("inliers").alias("inliers")).orderBy(F.desc("inliers"), "trial").first()
        if best is None or top["inliers"] > best[1]:
            best = top["trial"], top["inliers"], *fits[top["trial"] - done]
        done = numbers[-1] + 1
        share = (best[1] / n) ** sample
        if confidence is not None:
            needed = 0 if share >= 1 else trials if share <= 0 else math.ceil(math.log(1 - confidence) / math.log1p(-share))
    trial, inliers, f, r, t = best
    if inliers >= 3:
        moved = [F.lit(float(t[i])) + sum((F.col("src")[j] * float(f * r[i, j]) for j in range(1, 3)), F.col("src")[0] * float(f * r[i, 0])) - F.col("dst")[i] for i in range(3)]
        f, r, t = similarity(rows.filter(moved[0] * moved[0] + moved[1] * moved[1] + moved[2] * moved[2] < threshold * threshold), "src", "dst")
    return spark.createDataFrame([(trial, done, int(inliers), float(f), r.ravel().tolist(), t.tolist())], schema)


def _distinct(seed: int, trial: int, n: int, sample: int) -> np.ndarray:
    """`sample` distinct places, drawn one by one."""
    r, out = np.random.default_rng([seed, trial]), []
    while len(out) < sample:
        x = int(r.integers(n))
        if x not in out:
            out.append(x)
    return np.array(out)


def transformed(points: DataFrame, factor: float, rotation: np.ndarray, t: np.ndarray, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    new = {}
    for i, c in enumerate(xyz):
        v = F.lit(float(t[i]))
        for j, o in enumerate(xyz):
            v = v + F.col(o) * float(factor * rotation[i, j])
        new[c] = v
    return points.withColumns(new)


def icp(source: DataFrame, target: DataFrame, threshold: float, steps: int = 20, tolerance: float = 1e-6, with_scale: bool = False) -> tuple[np.ndarray, float]:
    """(4x4 transform, rigid or with a scale, root mean squared distance of the last step) that brings source (pid, x, y, z) onto target."""
    total, rmse = np.eye(4), float("inf")
    point = lambda p: F.array(*[F.col(f"{p}{c}").cast("double") for c in "xyz"])
    for _ in range(steps):
        moved = transformed(source, 1.0, total[:3, :3], total[:3, 3])
        near = nearest_within(moved, target, threshold)
        s = moved.select(F.col("pid").alias("a_id"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
        d = target.select(F.col("pid").alias("b_id"), *[F.col(c).alias(f"d{c}") for c in "xyz"])
        pairs = _cut(near.join(s, "a_id").join(d, "b_id").select(point("s").alias("src"), point("d").alias("dst"), "dist"))
        now = pairs.agg(F.sqrt(F.avg(F.col("dist") * F.col("dist")))).first()[0]
        if now is None:
            break
        factor, r, t = similarity(pairs, "src", "dst", with_scale)
        step = np.eye(4)
        step[:3, :3], step[:3, 3] = factor * r, t
        total = step @ total
        if abs(rmse - now) < tolerance:
            rmse = now
            break
        rmse = now
    return total, rmse


def _thinned(points: DataFrame, size: float | None, most: int) -> DataFrame:
    """(pid, x, y, z): the means of voxels `size` wide from half a voxel below the least corner, or every k-th point so that about `most` stay."""
    if size is None:
        n = points.count()
        if n <= most:
            return points.select("pid", "x", "y", "z")
        return systematic(_numbered(points.select("pid", "x", "y", "z"), ["pid"], "_at"), "_at", round(n / most)).drop("_at")
    low = points.agg(*[F.min(c) for c in "xyz"]).first()
    if low[0] is None:
        return points.select("pid", "x", "y", "z")
    cells = voxel_downsample(points, size, list("xyz"), origin=tuple(v - size / 2 for v in low))
    return _numbered(cells, ["i", "j", "k"], "pid").select("pid", "x", "y", "z")


def staged_icp(source: DataFrame, target: DataFrame, tau: float, start: np.ndarray | None = None, inside: Column | None = None, most: int = 4_000_000, steps: int = 20) -> tuple[np.ndarray, float]:
    """(4x4 similarity, root mean squared distance) from three refinements: voxels of tau at 80 tau, of tau / 2 at 20 tau, then
    every k-th point at 2 tau. `inside` crops both clouds (x, y, z), the source where it then lies; tables are (pid, x, y, z)."""
    total, rmse = np.eye(4) if start is None else np.asarray(start, float), float("inf")
    crop = (lambda p: p.filter(inside)) if inside is not None else (lambda p: p)
    for size, reach in ((tau, 80 * tau), (tau / 2, 20 * tau), (None, 2 * tau)):
        moved = crop(transformed(source, 1.0, total[:3, :3], total[:3, 3]))
        step, rmse = icp(_cut(_thinned(moved, size, most)), _cut(_thinned(crop(target), size, most)), reach, steps, with_scale=True)
        total = step @ total
    return total, rmse


def chunk_windows(df: DataFrame, order: str, size: int = 450) -> DataFrame:
    """Add chunk, the number of consecutive `size` - 1 rows, the order's first row being repeated as each chunk's anchor."""
    numbered = _numbered(df, [order], "_i")
    rest = numbered.filter("_i > 0").withColumn("chunk", F.floor((F.col("_i") - 1) / (size - 1)).cast("int")).withColumn("anchor", F.lit(False))
    chunks = F.greatest(F.lit(1), F.ceil((F.count(F.lit(1)) - 1) / (size - 1))).cast("int")
    first = numbered.filter("_i = 0").join(F.broadcast(numbered.agg(chunks.alias("_k")))).withColumn("chunk", F.explode(F.expr("sequence(0, _k - 1)"))).drop("_k").withColumn("anchor", F.lit(True))
    return first.unionByName(rest).drop("_i")


def label_filter(df: DataFrame, ok: Column) -> DataFrame:
    return df.filter(F.coalesce(ok, F.lit(False)))
