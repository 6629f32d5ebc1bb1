"""Bounds, voxels, evaluation metrics and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import vectors as V
from pointloom.operators.order import prefix_sum


def voxel_downsample(points: DataFrame, size: float, values: list[str], xyz: tuple[str, ...] = ("x", "y", "z"), origin: tuple[float, ...] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Per occupied voxel (i, j, k from the origin) the number of points and the mean of each value."""
    cells = [F.floor((F.col(c) - o) / size).cast("long").alias(n) for c, o, n in zip(xyz, origin, "ijk", strict=True)]
    return points.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])


def block_bounds(points: DataFrame, block: Column, xyz: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    return points.groupBy(block.alias("block")).agg(*[f(c).alias(f"{n}_{c}") for c in xyz for n, f in (("lo", F.min), ("hi", F.max))])


def extent(points: DataFrame, xyz: tuple[str, ...] = ("x", "y", "z"), margin: float = 1.1) -> DataFrame:
    """(centre, radius): the centroid and margin times the largest distance from it."""
    centre = points.agg(F.array(*[F.avg(c) for c in xyz]).alias("centre"))
    far = points.join(F.broadcast(centre)).agg(F.first("centre").alias("centre"), F.max(V.distance_any(F.array(*[F.col(c).cast("double") for c in xyz]), F.col("centre"))).alias("_r"))  # one row
    return far.select("centre", (F.col("_r") * margin).alias("radius"))


def sigma_box(points: DataFrame, xyz: tuple[str, ...] = ("x", "y", "z"), sigmas: float = 3.0) -> DataFrame:
    """(lo, hi, centre, radius): mean -+ sigmas population deviations; radius is twice the largest deviation."""
    mean, dev = [F.avg(c) for c in xyz], [F.stddev_pop(c) for c in xyz]
    row = points.agg(*[m.alias(f"m{i}") for i, m in enumerate(mean)], *[d.alias(f"d{i}") for i, d in enumerate(dev)])
    n = range(len(xyz))
    return row.select(F.array(*[F.col(f"m{i}") - sigmas * F.col(f"d{i}") for i in n]).alias("lo"), F.array(*[F.col(f"m{i}") + sigmas * F.col(f"d{i}") for i in n]).alias("hi"), F.array(*[F.col(f"m{i}") for i in n]).alias("centre"), (2 * F.greatest(*[F.col(f"d{i}") for i in n])).alias("radius"))


def sampled_box(points: DataFrame, index: str, every: int = 100, xyz: tuple[str, ...] = ("x", "y", "z"), margin: float = 1.01) -> DataFrame:
    """(lo, hi, centre, radius) of every `every`-th point: the corner distance from the centre, times margin."""
    row = points.filter(F.col(index) % every == 0).agg(F.array(*[F.min(c) for c in xyz]).alias("lo"), F.array(*[F.max(c) for c in xyz]).alias("hi"))
    n = range(len(xyz))
    centre = F.array(*[(F.col("lo")[i] + F.col("hi")[i]) / 2 for i in n])
    return row.withColumn("centre", centre).withColumn("radius", V.distance_any(F.col("hi"), F.col("centre")) * margin)


def origin_box(points: DataFrame, xyz: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(lo, hi) of the points and the origin."""
    return points.agg(F.array(*[F.least(F.min(c), F.lit(0.0)) for c in xyz]).alias("lo"), F.array(*[F.greatest(F.max(c), F.lit(0.0)) for c in xyz]).alias("hi"))


def focus_point(axes: DataFrame, origin: str, direction: str) -> DataFrame:
    """(focus): the point nearest to all lines in the least-squares sense, from nine sums."""
    d, o = V.items(F.col(direction), 3), V.items(F.col(origin), 3)
    m = [[(F.lit(1.0 if i == j else 0.0) - d[i] * d[j]) for j in range(3)] for i in range(3)]
    sums = [F.avg(m[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)] + [F.avg(V.total([m[i][j] * o[j] for j in range(3)])).alias(f"b{i}") for i in range(3)]
    row = axes.agg(*sums)
    return row.select(V.matvec(V.inverse3(F.array(*[F.col(f"m{i}{j}") for i in range(3) for j in range(3)])), F.array(*[F.col(f"b{i}") for i in range(3)])).alias("focus"))


def f_score(a_dist: DataFrame, b_dist: DataFrame, tau: float, dist: str = "dist") -> DataFrame:
    """(precision, recall, f_score): shares of distances strictly under tau; all 0 where a side is empty or both shares are."""
    share = F.coalesce(F.avg(F.when(F.col(dist) < tau, 1.0).otherwise(0.0)), F.lit(0.0))
    both = a_dist.agg(share.alias("precision"), F.count(F.lit(1)).alias("_a")).join(F.broadcast(b_dist.agg(share.alias("recall"), F.count(F.lit(1)).alias("_b"))))  # one row each
    p = F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("precision")).otherwise(0.0)
    r = F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("recall")).otherwise(0.0)
    return both.select(p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f_score"))


def cumulative_histogram(dists: DataFrame, tau: float, stretch: int = 5, bins: int = 100, dist: str = "dist") -> DataFrame:
    """(bin, n, share): counts in [bin, bin + 1) * tau / bins up to stretch * tau, the last bin closed, and the share of
    all distances up to each bin's end; distances beyond count in the whole only. Bins without distances are listed too."""
    last = stretch * bins - 2
    step = tau / bins
    kept = dists.filter(F.col(dist) <= (last + 1) * step).select(F.least(F.floor(F.col(dist) / step).cast("int"), F.lit(last)).alias("bin"))
    counts = kept.groupBy("bin").agg(F.count(F.lit(1)).alias("_n"))
    total = dists.agg(F.count(F.lit(1)).alias("_total"))
    grid = dists.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, "bin", "left").join(F.broadcast(total)).withColumn("n", F.coalesce("_n", F.lit(0)))  # stretch * bins rows
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return full.select("bin", "n", (F.sum("n").over(run) / F.col("_total")).alias("share"))


def chamfer(d2s: DataFrame, s2d: DataFrame, most: float, dist: str = "dist") -> DataFrame:
    """(mean_d2s, mean_s2d, overall): means of the distances under `most` and their average."""
    a = d2s.filter(F.col(dist) < most).agg(F.avg(dist).alias("mean_d2s"))
    b = s2d.filter(F.col(dist) < most).agg(F.avg(dist).alias("mean_s2d"))
    return a.join(F.broadcast(b)).withColumn("overall", (F.col("mean_d2s") + F.col("mean_s2d")) / 2)  # one row each


def error_colours(df: DataFrame, dist: str, most: float, masked: Column) -> DataFrame:
    """Red ramp by distance / most; green beyond it; blue where masked. Adds red, green, blue (0 to 255)."""
    ramp = F.least(F.col(dist) / most, F.lit(1.0))
    far = F.col(dist) >= most
    level = lambda c: F.floor(c * 255).cast("int")
    red = F.when(masked, 0).when(far, 0).otherwise(255)
    green = F.when(masked, 0).when(far, 255).otherwise(level(1 - ramp))
    blue = F.when(masked, 255).when(far, 0).otherwise(level(1 - ramp))
    return df.withColumns({"red": red, "green": green, "blue": blue})


def scene_summary(df: DataFrame, scene: str, values: list[str], average: str = "AVG") -> DataFrame:
    """Mean of each value per scene, and a row `average` with the mean of the scenes' means."""
    each = df.groupBy(scene).agg(*[F.avg(v).alias(v) for v in values])
    grouped = each.groupingSets([[scene], []], scene).agg(F.grouping_id().alias("_all"), *[F.avg(v).alias(f"_{v}") for v in values])
    return grouped.select(F.when(F.col("_all") == 1, average).otherwise(F.col(scene).cast("string")).alias(scene), *[F.col(f"_{v}").alias(v) for v in values])


def image_errors(pixels: DataFrame, image: str, a: str, b: str) -> DataFrame:
    """(image, l1, l2, psnr) of values in [0, 1]; psnr is null for equal images."""
    d = F.col(a) - F.col(b)
    g = pixels.groupBy(image).agg(F.avg(F.abs(d)).alias("l1"), F.avg(d * d).alias("l2"))
    return g.withColumn("psnr", F.when(F.col("l2") > 0, 20 * F.log10(1 / F.sqrt(F.nullif(F.col("l2"), F.lit(0.0))))))


def geometric_error(psnr: Column, ssim: Column, lpips: Column) -> Column:
    """Geometric mean of mse, sqrt(1 - ssim) and lpips."""
    mse = F.exp(-0.1 * F.lit(float(np.log(10.0))) * psnr)
    return F.exp((F.log(mse) + F.log(F.sqrt(1 - ssim)) + F.log(lpips)) / 3)


def local_ncc(patches: DataFrame, patch: str, a: str, b: str) -> DataFrame:
    """(patch, ncc, ok): 1 - cc of each patch clamped to [0, 2], from five sums; ok where it is under 0.9."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    g = patches.groupBy(patch).agg(F.sum(x).alias("_a"), F.sum(y).alias("_b"), F.sum(x * x).alias("_aa"), F.sum(y * y).alias("_bb"), F.sum(x * y).alias("_ab"), F.count(F.lit(1)).alias("_n"))
    cross = F.col("_ab") - F.col("_a") * F.col("_b") / F.col("_n")
    va, vb = F.col("_aa") - F.col("_a") * F.col("_a") / F.col("_n"), F.col("_bb") - F.col("_b") * F.col("_b") / F.col("_n")
    ncc = F.least(F.greatest(1 - cross * cross / (va * vb + 1e-8), F.lit(0.0)), F.lit(2.0))
    return g.select(patch, ncc.alias("ncc")).withColumn("ok", F.col("ncc") < 0.9)


def normalized_patch_error(patches: DataFrame, patch: str, a: str, b: str, margin: float, eps: float = 0.01) -> DataFrame:
    """(patch, n, error): mean squared difference of z-scores (sample deviation) over the values more than margin apart."""
    w = patches.groupBy(F.col(patch).alias("_p")).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.stddev_samp(a).alias("_sa"), F.stddev_samp(b).alias("_sb"))
    z = patches.join(w, F.col(patch) == F.col("_p")).withColumn("_d", (F.col(a) - F.col("_ma")) / (F.col("_sa") + eps) - (F.col(b) - F.col("_mb")) / (F.col("_sb") + eps))
    return z.filter(F.abs(F.col("_d")) > margin).groupBy(patch).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_d") * F.col("_d")).alias("error"))


def _gaussian(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    g = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return g / g.sum()


def ssim(pixels: DataFrame, image: str, x: str, y: str, a: str, b: str, tile: int = 256) -> DataFrame:
    """(image, ssim) of images with values in [0, 1], pixels numbered from any least x and y: 11x11 Gaussian windows, zero padding.

    Images are cut into tiles; a pixel goes to its own and to those within half a window, so a task holds tiles, not images.
    """
    reach = 5

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty, own = int(pdf["_tx"].iloc[0]), int(pdf["_ty"].iloc[0]), pdf["_own"].to_numpy(bool)
        i, j = pdf[y].to_numpy(np.int64) - ty * tile + 2 * reach, pdf[x].to_numpy(np.int64) - tx * tile + 2 * reach
        side = tile + 4 * reach
        p, q = np.zeros((side, side)), np.zeros((side, side))
        p[i, j], q[i, j] = pdf[a], pdf[b]
        kernel = _gaussian()

        def blur(m: np.ndarray) -> np.ndarray:
            m = sum(k * m[n : side - 2 * reach + n] for n, k in enumerate(kernel))
            return sum(k * m[:, n : side - 2 * reach + n] for n, k in enumerate(kernel))

        mp, mq = blur(p), blur(q)
        vp, vq, vpq = blur(p * p) - mp * mp, blur(q * q) - mq * mq, blur(p * q) - mp * mq
        value = ((2 * mp * mq + 0.01**2) * (2 * vpq + 0.03**2)) / ((mp * mp + mq * mq + 0.01**2) * (vp + vq + 0.03**2))
        mine = value[i[own] - reach, j[own] - reach]
        return pd.DataFrame({image: [pdf[image].iloc[0]], "total": [float(mine.sum())], "n": [len(mine)]})

    kind = pixels.schema[image].dataType.simpleString()
    near = lambda c: F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-reach, 0, reach)]), lambda d: F.floor((F.col(c) + d) / tile)))
    tiled = pixels.select(image, x, y, a, b).withColumn("_tx", F.explode(near(x))).withColumn("_ty", F.explode(near(y)))
    tiled = tiled.withColumn("_own", (F.col("_tx") == F.floor(F.col(x) / tile)) & (F.col("_ty") == F.floor(F.col(y) / tile)))
    sums = tiled.groupBy(image, "_tx", "_ty").applyInPandas(one, f"`{image}` {kind}, total double, n long")
    return sums.groupBy(image).agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("ssim")).filter("ssim IS NOT NULL")


def densify_stats(rows: DataFrame, gid: str, gx: str, gy: str, absolute: str, visible: Column, radius: str | None = None) -> DataFrame:
    """(gid, grad, grad_abs, denom, mean_grad[, max_radius]) over visible rows; mean_grad is 0 without any."""
    g = F.sqrt(F.col(gx) * F.col(gx) + F.col(gy) * F.col(gy))
    aggs = [F.coalesce(F.sum(F.when(visible, g)), F.lit(0.0)).alias("grad"), F.coalesce(F.sum(F.when(visible, F.abs(F.col(absolute)))), F.lit(0.0)).alias("grad_abs"), F.count_if(visible).alias("denom")]
    if radius:
        aggs.append(F.max(F.when(visible, F.col(radius))).alias("max_radius"))
    out = rows.groupBy(gid).agg(*aggs)
    return out.withColumn("mean_grad", F.when(F.col("denom") > 0, F.col("grad") / F.nullif(F.col("denom"), F.lit(0))).otherwise(0.0))


def observation_sufficiency(views: DataFrame, gid: str, direction: str, enough: int = 5, degrees: float = 30.0) -> DataFrame:
    """Extension: (gid, m, s_count, s_angle, sufficiency) from unit directions: count and dispersion of the views."""
    g = views.groupBy(gid).agg(F.count(F.lit(1)).alias("m"), *[F.sum(F.col(direction)[i].cast("double")).alias(f"_{i}") for i in range(3)])
    m = F.col("m")
    spread = (m * m - (F.col("_0") * F.col("_0") + F.col("_1") * F.col("_1") + F.col("_2") * F.col("_2"))) / F.nullif(2 * m * (m - 1), F.lit(0))
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    angle = F.coalesce(clip(spread / (0.5 * (1 - float(np.cos(np.radians(degrees)))))), F.lit(0.0))
    out = g.select(gid, "m", clip(m / enough).alias("s_count"), angle.alias("s_angle"))
    return out.withColumn("sufficiency", F.sqrt(F.col("s_count") * F.col("s_angle")))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Extension: (auroc) with ties at half; ranks come from counts per distinct score."""
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    run = prefix_sum(counts.withColumn("_neg", F.col("_n") - F.col("_p")), score, "_neg", "_run")
    under = run.withColumn("_below", F.col("_run") - F.col("_neg"))
    sums = under.agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_neg") / 2)).alias("_u"), F.sum("_p").alias("_p"), F.sum("_neg").alias("_q"))
    return sums.select((F.col("_u") / F.nullif(F.col("_p") * F.col("_q"), F.lit(0))).alias("auroc"))


def group_ranges(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, lo, hi, n) of each rig, camera or other group."""
    return df.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"))
