"""Aggregates that score renderings and depth, colour adjustments, camera layout checks, and gradient arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions import vectors as V
from pointloom.functions.camera import gray
from pointloom.operators.order import quantiles


def normalized(df: DataFrame, value: str, by: list[str] | None = None, out: str = "normalized", eps: float = 1e-20) -> DataFrame:
    """Add (value - min) / (max - min + eps), over all rows or within groups."""
    ends = (df.groupBy(*[F.col(c).alias(f"_{c}") for c in by]) if by else df.groupBy()).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if by:
        condition = F.lit(True)
        for c in by:
            condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
        joined = df.join(ends, condition)
    else:
        joined = df.join(F.broadcast(ends))  # one row
    return joined.withColumn(out, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)).drop("_lo", "_hi", *[f"_{c}" for c in by or []])


def masked_depth_loss(pixels: DataFrame, source: str, target: str, mask: Column, eps: float = 1e-6) -> DataFrame:
    """(loss): mean absolute difference of depths after removing each side's mean and dividing by its deviation, over masked pixels."""
    kept = pixels.filter(mask)
    stats = kept.agg(F.avg(source).alias("_ms"), F.avg(target).alias("_mt"), F.stddev_samp(source).alias("_ss"), F.stddev_samp(target).alias("_st"))
    z = (F.col(source) - F.col("_ms")) / (F.col("_ss") + eps) - (F.col(target) - F.col("_mt")) / (F.col("_st") + eps)
    return kept.join(F.broadcast(stats)).agg(F.avg(F.abs(z)).alias("loss"))  # one row


def confident_depth_loss(pixels: DataFrame, depth: str, prior: str, confidence: str, fraction: float, extent: float) -> DataFrame:
    """(loss): mean over all pixels of the depth difference where the confidence is at or over its quantile, over the scene's extent."""
    limit = quantiles(pixels, confidence, [fraction])
    good = (F.col(confidence) >= F.col("_q")[0]).cast("double")
    return pixels.join(F.broadcast(limit)).agg((F.avg(F.abs(F.col(depth) - F.col(prior)) * good) / extent).alias("loss"))  # one row


def smallest_axis_loss(particles: DataFrame, visible: Column, scales: str = "scales") -> DataFrame:
    """(loss): the mean smallest scale of visible particles; 0 without any."""
    return particles.filter(visible).agg(F.coalesce(F.avg(F.array_min(scales)), F.lit(0.0)).alias("loss"))


def smallest_axis(rotation: Column, scales: Column) -> Column:
    """The column of the rotation that belongs to the smallest scale, the first on ties."""
    i = (F.array_position(scales, F.array_min(scales)) - 1).cast("int")
    return F.array(*[F.element_at(rotation, 3 * r + i + 1) for r in range(3)])


def facing(normal: Column, position: Column, centre: Column) -> Column:
    """The normal, turned so that it points to the camera's centre."""
    return F.when(V.dot(normal, V.sub(centre, position)) < 0, V.scale(normal, -1.0)).otherwise(normal)


def plane_features(normal: Column, position: Column, view: Column) -> Column:
    """(local normal, distance of its plane, depth) of a particle under a 4x4 view."""
    r = F.array(*[view.getItem(4 * i + j) for i in range(3) for j in range(3)])
    n = V.matvec(r, normal)
    p = V.add(V.matvec(r, position), F.array(*[view.getItem(4 * i + 3) for i in range(3)]))
    return F.struct(n.alias("normal"), F.abs(V.dot(n, p)).alias("distance"), p.getItem(2).alias("depth"))


def brightness_contrast(rgb: list[Column], brightness: float, contrast: float) -> list[Column]:
    """Each channel scaled about the pixel's gray and shifted, within [0, 1]."""
    g = gray(*rgb)
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), g + (c - g) * contrast + brightness)) for c in rgb]


def jittered_cameras(cameras: DataFrame, translation: float, degrees: float, seed: int = 0) -> DataFrame:
    """Cameras with centres moved and Euler angles turned by uniform noise: columns centre and angles, arrays of three."""
    noise = lambda k, most: (F.rand(seed + k) * 2 - 1) * most
    return cameras.withColumns({
        "centre": F.array(*[F.col("centre")[i] + noise(i, translation) for i in range(3)]),
        "angles": F.array(*[F.col("angles")[i] + noise(3 + i, degrees) for i in range(3)]),
    })


def concentric(cameras: DataFrame, centre: str, axis: str, degrees: float = 30.0, tolerance: float = 0.5, share: float = 0.5) -> DataFrame:
    """(share, concentric): the share of cameras that look at the mean of all (by less than `degrees`) from a distance that the mean
    distance doesn't miss by more than `tolerance` of it; concentric if that is over `share`. A camera on the mean looks nowhere."""
    means = cameras.agg(*[F.avg(F.col(centre)[i]).alias(f"_{i}") for i in range(3)]).select(F.array("_0", "_1", "_2").alias("_mean"))
    to = V.sub(F.col("_mean"), F.col(centre))
    rows = cameras.join(F.broadcast(means)).select(V.angle_degrees(to, F.col(axis)).alias("_angle"), V.norm(to).alias("_r"))  # one row
    level = F.abs(F.col("_m") - F.col("_r")) <= tolerance * F.col("_r") + 1e-8
    both = F.coalesce((F.col("_angle") < degrees) & level, F.lit(False))
    found = rows.join(F.broadcast(rows.agg(F.avg("_r").alias("_m")))).agg(F.avg(both.cast("double")).alias("share"))  # one row
    return found.withColumn("concentric", F.col("share") > share)


def clip_gradients(df: DataFrame, gradient: str, factor: float = 2.0, n: int = 3) -> DataFrame:
    """Extension: gradients no longer than factor times the median of the positive lengths."""
    length = V.norm(F.col(gradient), n)
    median = quantiles(df.filter(length > 0).select(length.alias("_length")), "_length", [0.5]).select(F.col("_q")[0].alias("_median"))
    limit = F.least(F.lit(1.0), factor * F.col("_median") / F.greatest(length, F.lit(1e-12)))
    return df.join(F.broadcast(median)).withColumn(gradient, V.scale(F.col(gradient), F.coalesce(limit, F.lit(1.0)), n)).drop("_median")  # one row


def without_conflict(gradient: Column, against: Column, n: int = 3) -> Column:
    """Extension: the gradient without its component that opposes `against`."""
    d = V.dot(gradient, against, n)
    square = V.dot(against, against, n)
    return F.when((d < 0) & (square > 0), V.sub(gradient, V.scale(against, d / F.nullif(square, F.lit(0.0)), n), n)).otherwise(gradient)


def weighted_variance(df: DataFrame, keys: list[str], weight: str, values: list[str]) -> DataFrame:
    """Extension: (keys, variance): the weighted mean squared distance of the values from their weighted mean."""
    w = F.sum(weight)
    parts = [F.sum(F.col(weight) * F.col(v) * F.col(v)) / w - F.pow(F.sum(F.col(weight) * F.col(v)) / w, F.lit(2.0)) for v in values]
    return df.groupBy(*keys).agg(F.greatest(V.total(parts), F.lit(0.0)).alias("variance"))


def with_dimension(df: DataFrame, dimension: dict[str, tuple], key: str, columns: str) -> DataFrame:
    """Extension: rows joined with a small constant table: key value to a tuple of `columns` (DDL)."""
    table = df.sparkSession.createDataFrame([(k, *v) for k, v in dimension.items()], f"{key} string, {columns}")
    return df.join(F.broadcast(table), key, "left")  # a constant of the code
