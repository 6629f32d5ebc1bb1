"""Appending, pruning, cloning and splitting rows of a particle table.

A particle table has gid, xyz, log-free scales (arrays of three), opacity in [0, 1] and accumulators, which every
step that changes rows sets to 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.order import quantiles

ACCUMULATORS = ("grad", "grad_abs", "denom", "max_radius")


def reset_accumulators(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(0).cast(df.schema[c].dataType) for c in ACCUMULATORS if c in df.columns})


def append(df: DataFrame, more: DataFrame) -> DataFrame:
    """All rows of both; accumulators of every row are 0 after."""
    return reset_accumulators(df.unionByName(more, allowMissingColumns=True))


def prune(df: DataFrame, gone: Column) -> DataFrame:
    """Rows without those where `gone` is true (null stays)."""
    return df.filter(~F.coalesce(gone, F.lit(False)))


def largest_scale(scales: str = "scales") -> Column:
    return F.array_max(scales)


def clone(df: DataFrame, gradient: str, threshold: float, limit: float, seed: int | None = None, scales: str = "scales") -> DataFrame:
    """Copies (`origin` 'clone') of rows with gradient >= threshold and a largest scale <= limit, the originals kept.

    With a seed the copies' xyz is jittered by normal noise of their scales.
    """
    picked = (F.col(gradient) >= threshold) & ~F.isnan(gradient) & (largest_scale(scales) <= limit)
    copies = df.filter(picked).withColumn("origin", F.lit("clone"))
    if seed is not None:
        copies = copies.withColumn("xyz", F.array(*[F.col("xyz")[i] + F.randn(seed + i) * F.col(scales)[i] for i in range(3)]))
    return df.withColumn("origin", F.lit("kept")).unionByName(copies)


def split(df: DataFrame, gradient: str, threshold: float, limit: float, children: int = 2, shrink: float = 0.8, scales: str = "scales", absolute: str | None = None, absolute_threshold: float = 0.0, seed: int | None = None) -> DataFrame:
    """Rows with gradient >= threshold (or `absolute` >= its own) and a largest scale over limit become `children` rows
    with scales / (shrink * children); the rest stay. Clones of the same step don't split."""
    large = largest_scale(scales) > limit
    by_gradient = (F.col(gradient) >= threshold) & ~F.isnan(gradient)
    if absolute:
        by_gradient = by_gradient | ((F.col(absolute) >= absolute_threshold) & ~F.isnan(absolute))
    picked = by_gradient & large
    if "origin" in df.columns:
        picked = picked & (F.col("origin") != "clone")
    else:
        df = df.withColumn("origin", F.lit("kept"))
    copies = F.when(picked, F.sequence(F.lit(1), F.lit(children))).otherwise(F.array(F.lit(0)))
    rows = df.withColumn("child", F.explode(copies))
    out = rows.withColumn(scales, F.when(F.col("child") > 0, F.transform(scales, lambda s: s / (shrink * children))).otherwise(F.col(scales)))
    out = out.withColumn("origin", F.when(F.col("child") > 0, "split").otherwise(F.col("origin")))
    if seed is not None:
        moved = F.array(*[F.col("xyz")[i] + F.randn(seed + i) * F.col(scales)[i] * shrink * children for i in range(3)])
        out = out.withColumn("xyz", F.when(F.col("child") > 0, moved).otherwise(F.col("xyz")))
    return out


def densify_step(df: DataFrame, gradient: str, threshold: float, limit: float, least_opacity: float, largest: float | None = None, opacity: str = "opacity", scales: str = "scales", seed: int | None = None) -> DataFrame:
    """Clone, then split, then prune by opacity and, if given, by largest scale; accumulators are 0 after."""
    rows = split(clone(df, gradient, threshold, limit, seed, scales), gradient, threshold, limit, scales=scales, seed=seed)
    gone = F.col(opacity) < least_opacity
    if largest is not None:
        gone = gone | (largest_scale(scales) > largest)
    return reset_accumulators(prune(rows, gone))


def _over(values: DataFrame, value: str, room: int, n: int) -> float:
    """The quantile of all values that leaves about `room` of n above it."""
    return quantiles(values, value, [1 - room / max(1, n)]).first()["_q"][0]


def budgeted_step(df: DataFrame, gradient: str, threshold: float, absolute: str, absolute_threshold: float, limit: float, least_opacity: float, cap: int, absolute_cap: int = 50_000, radius: str = "max_radius", least_radius: float = 20.0, largest: float | None = None, opacity: str = "opacity", scales: str = "scales", children: int = 2, shrink: float = 0.8, seed: int | None = None) -> DataFrame:
    """densify_step with room for `cap` rows, and splits by absolute gradients where there is room left.

    If clones (or splits) by gradient would go over cap, only those strictly over the quantile of all gradients (the others' as 0) that
    leaves the room. Else large rows with a radius over least_radius split by absolute gradient too, as many as there is room for and
    absolute_cap at most, picked by a quantile likewise. Clones of the step count as rows without gradients. NaN and null gradients are 0.
    Four counts and three quantiles reach the driver.
    """
    g, a = (F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c).cast("double")).otherwise(0.0) for c in (gradient, absolute))
    large = largest_scale(scales) > limit
    rows = df.withColumns({"_g": g, "_a": F.when(large & (F.coalesce(F.col(radius), F.lit(0)) > least_radius), a).otherwise(0.0), "_large": F.coalesce(large, F.lit(False))})
    first, second = (F.col("_g") >= threshold) & ~F.col("_large"), (F.col("_g") >= threshold) & F.col("_large")
    n, clones, splits = rows.agg(F.count(F.lit(1)), F.count_if(first), F.count_if(second)).first()
    if cap < n:
        raise ValueError("more rows than the cap already")
    if clones + n > cap:
        first = first & (F.col("_g") > _over(rows.select(F.when(first, F.col("_g")).otherwise(0.0).alias("_v")), "_v", cap - n, n))
        clones = rows.filter(first).count()
    n += clones
    new = rows.filter(first).select(F.lit(0.0).alias("_v"))
    if splits + n > cap:
        values = rows.select(F.when(second, F.col("_g")).otherwise(0.0).alias("_v"))
        second = second & (F.col("_g") > _over(values.unionByName(new), "_v", cap - n, n))
    else:
        value = F.when(second, 0.0).otherwise(F.col("_a"))
        third, room = value >= absolute_threshold, min(cap - n - splits, absolute_cap)
        if rows.filter(third).count() > room:
            third = value > _over(rows.select(value.alias("_v")).unionByName(new), "_v", room, n)
        second = second | third
    copies = rows.filter(first).withColumns({"origin": F.lit("clone"), "child": F.lit(0)})
    parts = rows.withColumn("child", F.explode(F.when(second, F.sequence(F.lit(1), F.lit(children))).otherwise(F.array(F.lit(0)))))
    parts = parts.withColumn("origin", F.when(F.col("child") > 0, "split").otherwise("kept"))
    if seed is not None:
        moved = lambda t: t.withColumn("xyz", F.array(*[F.col("xyz")[i] + F.randn(seed + i) * F.col(scales)[i] for i in range(3)]))
        copies, parts = moved(copies), moved(parts.filter("child > 0")).unionByName(parts.filter("child = 0"))
    parts = parts.withColumn(scales, F.when(F.col("child") > 0, F.transform(scales, lambda s: s / (shrink * children))).otherwise(F.col(scales)))
    gone = F.col(opacity) < least_opacity
    if largest is not None:
        gone = gone | (largest_scale(scales) > largest)
    return reset_accumulators(prune(parts.unionByName(copies), gone).drop("_g", "_a", "_large"))


def reset_opacity(df: DataFrame, most: float = 0.01, opacity: str = "opacity") -> DataFrame:
    return df.withColumn(opacity, F.least(F.col(opacity), F.lit(most)))


def hide(df: DataFrame, gone: Column, opacity: str = "opacity", value: float = -1000.0) -> DataFrame:
    """Soft deletion: the (logit) opacity of some rows becomes very small."""
    return df.withColumn(opacity, F.when(gone, value).otherwise(F.col(opacity)))


def initial_particles(points: DataFrame, mean_d2: str = "mean_d2", colour: str = "rgb") -> DataFrame:
    """Particle columns from points (pid, x, y, z, rgb) and their mean squared distance to near neighbours."""
    size = F.log(F.sqrt(F.greatest(F.coalesce(F.col(mean_d2), F.lit(0.0)), F.lit(1e-7))))
    base = F.transform(colour, lambda c: (c - 0.5) / 0.28209479177387814)
    return points.select(
        F.col("pid").alias("gid"), F.array("x", "y", "z").alias("xyz"), F.array(size, size, size).alias("log_scales"),
        F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("rotation"), F.log(F.lit(0.1) / F.lit(0.9)).alias("opacity"),
        base.alias("f_dc"), F.array_repeat(F.lit(0.0), 45).alias("f_rest"),
    )


def missing_rows(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the table yet: what an insert that may be repeated adds."""
    return rows.join(table.select(key), key, "left_anti")


def migrate_priors(images: DataFrame, priors: DataFrame) -> DataFrame:
    """New pose priors from image rows with any finite prior_t*, for images that have none."""
    t = F.array("prior_tx", "prior_ty", "prior_tz")
    finite = F.exists(t, lambda v: v.isNotNull() & ~F.isnan(v))
    new = images.filter(finite).select("image_id", t.alias("position"), F.lit(-1).alias("coordinate_system"))
    return missing_rows(new, priors, "image_id")
