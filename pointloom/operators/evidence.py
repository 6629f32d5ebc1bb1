"""Extension: what rasters of several views say of each particle: agreement across views, with the prior, and over time.

Rasters are rows (view, x, y, depth, normal in the world's axes, ...); cameras rows (view, r, t, fx, fy, cx, cy, width, height) with a
world-to-view rotation (9 numbers) and translation; pairs rows (a_id, b_id) of neighbouring views; contributions rows
(gid, view, x, y, w), a particle's weight at a pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions import vectors as V
from pointloom.operators.checkpoints import cut
from pointloom.operators.order import group_quantiles
from pointloom.operators.reliability import consistency, internal_reliability, normal_agreement, stability

# Tolerances of occlusion, the least weight that supports, the least alpha of a rendered surface.
OCCLUSION, LEAST_WEIGHT, LEAST_ALPHA, EPS = 0.05, 1e-4, 0.5, 1e-8
PIXEL = ["view", "x", "y"]
_INTRINSICS = ["fx", "fy", "cx", "cy", "width", "height"]


def _sound(depth: Column) -> Column:
    return F.coalesce(~F.isnan(depth) & (depth > 0) & (depth < float("inf")), F.lit(False))


def _camera(cameras: DataFrame, mark: str) -> DataFrame:
    """cameras with every number a column of its own, named with the mark."""
    r = [F.col("r")[i].alias(f"{mark}r{i}") for i in range(9)]
    t = [F.col("t")[i].alias(f"{mark}t{i}") for i in range(3)]
    return cameras.select(F.col("view").alias(f"{mark}view"), *r, *t, *[F.col(c).cast("double").alias(f"{mark}{c}") for c in _INTRINSICS])


def _on_raster(rows: DataFrame, kept: list[str]) -> DataFrame:
    """The columns kept of rows (with wx, wy, wz and a camera's columns) that fall on its raster, with ox, oy and z there."""
    w = F.col("wx"), F.col("wy"), F.col("wz")
    seen = rows.withColumns({f"_v{i}": V.total([F.col(f"_cr{3 * i + j}") * w[j] for j in range(3)]) + F.col(f"_ct{i}") for i in range(3)}).filter("_v2 > 0")
    place = {"_u": F.col("_cfx") * F.col("_v0") / F.col("_v2") + F.col("_ccx"), "_v": F.col("_cfy") * F.col("_v1") / F.col("_v2") + F.col("_ccy")}
    on = seen.withColumns(place).withColumns({"ox": F.floor(F.col("_u") + 0.5), "oy": F.floor(F.col("_v") + 0.5), "z": F.col("_v2")})
    return on.filter("ox >= 0 AND oy >= 0 AND ox < _cwidth AND oy < _cheight").select(*kept, "ox", "oy", "z")


def cross_view(pixels: DataFrame, cameras: DataFrame, pairs: DataFrame, depth_tolerance: float = 0.05, normal_tolerance: float = 0.10) -> DataFrame:
    """(view, x, y, other, ox, oy, z, depth_error, normal_error, score) of each pixel and each neighbour of its view that it meets.

    A pixel of view a_id is put into the world and into b_id, and joined with the pixel that it falls on: an equi-join on
    (view, x, y) after every test that needs no partner. Pixels without a sound depth, behind the other camera, off its raster, or
    hidden by more than OCCLUSION of the depth there have no row. Both poses of a pair are joined first, so a pixel is shuffled once
    to them and once to its partner, with numbers instead of arrays.
    """
    n = [F.col("normal")[i].cast("double") for i in range(3)]
    sound = pixels.filter(_sound(F.col("depth")))
    flat = sound.select(*PIXEL, F.col("depth").cast("double").alias("depth"), *[c.alias(f"_n{i}") for i, c in enumerate(n)])
    poses = _camera(cameras, "_s").join(pairs.select(F.col("a_id").alias("_a"), F.col("b_id").alias("other")), F.col("_sview") == F.col("_a")).join(_camera(cameras, "_c"), F.col("other") == F.col("_cview"))
    rows = flat.join(poses.drop("_sview", "_cview"), F.col("view") == F.col("_a"))
    ray = [(F.col("x") - F.col("_scx")) / F.col("_sfx") * F.col("depth"), (F.col("y") - F.col("_scy")) / F.col("_sfy") * F.col("depth"), F.col("depth")]
    rows = rows.withColumns({f"_d{i}": c - F.col(f"_st{i}") for i, c in enumerate(ray)})
    rows = rows.withColumns({n: V.total([F.col(f"_sr{3 * j + i}") * F.col(f"_d{j}") for j in range(3)]) for i, n in enumerate(("wx", "wy", "wz"))})
    source = _on_raster(rows, [*PIXEL, "other", "_n0", "_n1", "_n2"])
    there = pixels.filter(_sound(F.col("depth"))).select(F.col("view").alias("_w"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("depth").alias("_depth"), *[c.alias(f"_m{i}") for i, c in enumerate(n)])
    met = source.join(there, (F.col("other") == F.col("_w")) & (F.col("ox") == F.col("_x")) & (F.col("oy") == F.col("_y")))
    met = met.filter(F.col("z") <= (1 + OCCLUSION) * F.col("_depth"))
    errors = {"depth_error": F.abs(F.col("z") - F.col("_depth")) / (F.col("z") + F.col("_depth") + EPS), "normal_error": 1 - F.abs(V.total([F.col(f"_n{i}") * F.col(f"_m{i}") for i in range(3)]))}
    scored = met.withColumns(errors).withColumn("score", consistency(F.col("depth_error"), F.col("normal_error"), depth_tolerance, normal_tolerance))
    return scored.select(*PIXEL, "other", "ox", "oy", "z", "depth_error", "normal_error", "score")


def normalised_confidence(df: DataFrame, value: str, view: str, out: str, eps: float = EPS) -> DataFrame:
    """Add `out`: the value between the 5 % and the 95 % quantile of its view, clipped to [0, 1]; null for a null value.

    The quantiles are found in range partitions and written out, a row a view, so a hot view is gathered nowhere.
    """
    low, high = (group_quantiles(df, [view], value, q, n) for q, n in ((0.05, "_lo"), (0.95, "_hi")))
    ranges = cut(low.join(high, view).withColumnRenamed(view, "_view"))
    joined = df.join(ranges, F.col(view) == F.col("_view"), "left")
    scaled = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))).drop("_view", "_lo", "_hi")


def _per_pixel(scores: DataFrame, mark: str) -> DataFrame:
    return scores.groupBy(*PIXEL).agg(F.sum("score").alias(f"{mark}_score"), F.count(F.lit(1)).alias(f"{mark}_n"))


def evidence(contributions: DataFrame, prior: DataFrame, rendered: DataFrame, cameras: DataFrame, pairs: DataFrame, now: DataFrame, before: DataFrame, least_views: int = 2) -> DataFrame:
    """A row per particle: prior_trust, prior_views, prior_valid, geometry_trust, geometry_views, geometry_valid, agreement, difference.

    prior is a raster with `confidence`, rendered one with `prim_normal` and `alpha`; now and before are snapshots (gid, centre, normal,
    and now `scale`, its largest). Trust pools agreement across views with confidence (prior) or with that of both normals and with the
    snapshots (geometry); it is valid with `least_views` supporting views, the geometry's also needs an earlier snapshot. agreement
    compares both rasters pixel by pixel where both are sound and alpha is LEAST_ALPHA or more; difference is that of
    the two reliabilities, which are the trusts where valid and else 0. Particles without contributions have no row.

    What happens at a pixel is joined once into a table of pixels, which the contributions join; they are added up by particle
    and view, then by particle, so the rows of a particle that is everywhere are not gathered.
    """
    sound = _sound(F.col("depth")) & F.col("confidence").isNotNull() & ~F.isnan("confidence")
    p = normalised_confidence(prior.filter(sound), "confidence", "view", "_conf").select(*PIXEL, F.col("depth").alias("_pd"), F.col("normal").alias("_pn"), "_conf")
    g = rendered.select(*PIXEL, F.col("depth").alias("_gd"), F.col("normal").alias("_gn"), "prim_normal", "alpha")
    pixels = p.join(g, PIXEL, "full").join(_per_pixel(cross_view(prior, cameras, pairs), "p"), PIXEL, "left").join(_per_pixel(cross_view(rendered, cameras, pairs), "g"), PIXEL, "left")
    surface = _sound(F.col("_gd")) & (F.col("alpha") >= LEAST_ALPHA)
    both = surface & _sound(F.col("_pd"))
    one = lambda mask, value: F.when(F.coalesce(mask, F.lit(False)), value)
    values = {
        "p_conf": F.col("_conf"),
        "normals": one(surface, normal_agreement(V.dot(F.col("prim_normal"), F.col("_gn")))),
        "depths": one(both, F.abs(F.col("_pd") - F.col("_gd")) / (F.col("_pd") + F.col("_gd") + EPS)),
        "turns": one(both, 1 - F.abs(V.dot(F.col("_pn"), F.col("_gn")))),
    }
    pixels = pixels.select(*PIXEL, *[v.alias(k) for k, v in values.items()], "p_score", "p_n", "g_score", "g_n")
    rows = contributions.join(pixels, PIXEL)
    w = F.col("w")
    sums = {k: F.sum(w * F.col(k)) for k in (*values, "p_score", "g_score", "p_n", "g_n")} | {f"{k}_w": F.sum(F.when(F.col(k).isNotNull(), w)) for k in values}
    by_view = rows.groupBy("gid", "view").agg(*[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in sums.items()])
    total = by_view.groupBy("gid").agg(*[F.sum(k).alias(k) for k in sums], F.count_if(F.col("p_n") > LEAST_WEIGHT).alias("prior_views"), F.count_if(F.col("g_n") > LEAST_WEIGHT).alias("geometry_views"))
    pooled = lambda k, n=None: F.col(k) / (F.col(n or f"{k}_w") + EPS)
    past = before.select(F.col("gid").alias("_before"), F.col("centre").alias("_centre"), F.col("normal").alias("_normal"))
    moved = now.select(F.col("gid").alias("_gid"), "centre", "normal", "scale").join(past, F.col("_gid") == F.col("_before"), "left")
    steady = stability(V.norm(V.sub(F.col("centre"), F.col("_centre"))), F.col("scale"), V.dot(F.col("normal"), F.col("_normal")))
    kept = moved.select("_gid", steady.alias("_steady"), F.col("_before").isNotNull().alias("_history"))
    out = total.join(kept, F.col("gid") == F.col("_gid"), "left")
    history = F.coalesce("_history", F.lit(False))
    trusts = {
        "prior_trust": F.sqrt(pooled("p_conf") * pooled("p_score", "p_n")),
        "prior_valid": F.col("prior_views") >= least_views,
        "geometry_trust": F.cbrt(pooled("g_score", "g_n") * pooled("normals") * F.coalesce("_steady", F.lit(0.0))),
        "geometry_valid": (F.col("geometry_views") >= least_views) & history,
        "agreement": consistency(pooled("depths"), pooled("turns")),
        "_r": internal_reliability(pooled("g_score", "g_n"), pooled("normals"), F.coalesce("_steady", F.lit(0.0)), F.col("geometry_views"), history, least_views),
    }
    out = out.withColumns(trusts).withColumn("difference", F.when(F.col("prior_valid"), F.col("prior_trust")).otherwise(0.0) - F.col("_r"))
    return out.select("gid", "prior_trust", "prior_views", "prior_valid", "geometry_trust", "geometry_views", "geometry_valid", "agreement", "difference")
