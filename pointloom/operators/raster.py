"""Discs to tiles, ordered front-to-back compositing, and raster stencils."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import vectors as V
from pointloom.functions.camera import TILE, tile_rect
from pointloom.operators import scan

LEAST_ALPHA = 1.0 / 255.0
MOST_ALPHA = 0.99
LEAST_TRANSMITTANCE = 1e-4


def tile_lists(discs: DataFrame, grid_x: int, grid_y: int, x: str = "px", y: str = "py", radius: str = "radius", tile: int = TILE) -> DataFrame:
    """A row per disc and covered tile, with tile_id = ty * grid_x + tx. Discs without tiles have none."""
    x0, y0, x1, y1 = tile_rect(F.col(x), F.col(y), F.col(radius), grid_x, grid_y, tile)
    boxed = discs.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1}).filter("_x1 > _x0 AND _y1 > _y0")
    rows = boxed.withColumn("_ty", F.explode(F.expr("sequence(_y0, _y1 - 1)"))).withColumn("_tx", F.explode(F.expr("sequence(_x0, _x1 - 1)")))
    return rows.withColumn("tile_id", F.col("_ty") * grid_x + F.col("_tx")).drop("_x0", "_y0", "_x1", "_y1", "_tx", "_ty")


def tile_ranges(lists: DataFrame, order: list[str]) -> DataFrame:
    """(tile_id, n, first, last): the run of each tile in its order: its size and the least and greatest of `order`."""
    key = F.struct(*order)
    return lists.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))


def in_tile_order(lists: DataFrame, depth: str = "depth", gid: str = "gid") -> DataFrame:
    """Each tile's rows together and by (depth, gid)."""
    return lists.repartition("tile_id").sortWithinPartitions("tile_id", depth, gid)


def splat_alpha(power: Column, opacity: Column, cut: float | None = None) -> Column:
    """Opacity at a pixel; null where the exponent is positive. Beyond -cut**2 / 2 the exponent counts hundredfold."""
    p = F.when(power < -cut * cut / 2, power * 100).otherwise(power) if cut is not None else power
    return F.when(power <= 0, F.least(F.lit(MOST_ALPHA), opacity * F.exp(p)))


def contributions(rows: DataFrame, pixel: list[str], order: list[str], alpha: str = "alpha") -> DataFrame:
    """Rows that contribute to their pixel, front to back, with t_before, t_after and place (1 for the list's first row).

    Rows with alpha under 1/255 or null are skipped but counted in place; a pixel stops before the row that would leave
    less than 1e-4 of the light. Transmittance is a segmented scan, so a pixel's rows needn't meet.
    """
    counts = F.col(alpha).isNotNull() & ~F.isnan(F.col(alpha)) & (F.col(alpha) >= LEAST_ALPHA)
    parts = scan.ranges(rows.withColumn("_counts", F.coalesce(counts, F.lit(False))), pixel, order)
    passed = {"place": F.lit(1).cast("long"), "_light": F.when(F.col("_counts"), F.log(1 - F.col(alpha))).otherwise(0.0)}
    placed = scan.running_sums(parts, pixel, order, passed).filter("_counts").withColumns({"place": F.col("place").cast("int"), "t_after": F.exp("_light")})
    lit = placed.filter(F.col("t_after") >= LEAST_TRANSMITTANCE).drop("place_all", "_light_all", "_light", "_counts", scan.PART)
    return lit.withColumn("t_before", F.col("t_after") / (1 - F.col(alpha)))


def composite(rows: DataFrame, pixel: list[str], order: list[str], colours: list[str], alpha: str = "alpha", background: float = 0.0) -> DataFrame:
    """Per pixel with contributions: each colour over the background, t_final, and the first and last contributor's place (first: 128 at most)."""
    lit = contributions(rows, pixel, order, alpha)
    sums = [F.sum(F.col(c) * F.col(alpha) * F.col("t_before")).alias(f"_{c}") for c in colours]
    g = lit.groupBy(*pixel).agg(*sums, F.min("t_after").alias("t_final"), F.max("place").alias("n_contrib"), F.least(F.min("place"), F.lit(128)).alias("first_contrib"))
    return g.select(*pixel, *[(F.col(f"_{c}") + F.col("t_final") * background).alias(c) for c in colours], "t_final", "n_contrib", "first_contrib")


def observations(rows: DataFrame, pixel: list[str], order: list[str], gid: str, alpha: str = "alpha", over: float = 0.5) -> DataFrame:
    """(gid, observed): the pixels that a row contributes to while more than half of the light is left."""
    return contributions(rows, pixel, order, alpha).filter(F.col("t_before") > over).groupBy(gid).agg(F.count(F.lit(1)).alias("observed"))


def front_set(rows: DataFrame, pixel: list[str], order: list[str], weight: str, depth: str, share: float = 0.5, least: float = 0.01, band: float = 0.02) -> DataFrame:
    """Rows near the depth z_f at which `share` of the pixel's weight is reached, each with at least `least` of it."""
    summed = scan.running_sums(scan.ranges(rows, pixel, order), pixel, order, {"_upto": F.col(weight)})
    reached = scan.best_of_key(summed, pixel, {"z_f": F.when(F.col("_upto") >= share * F.col("_upto_all"), F.col(depth))})
    near = (F.col(weight) >= least * F.col("_upto_all")) & (F.abs(F.col(depth) - F.col("z_f")) <= band * F.col("z_f"))
    return reached.filter(near).drop("_upto", "_upto_all", scan.PART)


def front_gate(front: DataFrame, rays: DataFrame, pixel: list[str], weight: str, depth: str, least_alpha: float = 0.8, least_share: float = 0.8, most_spread: float = 0.01, eps: float = 1e-8) -> DataFrame:
    """(pixel..., alpha, share, spread, open): of the rays (pixel..., alpha, their weight in all) which have one front surface.

    front is front_set's result; share is its weight over alpha, spread the relative deviation of its depths. A ray opens with alpha
    and share large enough and a small spread; one without a front has share 0, a null spread, and stays shut.
    """
    w, d = F.col(weight), F.col(depth)
    g = front.groupBy(*pixel).agg(F.sum(w).alias("_w"), F.sum(w * d).alias("_wd"), F.sum(w * d * d).alias("_wdd"))
    named = g.withColumnsRenamed({p: f"_g{i}" for i, p in enumerate(pixel)})
    on = F.lit(True)
    for i, p in enumerate(pixel):
        on = on & F.col(p).eqNullSafe(F.col(f"_g{i}"))
    mean = F.col("_wd") / F.col("_w")
    spread = F.sqrt(F.greatest(F.col("_wdd") / F.col("_w") - mean * mean, F.lit(0.0))) / (mean + eps)
    out = rays.join(named, on, "left").select(*pixel, "alpha", (F.coalesce("_w", F.lit(0.0)) / (F.col("alpha") + eps)).alias("share"), spread.alias("spread"))
    return out.withColumn("open", F.coalesce((F.col("alpha") >= least_alpha) & (F.col("share") >= least_share) & (F.col("spread") <= most_spread), F.lit(False)))


def stencil(raster: DataFrame, values: list[str], view: str = "view", x: str = "x", y: str = "y") -> DataFrame:
    """Add <value>_left, _right, _top and _bottom; null at the border. Rows of one line of a view meet in a task."""
    across, down = Window.partitionBy(view, y).orderBy(x), Window.partitionBy(view, x).orderBy(y)
    out = {}
    for v in values:
        out |= {f"{v}_left": F.lag(v).over(across), f"{v}_right": F.lead(v).over(across), f"{v}_top": F.lag(v).over(down), f"{v}_bottom": F.lead(v).over(down)}
    return raster.withColumns(out)


def depth_normals(raster: DataFrame, point: str = "point", view: str = "view", x: str = "x", y: str = "y") -> DataFrame:
    """Unit normals of a raster of points by the cross product of its central differences; 0 at the border."""
    s = stencil(raster, [point], view, x, y)
    n = V.cross(V.sub(F.col(f"{point}_right"), F.col(f"{point}_left")), V.sub(F.col(f"{point}_bottom"), F.col(f"{point}_top")))
    full = F.col(f"{point}_right").isNotNull() & F.col(f"{point}_left").isNotNull() & F.col(f"{point}_bottom").isNotNull() & F.col(f"{point}_top").isNotNull()
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return s.withColumn("normal", F.when(full, V.normalize(n)).otherwise(zero)).drop(*[f"{point}_{d}" for d in ("left", "right", "top", "bottom")])


def gradient_weight(raster: DataFrame, value: str, view: str = "view", x: str = "x", y: str = "y") -> DataFrame:
    """Add weight: the larger central difference of a pixel, scaled to [0, 1] within its view; 1 at the border."""
    s = stencil(raster, [value], view, x, y)
    g = F.greatest(F.abs(F.col(f"{value}_right") - F.col(f"{value}_left")), F.abs(F.col(f"{value}_bottom") - F.col(f"{value}_top")))
    inner = F.col(f"{value}_left").isNotNull() & F.col(f"{value}_right").isNotNull() & F.col(f"{value}_top").isNotNull() & F.col(f"{value}_bottom").isNotNull()
    s = s.withColumn("_g", F.when(inner, g))
    ends = s.groupBy(F.col(view).alias("_view")).agg(F.min("_g").alias("_lo"), F.max("_g").alias("_hi"))
    out = s.join(ends, F.col(view) == F.col("_view")).withColumn("weight", F.coalesce((F.col("_g") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-20), F.lit(1.0)))
    return out.drop("_g", "_lo", "_hi", "_view", *[f"{value}_{d}" for d in ("left", "right", "top", "bottom")])


def pixel_grid(views: DataFrame, width: int, height: int) -> DataFrame:
    """Every pixel (x, y) of every row."""
    return views.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def sample_triangles(triangles: DataFrame, spacing: float, a: str = "a", b: str = "b", c: str = "c") -> DataFrame:
    """Points about `spacing` apart on each triangle (arrays a, b, c): i, j >= 1 steps along two edges with a sum under 1."""
    u, v = V.sub(F.col(b), F.col(a)), V.sub(F.col(c), F.col(a))
    area = V.norm(V.cross(u, v))
    lu, lv = V.norm(u), V.norm(v)
    step = spacing * F.sqrt(lu * lv / F.nullif(area, F.lit(0.0)))
    sized = triangles.filter(area > 0).withColumns({"_u": u, "_v": v, "_n1": F.floor(lu / step).cast("int"), "_n2": F.floor(lv / step).cast("int")})
    grid = sized.filter("_n1 > 0 AND _n2 > 0").withColumn("_i", F.explode(F.expr("sequence(0, _n1 - 1)"))).withColumn("_j", F.explode(F.expr("sequence(0, _n2 - 1)")))
    s, t = (F.col("_i") + 0.5) / F.greatest("_n1", F.lit(1)), (F.col("_j") + 0.5) / F.greatest("_n2", F.lit(1))
    inside = grid.withColumns({"_s": s, "_t": t}).filter("_s + _t < 1")
    return inside.withColumn("point", V.add(F.col(a), V.add(V.scale(F.col("_u"), F.col("_s")), V.scale(F.col("_v"), F.col("_t"))))).drop("_u", "_v", "_n1", "_n2", "_i", "_j", "_s", "_t")
