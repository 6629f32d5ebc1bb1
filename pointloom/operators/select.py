"""Row selection: quantile flags, budgets, masks, hold-outs, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vectors import greater
from pointloom.operators.epochs import in_epoch
from pointloom.operators.order import group_quantiles, numbered, quantiles, value_ends


def with_quantiles(df: DataFrame, value: str, fractions: list[float], out: str = "_q", where: Column | None = None) -> DataFrame:
    """Add exact, linearly interpolated quantiles of `value` as an array; one row of them is joined to all."""
    kept = df.filter(where) if where is not None else df
    return df.join(F.broadcast(quantiles(kept, value, fractions, out)))  # one row


def dual_end_flag(df: DataFrame, value: str, low: float = 0.10, high: float = 0.95, ceiling: float = 1.0, out: str = "flag") -> DataFrame:
    """Flag rows strictly over the high quantile, or strictly under the low one or the ceiling, the smaller of the two."""
    q = with_quantiles(df, value, [low, high])
    v = F.col(value)
    flag = greater(v, F.col("_q")[1]) | (~F.isnan(v) & (v < F.least(F.lit(float(ceiling)), F.col("_q")[0])))
    return q.withColumn(out, flag).drop("_q")


def budget_select(df: DataFrame, value: str, threshold: float, cap: int, current: int = 0) -> DataFrame:
    """Rows with value >= threshold; if they and `current` exceed `cap`, only those strictly over the quantile of all
    values (unselected as 0) that leaves cap - current rows. Ties at that quantile go."""
    room = cap - current
    if room < 0:
        raise ValueError("more rows than the cap already")
    v = F.col(value).cast("double")
    picked = df.withColumn("_v", F.when(v >= threshold, v).otherwise(0.0))
    stats = picked.agg(F.count_if(v >= threshold).alias("_k"), F.count(F.lit(1)).alias("_n"))
    total = stats.first()
    if total["_k"] <= room:
        return df.filter(v >= threshold)
    fraction = 1 - room / max(1, total["_n"])
    return with_quantiles(picked, "_v", [fraction]).filter((F.col("_v") > F.col("_q")[0]) & (v >= threshold)).drop("_v", "_q")


def at_least_quantile(df: DataFrame, value: str, fraction: float, by: list[str] | None = None) -> DataFrame:
    """Rows with value >= the quantile of all rows, or of their group."""
    if not by:
        return with_quantiles(df, value, [fraction]).filter(F.col(value) >= F.col("_q")[0]).drop("_q")
    q = group_quantiles(df, by, value, fraction)
    return df.join(q, by).filter(F.col(value) >= F.col("_q")).drop("_q")


def clip_to_quantiles(df: DataFrame, value: str, low: float, high: float, out: str = "clipped") -> DataFrame:
    q = with_quantiles(df, value, [low, high])
    return q.withColumn(out, F.least(F.greatest(F.col(value), F.col("_q")[0]), F.col("_q")[1])).drop("_q")


def rank_pick(df: DataFrame, value: str, fractions: list[float], tie: str | None = None) -> DataFrame:
    """For each fraction p the value at 0-based place int(p n) in ascending order (the last at most): (fraction, value).

    Places come from counts per value, so that equal values never gather and no task sorts the table.
    """
    ends = value_ends(df, value)
    place = lambda p: F.least((F.lit(float(p)) * F.col("_total")).cast("long"), F.col("_total") - 1)
    row = ends.agg(*[F.min(F.when(F.col("_end") > place(p), F.col(value))).alias(f"_{i}") for i, p in enumerate(fractions)])
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("fraction"), F.col(f"_{i}").alias(value)) for i, p in enumerate(fractions)])
    return row.select(F.inline(pairs)).filter(F.col(value).isNotNull())


def holdout(df: DataFrame, key: str, every: int = 8, out: str = "held_out") -> DataFrame:
    """Flag each `every`-th row of the order by key, the first included."""
    return numbered(df, [key], "_place").withColumn(out, F.col("_place") % every == 0).drop("_place")


def systematic(df: DataFrame, index: str, k: int) -> DataFrame:
    """Every k-th row by its index, from 0."""
    return df.filter(F.col(index) % k == 0)


def random_cap(df: DataFrame, keys: list[str], most: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """At most `most` rows without replacement, the first in the epoch's order of all: the operator's purpose is the cap."""
    return in_epoch(df, keys, seed, epoch, "_place").filter(F.col("_place") < most).drop("_place")


def shuffled(df: DataFrame, keys: list[str], seed: int = 0, epoch: int = 0, begin: int = 0, size: int | None = None) -> DataFrame:
    """Rows with their `place` in the epoch's order; from `begin` on, and only the next `size` if given, so that an epoch can be taken up again."""
    rows = in_epoch(df, keys, seed, epoch).filter(F.col("place") >= begin)
    return rows if size is None else rows.filter(F.col("place") < begin + size)


def in_box(point: list[Column], low: list[float], high: list[float]) -> Column:
    out = F.lit(True)
    for v, a, b in zip(point, low, high, strict=True):
        out = out & (v >= a) & ~F.isnan(v) & (v <= b)
    return out


def in_margined_box(point: list[Column], low: list[float], high: list[float], patch: float) -> Column:
    """Within low - patch (inclusive) and high + 2 patch (exclusive); the margins differ on purpose."""
    out = F.lit(True)
    for v, a, b in zip(point, low, high, strict=True):
        out = out & (v >= a - patch) & ~F.isnan(v) & (v < b + 2 * patch)
    return out


def above_plane(point: list[Column], plane: list[float]) -> Column:
    v = F.lit(float(plane[3]))
    for x, p in zip(point, plane[:3], strict=True):
        v = v + x * p
    return greater(v, 0.0)


def near_plane(z: Column, near: float = 0.2) -> Column:
    return greater(z, near)


def in_image(u: Column, v: Column, z: Column, width: int, height: int, near: float = 0.1) -> Column:
    return greater(u, 0) & (u < width) & greater(v, 0) & (v < height) & greater(z, near)


def in_polygon_volume(point: list[Column], polygon: list[tuple[float, float]], axis: int, low: float, high: float) -> Column:
    """Whether a point lies within [low, high] on `axis` and, over the other two axes, in the polygon (even-odd rule)."""
    a, b = (v for i, v in enumerate(point) if i != axis)
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y0 != y1:
            straddles = (F.lit(float(y0)) > b) != (F.lit(float(y1)) > b)
            crossings = crossings + F.when(straddles & (a < (b - y0) * ((x1 - x0) / (y1 - y0)) + x0), 1).otherwise(0)
    return point[axis].between(low, high) & (crossings % 2 == 1)


def observed(points: DataFrame, mask: DataFrame, origin: list[float], resolution: float, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Points whose nearest grid cell (halves to even) is in `mask` (i, j, k, observed) and observed."""
    cells = [F.bround((F.col(c) - o) / resolution).cast("int") for c, o in zip(xyz, origin, strict=True)]
    keyed = points.withColumns({f"_{n}": c for n, c in zip("ijk", cells, strict=True)})
    seen = mask.filter("observed").select(*[F.col(n).alias(f"_{n}") for n in "ijk"])
    return keyed.join(seen, ["_i", "_j", "_k"], "left_semi").drop("_i", "_j", "_k")


def faces_of(faces: DataFrame, vertices: DataFrame, vid: str = "vid") -> DataFrame:
    """Faces (fid, v0, v1, v2) all of whose vertices are there."""
    out = faces
    for c in ("v0", "v1", "v2"):
        out = out.join(vertices.select(F.col(vid).alias(c)), c, "left_semi")
    return out.select(faces.columns)


def views_agree(observations: DataFrame, key: str, ok: Column, least: int | None = None) -> DataFrame:
    """Keys whose every observation is ok, or at least `least` of them."""
    g = observations.groupBy(key).agg(F.count_if(ok).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    return g.filter(F.col("_ok") == F.col("_n") if least is None else F.col("_ok") >= least).select(key)


def trim_by_views(rows: DataFrame, key: str, view: str, observed: Column, least: int = 2) -> DataFrame:
    """(key, views) of the keys observed in at least `least` views."""
    return rows.filter(observed).groupBy(key).agg(F.count_distinct(view).alias("views")).filter(F.col("views") >= least)


def track_inliers(observations: DataFrame, track: str, frame: str, error: Column, most: float, least_frames: int = 2, least_a_frame: int = 64) -> DataFrame:
    """Inlier observations of tracks with inliers in `least_frames` frames; none if a frame keeps under `least_a_frame`."""
    inliers = observations.filter(error <= most)
    frames = observations.select(frame).distinct().join(inliers.groupBy(frame).agg(F.count(F.lit(1)).alias("_n")), frame, "left")
    short = frames.filter(F.coalesce("_n", F.lit(0)) < least_a_frame).agg(F.count(F.lit(1)).alias("_short"))
    tracks = inliers.groupBy(track).agg(F.count_distinct(frame).alias("_f")).filter(F.col("_f") >= least_frames)
    return inliers.join(tracks.select(track), track, "left_semi").join(F.broadcast(short)).filter("_short = 0").drop("_short")  # one row


def small_errors(errors: DataFrame, rotation: float = 1.0, centre: float = 0.1, expected: int | None = None) -> DataFrame:
    """(n, too_large, ok): the regression gate over rotation_error and proj_center_error."""
    bad = (F.col("rotation_error") > rotation) | (F.col("proj_center_error") > centre) | F.isnan("rotation_error") | F.isnan("proj_center_error")
    out = errors.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("too_large"))
    return out.withColumn("ok", (F.col("too_large") == 0) & ((F.col("n") == expected) if expected is not None else F.lit(True)))


def depth_mask(depth: Column, alpha: Column, cos_angle: Column, most_depth: float, least_alpha: float = 0.5, most_degrees: float = 80.0) -> Column:
    """The depth, or 0 where it is too far, too transparent or seen at a grazing angle."""
    grazing = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(cos_angle)))) > most_degrees
    return F.when((depth > most_depth) | F.isnan(depth) | (alpha < least_alpha) | grazing, 0.0).otherwise(depth)


def cycle_weight(error: Column, most: float = 1.0) -> Column:
    """exp(-error) of reprojection cycles under `most` pixels, else 0."""
    return F.when(~F.isnan(error) & (error < most), F.exp(-error)).otherwise(0.0)


def quantile_codebook(df: DataFrame, value: str, levels: int = 65536) -> DataFrame:
    """(level, value): for each of `levels` evenly spaced fractions the value at the nearest place in ascending order.

    Places come from counts per distinct value.
    """
    ends = value_ends(df.select(F.col(value).alias("_v")), "_v")
    step = F.lit(float(levels - 1))
    first = F.ceil((F.col("_end") - F.col("_n") - 0.5) * step / F.greatest(F.col("_total") - 1, F.lit(1)))
    last = F.ceil((F.col("_end") - 0.5) * step / F.greatest(F.col("_total") - 1, F.lit(1))) - 1
    span = ends.select("_v", F.greatest(first, F.lit(0)).alias("_a"), F.least(F.when(F.col("_total") == 1, levels - 1).otherwise(last), F.lit(levels - 1)).alias("_b"))
    return span.filter("_b >= _a").select(F.explode(F.sequence(F.col("_a").cast("int"), F.col("_b").cast("int"))).alias("level"), F.col("_v").alias("value"))


def missing_files(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present.select(key), key, "left_anti")


def present_files(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present.select(key), key, "left_semi")


def common_names(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Rows of two models with the same name, the columns of both but b's name."""
    other = b.withColumnRenamed(name, "_name")
    return a.join(other, F.col(name) == F.col("_name")).drop("_name")
