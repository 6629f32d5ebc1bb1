"""Which points cameras see: cells against view volumes, then points against depth maps.

Cameras are rows (view, r, t, fx, fy, cx, cy, width, height), depth maps rows (view, x, y, depth), points rows with an id and coordinates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions import vectors as V
from pointloom.operators.checkpoints import cut
from pointloom.operators.evidence import _camera
from pointloom.operators.order import prefix_sum


def _corner(u: float | Column, v: float | Column, z: Column, i: int) -> Column:
    """World coordinate i of the pixel (u, v) at depth z, in _camera's columns."""
    ray = [(u - F.col("_ccx")) / F.col("_cfx") * z, (v - F.col("_ccy")) / F.col("_cfy") * z, z]
    return V.total([F.col(f"_cr{3 * j + i}") * (ray[j] - F.col(f"_ct{j}")) for j in range(3)])


def seen_cells(cameras: DataFrame, far: DataFrame, width: float) -> DataFrame:
    """(view, cx, cy, cz): cells of that width which may hold something that the camera sees, up to its depth `far` (view, far).

    Of the cells in the box around the view volume, a pyramid from the camera to its depth `far`, those stay whose
    enclosing sphere no side of the volume leaves outside. Columns of cells are unfolded one axis at a time, each against the sides.
    """
    c = _camera(cameras, "_c").join(far.select(F.col("view").alias("_w"), F.col("far").alias("_far")).hint("merge"), F.col("_cview") == F.col("_w")).filter("_far > 0")
    corners = [[_corner(F.lit(0.0), F.lit(0.0), F.lit(0.0), i)] + [_corner(u, v, F.col("_far"), i) for u in (F.lit(0.0), F.col("_cwidth") - 1) for v in (F.lit(0.0), F.col("_cheight") - 1)] for i in range(3)]
    boxed = c.withColumns({f"_lo{i}": F.floor(F.least(*x) / width) for i, x in enumerate(corners)} | {f"_hi{i}": F.floor(F.greatest(*x) / width) for i, x in enumerate(corners)})
    # A side's normal in the camera's axes points inwards; a cell is out where its centre lies further outside than its radius.
    left, right = (F.col("_ccx") / F.col("_cfx"), (F.col("_cwidth") - 1 - F.col("_ccx")) / F.col("_cfx"))
    top, bottom = (F.col("_ccy") / F.col("_cfy"), (F.col("_cheight") - 1 - F.col("_ccy")) / F.col("_cfy"))
    sides = [(F.lit(1.0), F.lit(0.0), left), (F.lit(-1.0), F.lit(0.0), right), (F.lit(0.0), F.lit(1.0), top), (F.lit(0.0), F.lit(-1.0), bottom)]
    radius = width * 3**0.5 / 2
    cells = boxed
    for i, n in enumerate(("cx", "cy", "cz")):
        cells = cells.withColumn(n, F.explode(F.sequence(F.col(f"_lo{i}"), F.col(f"_hi{i}"))))
    middle = [(F.col(n) + 0.5) * width for n in ("cx", "cy", "cz")]
    placed = cells.withColumns({f"_p{i}": V.total([F.col(f"_cr{3 * i + j}") * middle[j] for j in range(3)]) + F.col(f"_ct{i}") for i in range(3)})
    inside = (F.col("_p2") >= -radius) & (F.col("_p2") <= F.col("_far") + radius)
    for a, b, c_ in sides:
        inside = inside & (a * F.col("_p0") + b * F.col("_p1") + c_ * F.col("_p2") >= -radius * F.sqrt(a * a + b * b + c_ * c_))
    return placed.filter(inside).select(F.col("_cview").alias("view"), "cx", "cy", "cz")


def depth_quads(depths: DataFrame) -> DataFrame:
    """(view, qx, qy, d00, d10, d01, d11): every pixel with those right of it, below it, and both; null where there is none."""
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    each = depths.select("view", "x", "y", F.col("depth").cast("double").alias("depth"), corner.alias("c"))
    at = each.select("view", (F.col("x") - F.col("c.i")).alias("qx"), (F.col("y") - F.col("c.j")).alias("qy"), F.concat(F.lit("d"), F.col("c.i").cast("string"), F.col("c.j").cast("string")).alias("corner"), "depth")
    one = lambda n: F.max(F.when(F.col("corner") == n, F.col("depth"))).alias(n)
    return at.filter("qx >= 0 AND qy >= 0").groupBy("view", "qx", "qy").agg(*[one(n) for n in ("d00", "d10", "d01", "d11")])


def _located(points: DataFrame, cameras: DataFrame, depths: DataFrame, width: float, margin: float, pid: str, xyz: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(pid, wx, wy, wz, cx, cy, cz) of the points, and (view, far), how deep each view has to be searched."""
    cell = [F.floor(F.col(c) / width).alias(n) for c, n in zip(xyz, ("cx", "cy", "cz"), strict=True)]
    located = points.select(F.col(pid).alias("pid"), *[F.col(c).cast("double").alias(w) for c, w in zip(xyz, ("wx", "wy", "wz"), strict=True)], *cell)
    box = located.agg(*[F.min(w).alias(f"_a{i}") for i, w in enumerate(("wx", "wy", "wz"))], *[F.max(w).alias(f"_b{i}") for i, w in enumerate(("wx", "wy", "wz"))])
    most = depths.groupBy("view").agg(F.max("depth").alias("_most"), F.count_if(F.col("depth") > 0).alias("_full"))
    c = _camera(cameras, "_c").join(F.broadcast(box))  # one row
    # The depth of a box's corner that is farthest along the camera's axis.
    reach = V.total([F.greatest(F.col(f"_cr{6 + i}") * F.col(f"_a{i}"), F.col(f"_cr{6 + i}") * F.col(f"_b{i}")) for i in range(3)]) + F.col("_ct2")
    far = c.select("_cview", "_cwidth", "_cheight", reach.alias("_reach")).join(most.hint("merge"), F.col("_cview") == F.col("view"), "left")
    bounded = F.coalesce(F.col("_full") == F.col("_cwidth") * F.col("_cheight"), F.lit(False))
    far = cut(far.select(F.col("_cview").alias("view"), F.when(bounded, F.least(F.col("_most") + margin, F.col("_reach"))).otherwise(F.col("_reach")).alias("far")))
    return located, far


def sightings(points: DataFrame, cameras: DataFrame, depths: DataFrame, width: float, margin: float = 0.005, pid: str = "pid", xyz: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(pid, view, z, depth): each point in each view that sees it: on its raster, in front of it, and nearer than the depth there plus margin.

    depth is interpolated between the four pixels around; where it isn't over 0 (or missing) nothing hides the point. A camera
    meets the points of those cells only that seen_cells gives for its largest depth, or, if it has a pixel without depth, for
    the farthest corner of the points' box; such pairs then meet the depth map by pixel. No other pair becomes a row.
    """
    located, far = _located(points, cameras, depths, width, margin, pid, xyz)
    # Points and pixels are the smaller sides by far, and hashed: what meets them isn't sorted.
    met = seen_cells(cameras, far, width).join(located.hint("shuffle_hash"), ["cx", "cy", "cz"]).select("pid", "view", "wx", "wy", "wz")
    rows = met.join(_camera(cameras, "_c"), F.col("view") == F.col("_cview"))
    w = F.col("wx"), F.col("wy"), F.col("wz")
    rows = rows.withColumns({f"_v{i}": V.total([F.col(f"_cr{3 * i + j}") * w[j] for j in range(3)]) + F.col(f"_ct{i}") for i in range(3)}).filter("_v2 > 0")
    rows = rows.withColumns({"_u": F.col("_cfx") * F.col("_v0") / F.col("_v2") + F.col("_ccx"), "_v": F.col("_cfy") * F.col("_v1") / F.col("_v2") + F.col("_ccy")})
    rows = rows.filter("_u >= 0 AND _u <= _cwidth - 1 AND _v >= 0 AND _v <= _cheight - 1")
    quad = {"_qx": F.least(F.floor("_u"), (F.col("_cwidth") - 2).cast("long")), "_qy": F.least(F.floor("_v"), (F.col("_cheight") - 2).cast("long"))}
    rows = rows.withColumns(quad).select("pid", "view", F.col("_v2").alias("z"), "_qx", "_qy", (F.col("_u") - F.col("_qx")).alias("_fx"), (F.col("_v") - F.col("_qy")).alias("_fy"))
    quads = depth_quads(depths).withColumnRenamed("view", "_view")
    found = rows.join(quads.hint("shuffle_hash"), (F.col("view") == F.col("_view")) & (F.col("_qx") == F.col("qx")) & (F.col("_qy") == F.col("qy")), "left")
    fx, fy = F.col("_fx"), F.col("_fy")
    depth = (F.col("d00") * (1 - fx) + F.col("d10") * fx) * (1 - fy) + (F.col("d01") * (1 - fx) + F.col("d11") * fx) * fy
    found = found.withColumn("depth", depth)
    return found.filter(F.coalesce((F.col("depth") <= 0) | (F.col("z") < F.col("depth") + margin), F.lit(True))).select("pid", "view", "z", "depth")


#: Pixels of a depth map that goes to the tasks whole; views, points and pixels that meet in a task.
MAP_PIXELS, VIEWS, POINTS, PIXELS = 4096, 32768, 262144, 4194304

#: Points in a leaf of a task's tree, and tests of boxes or points made at once; tests worth a task, and cells that are broadcast; tasks at most.
LEAF, TESTS, WORTH, CELLS, TASKS = 16, 16384, 2097152, 65536, 4096

_NUMBERS = [*[f"_cr{i}" for i in range(9)], *[f"_ct{i}" for i in range(3)], "_cfx", "_cfy", "_ccx", "_ccy", "_cwidth", "_cheight"]


def _maps(cameras: DataFrame, depths: DataFrame) -> DataFrame:
    """cameras, every number a column, with `map`: the view's depths row by row, NaN where there is none."""
    pixels = depths.filter("depth IS NOT NULL").groupBy(F.col("view").alias("_w")).agg(F.collect_list(F.struct(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("depth").cast("double").alias("d"))).alias("_pixels"))
    rows = _camera(cameras, "_c").join(pixels.hint("merge"), F.col("_cview") == F.col("_w"), "left").drop("_w").withColumn("_pixels", F.coalesce("_pixels", F.array().cast("array<struct<x:bigint,y:bigint,d:double>>")))
    kept = [c for c in rows.columns if c != "_pixels"]

    def dense(batches):
        for b in batches:
            maps = []
            for w, h, pixels in zip(b.column("_cwidth").to_pylist(), b.column("_cheight").to_pylist(), b.column("_pixels"), strict=True):
                x, y, d = (pixels.values.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y", "d"))
                ok, out = (x >= 0) & (y >= 0) & (x < w) & (y < h), np.full(int(w) * int(h), -np.inf)
                np.maximum.at(out, y[ok] * int(w) + x[ok], d[ok])
                maps.append(np.where(out == -np.inf, np.nan, out))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(maps, pa.list_(pa.float64()))], [*kept, "map"])

    return rows.mapInArrow(dense, T.StructType([*rows.select(*kept).schema.fields, T.StructField("map", T.ArrayType(T.DoubleType()))]))


def _tree(p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the points p (3 x n) by leaf (leaves x points of one; from n on, the last point again), and the tree's boxes.

    Boxes are (6 x boxes) a level, roots first: centres and half sides, widened by what rounding may do. Box i holds those from 8i of the next level.
    """
    n = p.shape[1]
    halvings = max(0, int(np.ceil(np.log2(n / LEAF))))
    order = np.arange(-(-n // 2**halvings) * 2**halvings)[None, :]
    p = np.ascontiguousarray(p[:, np.minimum(order[0], n - 1)])

    def ends():
        part, axis = (p.take(order.T, 1), 1) if len(order) > order.shape[1] else (p.take(order, 1), 2)
        return part.min(axis), part.max(axis)

    for _ in range(halvings):
        lo, hi = ends()
        values = p.ravel().take(order + (hi - lo).argmax(0)[:, None] * p.shape[1])
        half = order.shape[1] // 2
        order = np.take_along_axis(order, np.argpartition(values, half, axis=1), 1).reshape(-1, half)
    (lo, hi), boxes = ends(), []
    while True:
        middle, side = (lo + hi) / 2, (hi - lo) / 2
        boxes.insert(0, np.concatenate([middle, side + 1e-12 * (np.abs(middle) + side)]))
        if lo.shape[1] < 8:
            return order, boxes
        lo, hi = lo.reshape(3, -1, 8).min(2), hi.reshape(3, -1, 8).max(2)


def _extremes(depths: np.ndarray, first: np.ndarray, wide: np.ndarray, u0: np.ndarray, u1: np.ndarray, v0: np.ndarray, v1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest depth in a rectangle of the patch between the pixel `first` and those right of it and below: those at its corners."""
    below = first + wide
    d00, d10, d01, d11 = depths.take(first), depths.take(first + 1), depths.take(below), depths.take(below + 1)
    left, right = 1 - u0, 1 - u1
    a, b, c, d = d00 * left + d10 * u0, d00 * right + d10 * u1, d01 * left + d11 * u0, d01 * right + d11 * u1
    top, bottom = 1 - v0, 1 - v1
    w, x, y, z = a * top + c * v0, a * bottom + c * v1, b * top + d * v0, b * bottom + d * v1
    return np.minimum(np.minimum(w, x), np.minimum(y, z)), np.maximum(np.maximum(w, x), np.maximum(y, z))


def _judged(c: np.ndarray, base: np.ndarray, tol: np.ndarray, box: np.ndarray, depths: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether all points of a box are seen, and whether that is open; of box i by camera i. What is neither is seen at no point.

    Bounds of the box in the camera's axes give a rectangle on the raster, which has a verdict if it lies on no more than two by two
    patches between pixels. Unknown depths are far below 0: nothing is hidden there, and no box with such a corner goes unseen.
    """
    mid = [c[3 * i] * box[0] + c[3 * i + 1] * box[1] + c[3 * i + 2] * box[2] + c[9 + i] for i in range(3)]
    side = [np.abs(c[3 * i]) * box[3] + np.abs(c[3 * i + 1]) * box[4] + np.abs(c[3 * i + 2]) * box[5] + 1e-12 * np.abs(c[9 + i]) for i in range(3)]
    near, far, ends = mid[2] - side[2], mid[2] + side[2], []
    for i in (0, 1):
        x, y = c[12 + i] * (mid[i] - side[i]), c[12 + i] * (mid[i] + side[i])
        x, y = np.minimum(x, y), np.maximum(x, y)
        lo, hi = np.minimum(x / near, x / far) + c[14 + i], np.maximum(y / near, y / far) + c[14 + i]
        slack = 1e-12 * (np.abs(lo) + np.abs(hi) + np.abs(c[14 + i]))
        ends += [lo - slack, hi + slack]
    right, low = c[16] - 1, c[17] - 1
    unseen = (far <= 0) | ((near > 0) & ((ends[1] < 0) | (ends[0] > right) | (ends[3] < 0) | (ends[2] > low)))
    at = np.flatnonzero((near > 0) & ~unseen)
    u0, u1, v0, v1, right, low, near, far = (x.take(at) for x in (*ends, right, low, near, far))
    whole = (u0 >= 0) & (u1 <= right) & (v0 >= 0) & (v1 <= low)
    # A rectangle that is cut at the raster's edge keeps a width, so that no pixel but the edge's is left out.
    u0, v0 = np.minimum(np.maximum(u0, 0), right - 1e-9), np.minimum(np.maximum(v0, 0), low - 1e-9)
    u1, v1 = np.minimum(np.maximum(u1, 1e-9), right), np.minimum(np.maximum(v1, 1e-9), low)
    q, r = np.floor(u0), np.floor(v0)
    u0, u1, v0, v1 = u0 - q, u1 - q, v0 - r, v1 - r
    few = np.flatnonzero((u1 <= 2) & (v1 <= 2))
    if len(few) < len(at):
        at, near, far, whole, right, q, r, u0, u1, v0, v1 = (x.take(few) for x in (at, near, far, whole, right, q, r, u0, u1, v0, v1))
    wide, tol = (right + 1).astype(np.int64), tol.take(at)
    first = base.take(at) + (r * (right + 1) + q).astype(np.int64)
    m, n = np.minimum(u1, 1), np.minimum(v1, 1)
    least, most = _extremes(depths, first, wide, u0, m, v0, n)
    for over, across, down in ((u1 > 1, 1, 0), (v1 > 1, 0, 1), ((u1 > 1) & (v1 > 1), 1, 1)):
        k = np.flatnonzero(over)
        us = (np.zeros(len(k)), u1.take(k) - 1) if across else (u0.take(k), m.take(k))
        vs = (np.zeros(len(k)), v1.take(k) - 1) if down else (v0.take(k), n.take(k))
        lo, hi = _extremes(depths, first.take(k) + across + down * wide.take(k), wide.take(k), *us, *vs)
        least[k], most[k] = np.minimum(least.take(k), lo), np.maximum(most.take(k), hi)
    seen = np.zeros(len(unseen), bool)
    seen[at] = whole & ((far < least + margin - tol) | (most <= 0))
    unseen[at] |= (least > tol) & (near >= most + margin + tol)
    return seen, ~(seen | unseen)


def _sights(cameras: np.ndarray, depths: np.ndarray, base: np.ndarray, p: np.ndarray, margin: float) -> np.ndarray:
    """By how many of the cameras (_NUMBERS x cameras) each of the points p (3 x n) is seen; a camera's depths begin at its base.

    A tree over the points settles whole boxes that a camera sees, or doesn't; only points of leaves that stay open are tested
    one by one. Pairs of cameras and boxes wait by level, the deepest that fill a lot go first, so few are held at once.
    """
    with np.errstate(all="ignore"):
        order, boxes = _tree(p)
        leaves, size = order.shape
        x = [np.ascontiguousarray(w[np.minimum(order, p.shape[1] - 1)].T) for w in p]
        sound = np.isfinite(depths)
        bounds, most = np.where(sound, depths, -1e300), np.maximum.reduceat(np.where(sound, np.abs(depths), 0), base)
        tol, counts, single, held = 1e-9 * (1 + most), [np.zeros(b.shape[1], np.int64) for b in boxes], np.zeros(order.size, np.int64), []
        roots = boxes[0].shape[1]
        waiting = [[] for _ in range(len(boxes) + 1)]
        waiting[0].append((np.repeat(np.arange(len(base)), roots), np.tile(np.arange(roots), len(base))))

        def points(views, at):
            c, w, n = cameras.take(views, 1), [k.take(at, 1) for k in x], len(views)
            v = [c[3 * i] * w[0] + c[3 * i + 1] * w[1] + c[3 * i + 2] * w[2] + c[9 + i] for i in range(3)]
            u, t = c[12] * v[0] / v[2] + c[14], c[13] * v[1] / v[2] + c[15]
            on = np.flatnonzero((v[2] > 0) & (u >= 0) & (u <= c[16] - 1) & (t >= 0) & (t <= c[17] - 1))
            row = on // n
            pair = on - row * n
            u, t, z, wide, high = u.take(on), t.take(on), v[2].take(on), c[16].take(pair), c[17].take(pair)
            qx, qy = np.minimum(np.floor(u), wide - 2), np.minimum(np.floor(t), high - 2)
            first = base.take(views).take(pair) + (qy * wide + qx).astype(np.int64)
            below = first + wide.astype(np.int64)
            u, t = u - qx, t - qy
            depth = (depths.take(first) * (1 - u) + depths.take(first + 1) * u) * (1 - t) + (depths.take(below) * (1 - u) + depths.take(below + 1) * u) * t
            seen = np.flatnonzero(~((depth > 0) & (z >= depth + margin)))
            held.append(at.take(pair.take(seen)) * size + row.take(seen))
            if sum(map(len, held)) > 1048576:
                settle()

        def settle():
            if held:
                single[:] += np.bincount(np.concatenate(held), minlength=order.size)
                held.clear()

        while any(waiting):
            full = [i for i, w in enumerate(waiting) if sum(len(v) for v, _ in w) >= TESTS]
            level = full[-1] if full else next(i for i, w in enumerate(waiting) if w)
            v, k = (np.concatenate(w) for w in zip(*waiting[level], strict=True))
            waiting[level] = []
            if level == len(boxes):
                for i in range(0, len(v), TESTS // size + 1):
                    points(v[i : i + TESTS // size + 1], k[i : i + TESTS // size + 1])
                continue
            if len(v) > TESTS:
                waiting[level].append((v[TESTS:], k[TESTS:]))
                v, k = v[:TESTS], k[:TESTS]
            seen, left = map(np.flatnonzero, _judged(cameras.take(v, 1), base.take(v), tol.take(v), boxes[level].take(k, 1), bounds, margin))
            counts[level] += np.bincount(k.take(seen), minlength=len(counts[level]))
            if len(left) and level == len(boxes) - 1:
                waiting[level + 1].append((v.take(left), k.take(left)))
            elif len(left):
                waiting[level + 1].append((np.repeat(v.take(left), 8), (k.take(left)[:, None] * 8 + np.arange(8)).ravel()))
        settle()
        total = counts[0]
        for c in counts[1:]:
            total = np.repeat(total, 8) + c
        out = np.empty(order.size, np.int64)
        out[order.ravel()] = np.repeat(total, size) + single
        return out[: p.shape[1]]


def _lots(located: DataFrame) -> DataFrame:
    """(cx, cy, cz, lot, parts): cells in order dealt to lots of about POINTS points, and in how many parts the points of a larger cell go."""
    cells = located.filter("cx IS NOT NULL AND cy IS NOT NULL AND cz IS NOT NULL").groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("_points"))
    ends = prefix_sum(cells.withColumn("_at", F.struct("cx", "cy", "cz")), "_at", "_points", "_end")
    return cut(ends.select("cx", "cy", "cz", F.floor((F.col("_end") - F.col("_points")) / POINTS).alias("lot"), F.ceil(F.col("_points") / POINTS).alias("parts"), "_points"))


def _counts(points: DataFrame, cameras: DataFrame, depths: DataFrame, width: float, margin: float, pid: str, xyz: tuple[str, ...]) -> DataFrame:
    """(pid, n): how many views see a point, of those that do; counted in blocks of views and points, so sightings are no rows.

    Points go by lots of cells, and a view meets the lots with a cell that it may see. Only a row a lot and up to CELLS cells
    are broadcast: Parquet sizes say little of what dictionaries of few numbers take in memory.
    """
    located, far = _located(points, cameras, depths, width, margin, pid, xyz)
    cells, keys = ["cx", "cy", "cz"], ["lot", "part", "bucket"]
    lots = _lots(located)
    n_cells, n_lots = lots.agg(F.count(F.lit(1)), F.count_distinct("lot")).first()
    few = "broadcast" if n_cells <= CELLS else "merge"
    dealt = lots.select(*cells, "lot", "parts").hint(few)
    seen = cut(seen_cells(cameras, far, width).join(dealt, cells).select("view", "lot").distinct())
    # As many views meet in a task as their pixels allow, but few lots of some size are dealt to 32 tasks in all.
    most = max(1, int(cameras.agg(F.max(F.col("width") * F.col("height"))).first()[0] or 1))
    held = lots.groupBy("lot").agg(F.max("parts").alias("_parts"), F.sum("_points").alias("_held"))
    worth = F.least(F.lit(-(-32 // max(1, n_lots))), F.ceil(F.col("_held") / F.col("_parts") * F.col("_asked") / WORTH))
    buckets = F.greatest(F.ceil(F.col("_asked") / max(1, min(VIEWS, PIXELS // most))), worth)
    blocks = cut(held.join(seen.groupBy("lot").agg(F.count(F.lit(1)).alias("_asked")), "lot").select("lot", "_parts", buckets.alias("_buckets")))
    tasks = min(max(1, blocks.agg(F.sum(F.col("_parts") * F.col("_buckets"))).first()[0] or 1), TASKS)
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    views = seen.join(blocks.hint("broadcast"), "lot").withColumn("bucket", hashed("view", "_buckets")).withColumn("part", each("_parts")).drop("_parts", "_buckets")
    views = views.join(_maps(cameras, depths).hint("merge"), F.col("view") == F.col("_cview")).drop("_cview", "view")
    near = located.join(dealt, cells).drop(*cells).join(blocks.hint("broadcast"), "lot").withColumn("part", hashed("pid", "parts")).withColumn("bucket", each("_buckets")).drop("parts", "_parts", "_buckets")

    def task(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(len(right), np.int64)
        if len(left) and len(right):
            maps = left.column("map").combine_chunks()
            sizes = pc.list_value_length(maps).to_numpy(zero_copy_only=False).astype(np.int64)
            number = lambda t, names: np.stack([t.column(c).to_numpy() for c in names])
            n = _sights(number(left, _NUMBERS), maps.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes, number(right, ("wx", "wy", "wz")), margin)
        return pa.table({"pid": right.column("pid"), "n": n}).filter(pa.array(n > 0))

    schema = T.StructType([located.schema["pid"], T.StructField("n", T.LongType())])
    return views.repartition(tasks, *keys).groupBy(*keys).cogroup(near.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(task, schema)


def visible(points: DataFrame, cameras: DataFrame, depths: DataFrame, width: float, least: int = 20, margin: float = 0.005, pid: str = "pid", xyz: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(pid, views, seen): in how many views each point is, and whether in `least` of them; points in none have 0.

    Depth maps of up to MAP_PIXELS go to the cells whole and sightings are counted where they arise; views of larger ones meet points pixel by pixel.
    """
    small = F.coalesce((F.col("width") >= 2) & (F.col("height") >= 2) & (F.col("width") * F.col("height") <= MAP_PIXELS) & (F.floor("width") == F.col("width")) & (F.floor("height") == F.col("height")), F.lit(False))
    large = cameras.filter(~small)
    mixed = not large.isEmpty()
    found = _counts(points, cameras.filter(small), depths.join(cameras.filter(small).hint("merge"), "view", "left_semi") if mixed else depths, width, margin, pid, xyz)
    if mixed:
        found = found.unionByName(sightings(points, large, depths.join(large.hint("merge"), "view", "left_semi"), width, margin, pid, xyz).select("pid", F.lit(1).cast("long").alias("n")))
    views = found.groupBy("pid").agg(F.sum("n").alias("_n"))
    out = points.select(F.col(pid).alias("pid")).join(views, "pid", "left")
    return out.select("pid", F.coalesce("_n", F.lit(0).cast("long")).alias("views"), (F.coalesce("_n", F.lit(0)) >= least).alias("seen"))
