"""Pinhole cameras, distortion, splat footprints."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions import vectors as V


def focal_to_fov(focal: Column, pixels: Column) -> Column:
    return 2 * F.atan(pixels / (2 * focal))


def fov_to_focal(fov: Column, pixels: Column) -> Column:
    return pixels / (2 * F.tan(fov / 2))


def projection(near: float, far: float, fov_x: Column, fov_y: Column, centre_x: Column | None = None, centre_y: Column | None = None) -> Column:
    """4x4 perspective matrix; centre_*: offset of the principal point as a fraction of half the image."""
    zero, one = F.lit(0.0), F.lit(1.0)
    cx = centre_x if centre_x is not None else zero
    cy = centre_y if centre_y is not None else zero
    return F.array(1 / F.tan(fov_x / 2), zero, cx, zero, zero, 1 / F.tan(fov_y / 2), cy, zero, zero, zero, F.lit(far / (far - near)), F.lit(-(far * near) / (far - near)), zero, zero, one, zero)


def ndc_to_pixel(v: Column, size: Column) -> Column:
    return ((v + 1.0) * size - 1.0) * 0.5


def unproject(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Camera coordinates of a pixel with depth; null where the depth is not over 1e-8."""
    return F.when(V.greater(depth, 1e-8), F.array((u - cx) * depth / fx, (v - cy) * depth / fy, depth))


def distort(u: Column, v: Column, params: Column, n_params: int) -> tuple[Column, Column]:
    """Normalised image coordinates under 0, 1 (radial), 2 (radial) or 4 (OpenCV) parameters."""
    if n_params == 0:
        return u, v
    r2 = u * u + v * v
    k = V.items(params, n_params)
    if n_params == 1:
        radial = k[0] * r2
        return u + u * radial, v + v * radial
    radial = k[0] * r2 + k[1] * r2 * r2
    if n_params == 2:
        return u + u * radial, v + v * radial
    if n_params != 4:
        raise ValueError("0, 1, 2 or 4 parameters")
    return u + u * radial + 2 * k[2] * u * v + k[3] * (r2 + 2 * u * u), v + v * radial + 2 * k[3] * u * v + k[2] * (r2 + 2 * v * v)


def project(point: Column, fx: Column, fy: Column, cx: Column, cy: Column, params: Column | None = None, n_params: int = 0, default: float = 0.0) -> Column:
    """Pixel of a point in camera coordinates; NaN and division by 0 give `default`."""
    z = point.getItem(2)
    u = V.safe_divide(point.getItem(0), z, float("nan"))
    v = V.safe_divide(point.getItem(1), z, float("nan"))
    du, dv = distort(u, v, params, n_params)
    return F.array(F.nanvl(fx * du + cx, F.lit(default)), F.nanvl(fy * dv + cy, F.lit(default)))


def undistort_udf(n_params: int, most: int = 100, enough: float = 1e-10, rel_step: float = 1e-6):
    """Arrow UDF (u, v, params) -> array of normalised undistorted coordinates, Newton steps with a numeric Jacobian."""

    def forward(u, v, k):
        r2 = u * u + v * v
        radial = k[0] * r2 + (k[1] * r2 * r2 if n_params > 1 else 0)
        du, dv = u * radial, v * radial
        if n_params == 4:
            du, dv = du + 2 * k[2] * u * v + k[3] * (r2 + 2 * u * u), dv + 2 * k[3] * u * v + k[2] * (r2 + 2 * v * v)
        return u + du, v + dv

    @F.pandas_udf("array<double>")
    def solve(u: pd.Series, v: pd.Series, params: pd.Series) -> pd.Series:
        goal = np.column_stack([u.to_numpy(float), v.to_numpy(float)])
        if not len(goal):
            return pd.Series([], dtype=object)
        k = np.stack([np.asarray(p, float) for p in params]).T
        x = goal.copy()
        for _ in range(most):
            a, b = x.T
            fa, fb = forward(a, b, k)
            sa, sb = np.maximum(np.abs(a * rel_step), np.finfo(float).eps), np.maximum(np.abs(b * rel_step), np.finfo(float).eps)
            pa, ma = forward(a + sa, b, k), forward(a - sa, b, k)
            pb, mb = forward(a, b + sb, k), forward(a, b - sb, k)
            j11, j21 = (pa[0] - ma[0]) / (2 * sa), (pa[1] - ma[1]) / (2 * sa)
            j12, j22 = (pb[0] - mb[0]) / (2 * sb), (pb[1] - mb[1]) / (2 * sb)
            ra, rb = goal[:, 0] - fa, goal[:, 1] - fb
            det = j11 * j22 - j12 * j21
            det = np.where(det == 0, 1, det)
            step = np.column_stack([(j22 * ra - j12 * rb) / det, (j11 * rb - j21 * ra) / det])
            x += step
            if np.max(np.sum(step**2, axis=1)) < enough:
                break
        return pd.Series(list(x))

    return solve


def covariance(scales: Column, rotation: Column, factor: float = 1.0) -> Column:
    """Upper triangle (xx, xy, xz, yy, yz, zz) of (R S)(R S)^T."""
    m = [[rotation.getItem(3 * i + j) * scales.getItem(j) * factor for j in range(3)] for i in range(3)]
    return F.array(*[V.total([m[i][k] * m[j][k] for k in range(3)]) for i in range(3) for j in range(i, 3)])


#: Added to the diagonal of a projected covariance.
LOW_PASS = 0.3


def projected_covariance(t: Column, cov: Column, rotation: Column, fx: Column, fy: Column, tan_x: Column, tan_y: Column) -> Column:
    """(xx, xy, yy) on the image of a covariance at t in view coordinates, t clamped to 1.3 times the field of view."""
    z = t.getItem(2)

    def clamp(v: Column, tan: Column) -> Column:
        most = tan * 1.3
        return F.least(most, F.greatest(-most, v / z)) * z

    x, y = clamp(t.getItem(0), tan_x), clamp(t.getItem(1), tan_y)
    j = [[fx / z, F.lit(0.0), -(fx * x) / (z * z)], [F.lit(0.0), fy / z, -(fy * y) / (z * z)]]
    w = [[rotation.getItem(3 * i + k) for k in range(3)] for i in range(3)]
    a = [[V.total([j[i][k] * w[k][c] for k in range(3)]) for c in range(3)] for i in range(2)]
    s = V.items(cov, 6)
    full = [[s[0], s[1], s[2]], [s[1], s[3], s[4]], [s[2], s[4], s[5]]]
    out = [[V.total([a[i][p] * full[p][q] * a[k][q] for p in range(3) for q in range(3)]) for k in range(2)] for i in range(2)]
    return F.array(out[0][0] + LOW_PASS, out[0][1], out[1][1] + LOW_PASS)


def conic(cov: Column) -> Column:
    """Inverse (xx, xy, yy) of a 2x2 covariance; null where it has none."""
    a, b, c = V.items(cov, 3)
    det = a * c - b * b
    d = F.nullif(det, F.lit(0.0))
    return F.when(det != 0, F.array(c / d, -b / d, a / d))


def splat_radius(cov: Column) -> Column:
    """Pixels within three standard deviations along the longer axis."""
    a, b, c = V.items(cov, 3)
    mid = (a + c) * 0.5
    return F.ceil(3.0 * F.sqrt(mid + F.sqrt(F.greatest(F.lit(0.1), mid * mid - (a * c - b * b))))).cast("int")


TILE = 16


def tile_rect(x: Column, y: Column, radius: Column, grid_x: int, grid_y: int, tile: int = TILE) -> list[Column]:
    """(x0, y0, x1, y1) of the tiles that a disc covers, ends exclusive; casts cut toward 0 before clamping."""

    def clip(v: Column, most: int) -> Column:
        return F.least(F.lit(most), F.greatest(F.lit(0), (v / tile).cast("int")))

    return [clip(x - radius, grid_x), clip(y - radius, grid_y), clip(x + radius + tile - 1, grid_x), clip(y + radius + tile - 1, grid_y)]


def plane_homography(rotation: Column, t: Column, normal: Column, distance: Column) -> Column:
    """R - t n^T / d with d at least 1e-6."""
    d = F.greatest(distance, F.lit(1e-6))
    return F.array(*[rotation.getItem(3 * i + j) - t.getItem(i) * normal.getItem(j) / d for i in range(3) for j in range(3)])


def warp(h: Column, x: Column, y: Column) -> Column:
    w = h.getItem(6) * x + h.getItem(7) * y + h.getItem(8) + 1e-10
    return F.array((h.getItem(0) * x + h.getItem(1) * y + h.getItem(2)) / w, (h.getItem(3) * x + h.getItem(4) * y + h.getItem(5)) / w)


def patch_offsets(half: int) -> Column:
    """All (dx, dy) of a square patch, y outermost."""
    return F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for y in range(-half, half + 1) for x in range(-half, half + 1)])


def exposure(colour: Column, a: Column, b: Column) -> Column:
    return F.exp(a) * colour + b


def target_width(width: Column, resolution: int, scale: float = 1.0) -> Column:
    """Working width: 1, 2, 4 and 8 divide and round; -1 caps at 1600; any other number is the width itself."""
    if resolution in (1, 2, 4, 8):
        return F.bround(width / (scale * resolution)).cast("int")
    goal = F.when(width > 1600, F.lit(1600.0)).otherwise(width) if resolution == -1 else F.lit(float(resolution))
    return (width / (width / goal * scale)).cast("int")


def learning_rate(step: Column, first: float, last: float, most: int, delay_steps: int = 0, delay_factor: float = 1.0) -> Column:
    """Log-linear from first to last over `most` steps, with a sine-shaped start; 0 before step 0."""
    if first == 0.0 and last == 0.0:
        return F.lit(0.0)

    def part(n: int) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), step / n))

    delay = delay_factor + (1 - delay_factor) * F.sin(0.5 * math.pi * part(delay_steps)) if delay_steps > 0 else F.lit(1.0)
    rate = F.exp(math.log(first) * (1 - part(most)) + math.log(last) * part(most))
    return F.when(step < 0, 0.0).otherwise(delay * rate)


def pixel_ray(x: Column, y: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    return F.array((x - cx) / fx, (y - cy) / fy, F.lit(1.0))


def ray_sphere(origin: Column, direction: Column, radius: float = 1.0) -> Column:
    """(near, far) of a unit ray and a sphere at 0, both cut at 0; null where it misses."""
    along = V.dot(origin, direction)
    under = along * along - (V.dot(origin, origin) - radius * radius)
    root = F.sqrt(F.greatest(under, F.lit(0.0)))
    return F.when(under > 0, F.array(F.greatest(-along - root, F.lit(0.0)), F.greatest(-along + root, F.lit(0.0))))


def panorama_pixel(ray: Column, width: int, height: int) -> Column:
    """Equirectangular pixel of a ray (x right, y down, z ahead)."""
    x, y, z = V.items(ray, 3)
    yaw, pitch = F.atan2(x, z), -F.atan2(y, F.sqrt(x * x + z * z))
    return F.array((1 + yaw / math.pi) / 2 * width, (1 - 2 * pitch / math.pi) / 2 * height)


def virtual_rotations(steps: int, pitches: list[float]) -> list[list[float]]:
    """Rotations (9 numbers) from a panorama to virtual cameras around it: for every pitch in degrees, `steps` yaws, half a step on where the pitch
    is over 0."""
    out = []
    for pitch in pitches:
        for k in range(steps):
            yaw = 360 * (k + (0.5 if pitch > 0 else 0)) / steps
            c, s = math.cos(math.radians(-pitch)), math.sin(math.radians(-pitch))
            d, t = math.cos(math.radians(-yaw)), math.sin(math.radians(-yaw))
            out.append([d, 0.0, t, s * t, c, -s * d, -c * t, s, c * d])
    return out


def decompose_projection_udf():
    """Arrow UDF: a 3x4 projection to (9 of K with K[2][2] = 1, 9 of R, 3 of the camera centre)."""

    @F.pandas_udf("array<double>")
    def split(p: pd.Series) -> pd.Series:
        out = []
        for x in p:
            m = np.asarray(x, float).reshape(3, 4)
            q, r = np.linalg.qr(np.flipud(m[:, :3]).T)
            k, rot = np.flipud(np.fliplr(r.T)), np.flipud(q.T)
            signs = np.diag(np.where(np.diag(k) < 0, -1.0, 1.0))
            k, rot = k @ signs, signs @ rot
            if np.linalg.det(rot) < 0:
                rot = -rot
            centre = -np.linalg.solve(m[:, :3], m[:, 3])
            out.append(np.concatenate([(k / k[2, 2]).ravel(), rot.ravel(), centre]))
        return pd.Series(out, dtype=object)

    return split


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def rescaled(fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column, by_x: Column, by_y: Column, left: Column, top: Column) -> Column:
    """(fx, fy, cx, cy, width, height) of an image that is resized by a factor on each axis and then cut at left and top."""
    return F.struct(
        (fx * by_x).alias("fx"), (fy * by_y).alias("fy"), (cx * by_x - left).alias("cx"), (cy * by_y - top).alias("cy"),
        F.round(width * by_x).cast("int").alias("width"), F.round(height * by_y).cast("int").alias("height"),
    )
