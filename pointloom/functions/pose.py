"""Rotations, rigid and similarity transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions import eigen
from pointloom.functions import vectors as V


def quaternion_to_rotation(q: Column, unit: bool = True) -> Column:
    """Row-major 3x3 of a (w, x, y, z) quaternion; unit=False normalises first."""
    q = q if unit else V.normalize(q, 4)
    w, x, y, z = V.items(q, 4)
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def rotation_to_quaternion(r: Column) -> Column:
    """(w, x, y, z) with w >= 0, by the largest of the four diagonal combinations."""

    def from_squares(m: list[Column], s: Column) -> Column:
        w, x, y, z = [F.sqrt(F.greatest(s.getItem(i), F.lit(0.0))) * 2 for i in range(4)]
        forms = [
            (w / 4, (m[7] - m[5]) / w, (m[2] - m[6]) / w, (m[3] - m[1]) / w),
            ((m[7] - m[5]) / x, x / 4, (m[1] + m[3]) / x, (m[2] + m[6]) / x),
            ((m[2] - m[6]) / y, (m[1] + m[3]) / y, y / 4, (m[5] + m[7]) / y),
            ((m[3] - m[1]) / z, (m[2] + m[6]) / z, (m[5] + m[7]) / z, z / 4),
        ]
        first = F.array_position(s, F.array_max(s))
        q = F.when(first == 1, F.array(*forms[0])).when(first == 2, F.array(*forms[1])).when(first == 3, F.array(*forms[2])).otherwise(F.array(*forms[3]))
        return V.let(q, lambda v: F.when(v.getItem(0) < 0, V.scale(v, -1.0, 4)).otherwise(v))

    def of(r: Column) -> Column:
        m = V.items(r, 9)
        squares = F.array(1 + m[0] + m[4] + m[8], 1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8])
        return V.let(squares, lambda s: from_squares(m, s))

    return V.let(r, of)


def world_to_view(rotation: Column, translation: Column, shift: Column | None = None, factor: float = 1.0) -> Column:
    """4x4 of a camera whose centre is moved by `shift` and then scaled by `factor`."""
    def of(r: Column) -> Column:
        def placed(centre: Column) -> Column:
            moved = V.scale(V.add(centre, shift) if shift is not None else centre, factor)
            return V.let(moved, lambda m: V.let(V.matvec(r, m), lambda t: rigid(r, V.scale(t, -1.0))))

        return V.let(camera_centre(r, translation), placed)

    return V.let(rotation, of)


def rigid(rotation: Column, t: Column) -> Column:
    rows = [[rotation.getItem(3 * i + j) for j in range(3)] + [t.getItem(i)] for i in range(3)]
    return F.array(*[x for row in rows for x in row], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def camera_centre(rotation: Column, translation: Column) -> Column:
    return V.let(rotation, lambda r: V.let(translation, lambda t: V.let(V.matvec(V.transpose(r), t), lambda c: V.scale(c, -1.0))))


def inverse_rigid(pose: Column) -> Column:
    """Inverse of a rigid 4x4 (or 3x4) in closed form."""

    def of(p: Column) -> Column:
        back = F.array(*[p.getItem(4 * j + i) for i in range(3) for j in range(3)])
        t = F.array(*[p.getItem(4 * i + 3) for i in range(3)])
        return V.let(back, lambda r: V.let(V.matvec(r, t), lambda x: rigid(r, V.scale(x, -1.0))))

    return V.let(pose, of)


def pad_pose(pose: Column) -> Column:
    """3x4 to 4x4."""
    return F.concat(F.slice(pose, 1, 12), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def apply_rigid(pose: Column, p: Column) -> Column:
    """A 4x4 transform of a 3-vector."""
    return V.let(pose, lambda m: V.let(p, lambda x: F.array(*[V.total([m.getItem(4 * i + j) * x.getItem(j) for j in range(3)]) + m.getItem(4 * i + 3) for i in range(3)])))


def apply_similarity(factor: Column, rotation: Column, t: Column, p: Column) -> Column:
    return V.add(V.scale(V.matvec(rotation, p), factor), t)


def flip_axes(pose: Column) -> Column:
    """Camera-to-world between the computer-vision and graphics conventions: y and z axes change sign."""
    return F.array(*[pose.getItem(i) * (-1.0 if i % 4 in (1, 2) else 1.0) for i in range(16)])


def closest_points(p1: Column, d1: Column, p2: Column, d2: Column) -> tuple[Column, Column]:
    """The closest point of each of two lines (unit directions); parallel lines give the minimum-norm parameters."""
    gap = V.sub(p2, p1)
    b, u, v = V.dot(d1, d2), V.dot(gap, d1), V.dot(gap, d2)
    det = 1 - b * b
    apart = det > 1e-12
    s = F.when(apart, (u - b * v) / F.when(apart, det).otherwise(1.0)).otherwise(u / 2)
    t = F.when(apart, (b * u - v) / F.when(apart, det).otherwise(1.0)).otherwise(-b * u / 2)
    return V.add(p1, V.scale(d1, s)), V.add(p2, V.scale(d2, t))


def look_at(forward: Column, up: Column, position: Column) -> Column:
    """3x4 camera-to-world with axes (right, up, forward) as columns."""
    def axes(z: Column, x: Column, y: Column) -> Column:
        return F.array(*[c.getItem(i) for i in range(3) for c in (x, y, z, position)])

    unit = lambda v, body: V.let(v, lambda w: V.let(V.normalize(w), body))  # noqa: E731  each vector is computed once
    return unit(forward, lambda z: unit(V.cross(up, z), lambda x: unit(V.cross(z, x), lambda y: axes(z, x, y))))


def average_pose(poses: DataFrame, pose: str) -> DataFrame:
    """(pose): 3x4 camera-to-world at the mean position, with the mean z axis and the mean y axis as up, of a column of 12 numbers or more."""
    means = poses.agg(*[F.avg(F.col(pose)[i]).alias(f"_{i}") for i in range(12)])
    axis = lambda k: F.array(*[F.col(f"_{4 * i + k}") for i in range(3)])
    return means.select(look_at(axis(2), axis(1), axis(3)).alias("pose"))


def principal_frame(poses: DataFrame, pose: str) -> DataFrame:
    """(transform): the 4x4 that turns the positions' principal axes to x, y and z, most spread first, and their mean to 0.

    It keeps the hand, and is turned about x where the mean y axis would point down. An axis' sign is eigen.symmetric3's.
    """
    t = [F.col(pose)[4 * i + 3] for i in range(3)]
    moments = {f"c{i}{j}": F.covar_pop(t[i], t[j]) for i in range(3) for j in range(i, 3)}
    means = {f"m{i}": F.avg(x) for i, x in enumerate(t)} | {f"y{i}": F.avg(F.col(pose)[4 * i + 1]) for i in range(3)}
    row = poses.agg(*[v.alias(k) for k, v in (moments | means).items()])
    row = row.select("*", eigen.symmetric3(F.array(*moments)).alias("e"))
    row = row.withColumn("r", F.flatten(F.array(*[F.col("e")[k]["vector"] for k in (2, 1, 0)])))
    hand = F.when(V.det3(F.col("r")) < 0, -1.0).otherwise(1.0)
    row = row.withColumn("r", F.array(*[F.col("r")[i] * (hand if i > 5 else F.lit(1.0)) for i in range(9)]))
    up = F.col("r")[6] * F.col("y0") + F.col("r")[7] * F.col("y1") + F.col("r")[8] * F.col("y2")
    row = row.withColumn("f", F.when(up < 0, -1.0).otherwise(1.0)).withColumn("r", F.array(*[F.col("r")[i] * (F.col("f") if i > 2 else F.lit(1.0)) for i in range(9)]))
    shift = [-V.total([F.col("r")[3 * i + j] * F.col(f"m{j}") for j in range(3)]) for i in range(3)]
    return row.select(F.array(*[x for i in range(3) for x in (*[F.col("r")[3 * i + j] for j in range(3)], shift[i])], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]).alias("transform"))


def blended(a: Column, b: Column, w: Column) -> Column:
    """World-to-view 3x4 of the camera between two (4x4 or 3x4 world-to-view each): the inverse of w times the first's and 1 - w times the
    second's camera-to-world. Its 3x3 part is a rotation only where both are alike."""
    def inverse(m: Column) -> Column:
        r = V.inverse3(F.array(*[m[4 * i + j] for i in range(3) for j in range(3)]))
        return V.let(r, lambda x: F.array(*[c for i in range(3) for c in (*[x[3 * i + j] for j in range(3)], -V.total([x[3 * i + j] * m[4 * j + 3] for j in range(3)]))]))

    mixed = V.let(inverse(a), lambda x: V.let(inverse(b), lambda y: F.array(*[x[i] * w + y[i] * (1 - w) for i in range(12)])))
    return V.let(mixed, inverse)
