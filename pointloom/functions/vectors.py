"""Small dense vectors and row-major matrices as arrays of doubles, in plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: expressions that use a large one many times would grow without it."""
    return F.transform(F.array(value), body)[0]


def vec(*xs) -> Column:
    return F.array(*[x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in xs])


def items(v: Column, n: int) -> list[Column]:
    return [v.getItem(i) for i in range(n)]


def total(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


def dot(a: Column, b: Column, n: int = 3) -> Column:
    return total([a.getItem(i) * b.getItem(i) for i in range(n)])


def dot_any(a: Column, b: Column) -> Column:
    """Of arrays of any, equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, n: int = 3) -> Column:
    return F.sqrt(dot(a, a, n))


def norm_any(a: Column) -> Column:
    return F.sqrt(dot_any(a, a))


def distance_any(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance_any(a, b))


def squared_distance_any(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column, n: int = 3) -> Column:
    return F.array(*[a.getItem(i) + b.getItem(i) for i in range(n)])


def sub(a: Column, b: Column, n: int = 3) -> Column:
    return F.array(*[a.getItem(i) - b.getItem(i) for i in range(n)])


def scale(a: Column, s, n: int = 3) -> Column:
    return F.array(*[a.getItem(i) * s for i in range(n)])


def normalize(a: Column, n: int = 3, least: float = 1e-12) -> Column:
    return scale(a, F.lit(1.0) / F.greatest(norm(a, n), F.lit(least)), n)


def cross(a: Column, b: Column) -> Column:
    x, y = items(a, 3), items(b, 3)
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


def matvec(m: Column, v: Column, rows: int = 3, cols: int = 3) -> Column:
    return F.array(*[total([m.getItem(cols * i + j) * v.getItem(j) for j in range(cols)]) for i in range(rows)])


def matmul(a: Column, b: Column, n: int = 3, k: int = 3, m: int = 3) -> Column:
    return F.array(*[total([a.getItem(k * i + x) * b.getItem(m * x + j) for x in range(k)]) for i in range(n) for j in range(m)])


def transpose(a: Column, rows: int = 3, cols: int = 3) -> Column:
    return F.array(*[a.getItem(cols * i + j) for j in range(cols) for i in range(rows)])


def det3(a: Column) -> Column:
    m = items(a, 9)
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse3(a: Column) -> Column:
    """Null where the determinant is 0."""
    m = items(a, 9)
    adjugate = [
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    ]
    d = det3(a)
    return F.when(d != 0, F.array(*[x / F.nullif(d, F.lit(0.0)) for x in adjugate]))


def angle_degrees(a: Column, b: Column) -> Column:
    """Between vectors of any length; null where one has no length, NaN where rounding leaves [-1, 1]."""
    lengths = norm_any(a) * norm_any(b)
    return F.degrees(F.acos(dot_any(a, b) / F.nullif(lengths, F.lit(0.0))))


def greater(a: Column, b) -> Column:
    """a > b, false for NaN as in IEEE comparison (Spark orders NaN above all)."""
    return ~F.isnan(a) & (a > b)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(x: Column) -> Column:
    return F.log(x / (1 - x))


def safe_divide(a: Column, b: Column, other=None) -> Column:
    return F.when(b != 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(other))
