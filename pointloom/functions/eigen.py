"""Eigenvalues and vectors of symmetric 3 x 3 matrices as column expressions: Jacobi rotations, folded in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions import vectors as V

#: Sweeps of three rotations; rotations converge quadratically, so matrices of doubles are diagonal after six or so.
SWEEPS = 10
#: (p, q, the third axis, names of the off-diagonal numbers pq, pr, qr) of each rotation.
_PLANES = ((0, 1, 2, "o01", "o02", "o12"), (0, 2, 1, "o02", "o01", "o12"), (1, 2, 0, "o12", "o01", "o02"))


def _rotated(a: Column, p: int, q: int, r: int, pq: str, pr: str, qr: str) -> Column:
    """One rotation that makes the off-diagonal number pq vanish."""

    def by(turn: Column) -> Column:
        t, c, s = turn["t"], turn["c"], turn["s"]
        fields = {f"d{p}": a[f"d{p}"] - t * a[pq], f"d{q}": a[f"d{q}"] + t * a[pq], f"d{r}": a[f"d{r}"], pq: F.lit(0.0), pr: c * a[pr] - s * a[qr], qr: s * a[pr] + c * a[qr]}
        v = [a["v"][i] for i in range(9)]
        for k in range(3):
            v[3 * k + p], v[3 * k + q] = c * v[3 * k + p] - s * v[3 * k + q], s * v[3 * k + p] + c * v[3 * k + q]
        return F.struct(*[fields[n].alias(n) for n in ("d0", "d1", "d2", "o01", "o02", "o12")], F.array(*v).alias("v"))

    theta = (a[f"d{q}"] - a[f"d{p}"]) / (2 * F.nullif(a[pq], F.lit(0.0)))
    t = F.coalesce(F.when(theta >= 0, 1 / (theta + F.sqrt(theta * theta + 1))).otherwise(-1 / (-theta + F.sqrt(theta * theta + 1))), F.lit(0.0))
    c = V.let(t, lambda x: F.struct(x.alias("t"), (1 / F.sqrt(x * x + 1)).alias("c")))
    return V.let(V.let(c, lambda x: F.struct(x["t"].alias("t"), x["c"].alias("c"), (x["t"] * x["c"]).alias("s"))), by)


def symmetric3(m: Column) -> Column:
    """array<struct<value, vector>> by value, least first, of a matrix given as (m00, m01, m02, m11, m12, m22); null for a null matrix.

    Vectors have length 1 and their number of largest size positive, the first on ties.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    start = F.struct(*[m[i].cast("double").alias(n) for n, i in (("d0", 0), ("d1", 3), ("d2", 5), ("o01", 1), ("o02", 2), ("o12", 4))], F.array(one, zero, zero, zero, one, zero, zero, zero, one).alias("v"))

    def step(a: Column, i: Column) -> Column:
        out = _rotated(a, *_PLANES[2])
        for k in (1, 0):
            out = F.when(i % 3 == k, _rotated(a, *_PLANES[k])).otherwise(out)
        return out

    def directed(v: Column) -> Column:
        most = F.greatest(*[F.abs(v[i]) for i in range(3)])
        lead = F.coalesce(*[F.when(F.abs(v[i]) == most, v[i]) for i in range(3)])
        return V.scale(v, F.when(lead < 0, -1.0).otherwise(1.0))

    def listed(a: Column) -> Column:
        return F.array_sort(F.array(*[F.struct(a[f"d{i}"].alias("value"), directed(F.array(a["v"][i], a["v"][3 + i], a["v"][6 + i])).alias("vector")) for i in range(3)]))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(3 * SWEEPS - 1)), start, step, listed)
    return F.when(m.isNotNull(), found)
