"""Real spherical harmonics up to degree 3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions import vectors as V

# The basis' constants.
C0 = 0.28209479177387814
C1 = 0.4886025119029199
C2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
C3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)
# Weights of the bands of degree 1, 2 and 3.
BAND_WEIGHTS = {"equal": (1.0, 1.0, 1.0), "sobolev": (2.0, 6.0, 12.0), "aggressive": (0.0, 1.0, 4.0)}
BANDS = ((0, 3), (3, 8), (8, 15))


#: Each basis function as its constant and a polynomial: (factor, exponents of x, y and z) of every term. The functions of degree d
#: are those from d * d on.
TERMS = (
    (C0, ((1, 0, 0, 0),)),
    (C1, ((-1, 0, 1, 0),)), (C1, ((1, 0, 0, 1),)), (C1, ((-1, 1, 0, 0),)),
    (C2[0], ((1, 1, 1, 0),)), (C2[1], ((1, 0, 1, 1),)), (C2[2], ((2, 0, 0, 2), (-1, 2, 0, 0), (-1, 0, 2, 0))), (C2[3], ((1, 1, 0, 1),)), (C2[4], ((1, 2, 0, 0), (-1, 0, 2, 0))),
    (C3[0], ((3, 2, 1, 0), (-1, 0, 3, 0))), (C3[1], ((1, 1, 1, 1),)), (C3[2], ((4, 0, 1, 2), (-1, 2, 1, 0), (-1, 0, 3, 0))), (C3[3], ((2, 0, 0, 3), (-3, 2, 0, 1), (-3, 0, 2, 1))),
    (C3[4], ((4, 1, 0, 2), (-1, 3, 0, 0), (-1, 1, 2, 0))), (C3[5], ((1, 2, 0, 1), (-1, 0, 2, 1))), (C3[6], ((1, 3, 0, 0), (-3, 1, 2, 0))),
)


def basis(direction: Column, degree: int) -> list[Column]:
    """The (degree + 1)**2 basis values of a unit direction."""
    axes = V.items(direction, 3)

    def term(constant: float, factor: int, *exponents: int) -> Column:
        out = F.lit(constant * factor)
        for axis, times in zip(axes, exponents, strict=True):
            for _ in range(times):
                out = out * axis
        return out

    return [V.total([term(constant, *t) for t in terms]) for constant, terms in TERMS[: (degree + 1) ** 2]]


def colour(coefficients: Column, direction: Column, degree: int) -> Column:
    """One channel's colour: the expansion plus a half, not below 0."""
    return F.greatest(V.total([b * coefficients.getItem(i) for i, b in enumerate(basis(direction, degree))]) + 0.5, F.lit(0.0))


def from_colour(c: Column) -> Column:
    return (c - 0.5) / C0


def to_colour(sh: Column) -> Column:
    return sh * C0 + 0.5


def energy(rest: Column, weighting: str, channels: int = 3) -> Column:
    """Weighted length of the coefficients above degree 0, an array of 15 numbers for each channel, coefficient by coefficient; at least 1e-4."""
    if weighting not in BAND_WEIGHTS:
        raise ValueError(f"unknown weighting {weighting!r}: one of {', '.join(BAND_WEIGHTS)}")
    parts = [w * V.total([rest.getItem(i).cast("double") * rest.getItem(i).cast("double") for i in range(channels * a, channels * b)]) for (a, b), w in zip(BANDS, BAND_WEIGHTS[weighting], strict=True)]
    return F.sqrt(F.greatest(V.total(parts), F.lit(1e-8)))
