"""Points, rigid transforms and wave phases as column arithmetic.

A point is a tuple of three columns, so that expressions stay inside generated
code; ``point`` and ``pack`` convert from and to arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions.hashing import col

# Weights of the virtual CB atom and the floor of a vector norm.
CB_FROM_CA_C = 0.58273431
CB_FROM_N_CA = 0.56802827
CB_FROM_CROSS = 0.54067466
NORM_FLOOR = 1e-8

Point = tuple[Column, Column, Column]


def point(array, start: int = 0) -> Point:
    """Three consecutive array items as a point."""
    a = col(array)
    return tuple(a[start + i].cast("double") for i in range(3))


def pack(p: Point) -> Column:
    return F.array(*p)


def subtract(a: Point, b: Point) -> Point:
    return tuple(x - y for x, y in zip(a, b))


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Point, b: Point) -> Point:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Point) -> Point:
    length = F.greatest(norm(a), F.lit(NORM_FLOOR))
    return tuple(x / length for x in a)


def virtual_cb(n: Point, ca: Point, c: Point) -> Point:
    """The CB position that an ideal backbone implies."""
    into, out = subtract(ca, n), subtract(c, ca)
    normal = cross(into, out)
    return tuple(
        ca[i] + CB_FROM_N_CA * into[i] - CB_FROM_CA_C * out[i] - CB_FROM_CROSS * normal[i]
        for i in range(3)
    )


def cb_direction(n: Point, ca: Point, c: Point) -> Point:
    """Unit vector from CA to the virtual CB."""
    return unit(subtract(virtual_cb(n, ca, c), ca))


def apply_transform(matrix, p: Point) -> Point:
    """``R x + t`` for a homogeneous 4x4 matrix held as 16 row-major numbers."""
    m = col(matrix)
    return tuple(
        m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3)
    )


def transform_atoms(matrix, atoms) -> Column:
    """A transform applied to every atom of an array of points."""
    return F.transform(col(atoms), lambda p: pack(apply_transform(matrix, point(p))))


def zero_nan(atoms) -> Column:
    """Replace NaN by 0 in an array of points."""
    return F.transform(col(atoms), lambda p: F.transform(p, lambda x: F.nanvl(x, F.lit(0).cast("float"))))


IDENTITY = [float(i % 5 == 0) for i in range(16)]


def identity() -> Column:
    return F.array(*[F.lit(x) for x in IDENTITY])


def compose(a: Column, b: Column) -> Column:
    """The matrix product of two row-major 4x4 matrices."""
    return F.array(
        *[
            a[4 * i] * b[j] + a[4 * i + 1] * b[4 + j] + a[4 * i + 2] * b[8 + j] + a[4 * i + 3] * b[12 + j]
            for i in range(4)
            for j in range(4)
        ]
    )


def wavenumbers(n: int, min_wl: float = 3.0, max_wl: float = 25.0, base: float = 20.0) -> list[float]:
    """``2 pi / wavelength`` for ``n`` wavelengths spaced along powers of ``base``."""
    steps = [base ** (i / (n - 1)) if n > 1 else 1.0 for i in range(n)]
    spans = [min_wl + (max_wl - min_wl) * (s - 1) / (base - 1) for s in steps]
    return [2 * math.pi / s for s in spans]


def squash(x, bound: float = 10.0) -> Column:
    """Smoothly bound a value to (-bound, bound)."""
    return F.tanh(col(x) / bound) * bound
