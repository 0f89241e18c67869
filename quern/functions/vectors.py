"""Array and geometry expressions: distances, determinants, dihedrals, radial bases, grid statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def signed_volume(a: Column, b: Column, c: Column) -> Column:
    """Determinant of three vectors."""
    return dot(a, cross(b, c))


def dihedral(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """Angle between the planes of four points, in radians; 0 where points coincide or lie in line."""
    b0, b1, b2 = minus(p1, p0), minus(p2, p1), minus(p3, p2)
    n1, n2 = cross(b0, b1), cross(b1, b2)
    length = F.sqrt(dot(b1, b1))
    y, x = dot(b0, n2) * length, dot(n1, n2)
    return F.when((dot(n1, n1) == 0) | (dot(n2, n2) == 0), F.lit(0.0)).otherwise(F.atan2(y, x))


def radial_basis(d: Column, start: float, stop: float, n: int) -> Column:
    """exp(-(d - centre)^2 / (2 step^2)) for n centres evenly spaced over [start, stop]."""
    step = (stop - start) / (n - 1)
    centres = F.array(*[F.lit(start + i * step) for i in range(n)])
    return F.transform(centres, lambda c: F.exp(F.lit(-0.5 / step**2) * (d - c) * (d - c)))


def sign_product(c: Column) -> Column:
    return F.aggregate(c, F.lit(1.0), lambda a, x: a * F.signum(x))


def blend(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    """Weighted sum; null counts as 0."""
    return wa * F.coalesce(a, F.lit(0.0)) + wb * F.coalesce(b, F.lit(0.0))


def plane_normal(a: Column, b: Column, c: Column) -> Column:
    """Unit normal of the plane of three points; z where they lie in line."""
    n = cross(minus(b, a), minus(c, a))
    size = F.sqrt(dot(n, n))
    return F.when(size < 1e-10, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(F.transform(n, lambda x: x / size))


def determinant_stats(d: Column) -> Column:
    """Struct mean, largest by absolute value (the first of equals), and sum of absolute values of signed volumes; 0 of none."""
    far = F.aggregate(d, F.lit(0.0), lambda a, x: F.when(F.abs(x) > F.abs(a), x).otherwise(a))
    mean = F.when(F.size(d) > 0, total(d) / F.size(d)).otherwise(F.lit(0.0))
    return F.struct(mean.alias("mean"), far.alias("largest"), total(F.transform(d, F.abs)).alias("abs_sum"))
