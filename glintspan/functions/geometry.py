"""Vector geometry as column expressions: nothing here leaves whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def dot(a: Vector, b: Vector) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def minus(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def angle_degrees(a: Vector, b: Vector) -> Column:
    """Angle between two vectors; null if one is zero. The cosine is clipped, so that equal vectors are at 0."""
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def to_spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Radius, inclination and azimuth (radians)."""
    r = norm([x, y, z])
    return r, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(z, r)))), F.atan2(y, x)


def from_spherical(r: Column, inclination: Column, azimuth: Column) -> tuple[Column, Column, Column]:
    return r * F.sin(inclination) * F.cos(azimuth), r * F.sin(inclination) * F.sin(azimuth), r * F.cos(inclination)


def rotate_about(x: Column, z: Column, centre_x: Column, centre_z: Column, degrees: Column) -> tuple[Column, Column]:
    """A point of the ground plane turned about a centre."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    dx, dz = x - centre_x, z - centre_z
    return centre_x + c * dx - s * dz, centre_z + s * dx + c * dz


def project_to_plane(point: Vector, origin: Vector, normal: Vector) -> list[Column]:
    """The point's foot on the plane through `origin`; null for a zero normal."""
    share = F.try_divide(dot(minus(point, origin), normal), dot(normal, normal))
    return [p - share * n for p, n in zip(point, normal, strict=True)]


def ray_sphere(start: Vector, toward: Vector, centre: Vector, radius: Column) -> Column:
    """How far along start -> toward (1 = toward) the line first meets the sphere; null if it doesn't."""
    d, m = minus(toward, start), minus(start, centre)
    a, b, c = dot(d, d), 2 * dot(d, m), dot(m, m) - radius * radius
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    near, far = F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a)
    return F.when(disc < 0, None).when(near >= 0, near).when(far >= 0, far)


def radius_by_distance(far: Column, inner: float = 0.08, outer: float = 0.10, full: float = 2.0) -> Column:
    """Collision radius that grows from `inner` at 1 m to `outer` at `full` m."""
    return F.when(far <= 1, inner).when(far >= full, outer).otherwise(inner + (outer - inner) * (far - 1) / full)


def gaussian_score(far: Column, width: float, height: float = 1.0, centre: float = 0.0) -> Column:
    return height * F.exp(-((far - centre) ** 2) / (2 * width * width))


def hex_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial coordinates of the pointy-top hexagon of the given side that holds a point: cube rounding.

    The third distance adds q and r one by one, as the SQL twin does: a point on a border lies in the hexagon that the last bit tells.
    """
    q, r = (F.sqrt(F.lit(3.0)) / 3 * x - y / 3) / size, (2.0 / 3 * y) / size
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(-q - r + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    return (
        F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"),
        F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr).cast("long"),
    )


def hex_neighbours(q: Column, r: Column) -> Column:
    """The six neighbours of a cell, as an array of (q, r)."""
    return F.array(*[F.struct((q + dq).alias("q"), (r + dr).alias("r")) for dq, dr in ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))])
