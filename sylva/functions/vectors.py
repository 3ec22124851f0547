"""Vector algebra, line distances and rounding as column expressions: all stay inside code generation."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    """Three columns."""

    x: Column
    y: Column
    z: Column

    def __add__(self, o: Vec) -> Vec:
        return Vec(*(a + b for a, b in zip(self, o, strict=True)))

    def __sub__(self, o: Vec) -> Vec:
        return Vec(*(a - b for a, b in zip(self, o, strict=True)))

    def scale(self, s: Column | float) -> Vec:
        return Vec(*(a * s for a in self))

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm2(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm2())

    def unit(self) -> Vec:
        """Null for the zero vector."""
        n = self.norm()
        return Vec(*(F.try_divide(a, n) for a in self))


def vec(prefix: str, table: str = "") -> Vec:
    """The columns prefix_x, prefix_y, prefix_z (x, y, z without a prefix), of a table alias."""
    t, p = f"{table}." if table else "", f"{prefix}_" if prefix else ""
    return Vec(*(F.col(f"{t}{p}{c}") for c in "xyz"))


def lit(x: float, y: float, z: float) -> Vec:
    return Vec(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))


def clamp(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def angle(a: Vec, b: Vec) -> Column:
    """Degrees between two unit vectors."""
    return F.degrees(F.acos(clamp(a.dot(b))))


def height_on_line(p: Vec, axis: Vec, point: Vec) -> Column:
    """Where p's foot lies along the line, from `point`."""
    return (p - point).dot(axis)


def distance_to_line(p: Vec, axis: Vec, point: Vec) -> Column:
    h = height_on_line(p, axis, point)
    return ((p - point) - axis.scale(h)).norm()


def distance_between_lines(p: Vec, u: Vec, q: Vec, v: Vec) -> tuple[Column, Column, Column]:
    """(distance, parameter on the first, on the second line) of lines p + s u and q + t v; parallel lines give null parameters."""
    n, w = u.cross(v), q - p
    size2 = n.norm2()
    distance = F.coalesce(F.try_divide(F.abs(w.dot(n)), F.sqrt(size2)), F.sqrt(F.greatest(F.lit(0.0), w.norm2() - F.pow(w.dot(u), 2))))
    return distance, F.try_divide(w.cross(v).dot(n), size2), F.try_divide(w.cross(u).dot(n), size2)


def rotate(p: Vec, axis: Vec, radians: Column) -> Vec:
    """p turned about a unit axis."""
    c, s = F.cos(radians), F.sin(radians)
    return p.scale(c) + axis.cross(p).scale(s) + axis.scale(axis.dot(p) * (1 - c))


def basis(axis: Vec) -> tuple[Vec, Vec]:
    """Two unit vectors that stand on a unit axis and on each other, the same ones for equal axes: the axis crossed with
    the coordinate direction that it holds least of."""
    ax, ay, az = (F.abs(c) for c in axis)
    x, y = (ax <= ay) & (ax <= az), (ay <= az)
    one = Vec(F.when(x, 1.0).otherwise(0.0), F.when(~x & y, 1.0).otherwise(0.0), F.when(~x & ~y, 1.0).otherwise(0.0))
    first = axis.cross(one).unit()
    return first, axis.cross(first)


def change_precision(v: Column) -> Column:
    """Fewer decimals for larger values: none from 1000, one from 100, ... five below 0.1."""
    steps = [(1e3, 0), (1e2, 1), (1e1, 2), (1.0, 3), (0.1, 4)]
    a = F.abs(v)
    return reduce(lambda rest, s: F.when(a >= s[0], F.round(v, s[1])).otherwise(rest), reversed(steps), F.round(v, 5))


def minutes_and_seconds(seconds: Column) -> tuple[Column, Column]:
    """Whole minutes, and the seconds left."""
    m = F.floor(seconds / 60)
    return m, seconds - 60 * m


def safe_std(c: Column) -> Column:
    """Sample deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))
