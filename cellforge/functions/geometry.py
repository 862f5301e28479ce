"""Triangles, planes, lines, boxes and curves as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import EPSILON, Vec, mix


def epsilon_equal(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return F.abs(a - b) < eps


# triangles


def triangle_cross(a: Vec, b: Vec, c: Vec) -> Vec:
    return (b - a).cross(c - a)


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return triangle_cross(a, b, c).length() / 2


def triangle_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    return triangle_cross(a, b, c).unit()


def triangle_centroid(a: Vec, b: Vec, c: Vec) -> Vec:
    return (a + b + c) / 3


def triangle_box(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Vec]:
    both = list(zip(a, b, c))
    return Vec(*(F.least(*x) for x in both)), Vec(*(F.greatest(*x) for x in both))


def triangle_side(a: Vec, b: Vec, c: Vec, p: Vec, eps: float = EPSILON) -> Column:
    """1 in front of the triangle's plane, -1 behind it, 0 on it."""
    d = (p - a).dot(triangle_normal(a, b, c)) / F.nullif((p - a).length(), F.lit(0.0))
    return F.when(F.coalesce(d, F.lit(0.0)) > eps, 1).when(d < -eps, -1).otherwise(0)


def longest_edge(a: Vec, b: Vec, c: Vec) -> Column:
    """Number of the vertex where the longest edge starts: 0 for ab, 1 for bc, 2 for ca; ties go to bc."""
    ab, bc, ca = (b - a).length2(), (c - b).length2(), (a - c).length2()
    return F.when((ca > ab) & (ca > bc), 2).when((ab > bc) & (ab > ca), 0).otherwise(1)


def dihedral_cosine(n: Vec, m: Vec) -> Column:
    return n.dot(m) / (n.length() * m.length())


def edge_angle(n: Vec, edge: Vec) -> Column:
    """Angle between an edge and the plane of normal n."""
    return F.asin(n.dot(edge) / (n.length() * edge.length()))


def point_in_triangle(a: Vec, b: Vec, c: Vec, u: Column, v: Column) -> Vec:
    """The point of two numbers from [0, 1): those beyond the diagonal are folded back."""
    over = u + v >= 1
    s, t = F.when(over, 1 - u).otherwise(u), F.when(over, 1 - v).otherwise(v)
    return a + (b - a) * s + (c - a) * t


# planes and lines


def plane_offset(point: Vec, normal: Vec) -> Column:
    return -normal.dot(point)


def plane_distance(normal: Vec, offset: Column, p: Vec) -> Column:
    """Signed distance of p; the normal has unit length."""
    return normal.dot(p) + offset


def bisector(a: Vec, b: Vec) -> tuple[Vec, Column]:
    """Plane half way between two points, its normal towards a."""
    n = (a - b).unit()
    return n, plane_offset((a + b) / 2, n)


def plane_of_points(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Column]:
    n = triangle_normal(a, b, c)
    return n, plane_offset(a, n)


def plane_point(a: Vec, u: Vec, v: Vec, s: Column, t: Column) -> Vec:
    return a + u * s + v * t


def coplanar(normal: Vec, offset: Column, p: Vec, eps: float = EPSILON) -> Column:
    return F.abs(plane_distance(normal, offset, p)) < eps


def perpendicular(u: Vec, v: Vec, eps: float = EPSILON) -> Column:
    return F.abs(u.dot(v)) < eps


def parallel(u: Vec, v: Vec, eps: float = EPSILON) -> Column:
    return u.cross(v).length2() < eps * eps


def point_line_foot(a: Vec, d: Vec, p: Vec) -> Vec:
    return a + d * ((p - a).dot(d) / d.length2())


def point_line_distance(a: Vec, d: Vec, p: Vec) -> Column:
    return (p - a).cross(d).length() / d.length()


def line_line_distance(a: Vec, u: Vec, b: Vec, v: Vec, eps: float = EPSILON) -> Column:
    """Distance of two lines; of parallel ones that of a point to the other."""
    n = u.cross(v)
    return F.when(n.length2() < eps * eps, point_line_distance(a, u, b)).otherwise(F.abs((b - a).dot(n)) / n.length())


def valid_parameter(t: Column, kind: str) -> Column:
    """Whether a parameter is on a segment, a ray or a line."""
    return {"segment": t.between(0, 1), "ray": t >= 0, "line": t.isNotNull()}[kind]


def box_transform(lo: Vec, hi: Vec, matrix: list[float]) -> tuple[Vec, Vec]:
    """Both corners under an affine map, put in order."""
    a, b = affine(lo, matrix), affine(hi, matrix)
    return a.zip(b, F.least), a.zip(b, F.greatest)


def box_parts(lo: Vec, hi: Vec, k: int) -> Column:
    """Array of the k^3 equal parts of a box, x slowest."""
    step = (hi - lo) / k
    at = lambda i, j, n: Vec(lo.x + step.x * i, lo.y + step.y * j, lo.z + step.z * n)
    return F.array(*[F.struct(at(i, j, n).struct().alias("lo"), at(i + 1, j + 1, n + 1).struct().alias("hi")) for i in range(k) for j in range(k) for n in range(k)])


# maps and curves


def affine(p: Vec, matrix: list[float], w: float = 1.0) -> Vec:
    """Row-major 3x4 matrix times (p, w); w = 0 leaves out the shift, as for normals."""
    rows = [matrix[4 * i : 4 * i + 4] for i in range(3)]
    return Vec(*(p.x * r[0] + p.y * r[1] + p.z * r[2] + r[3] * w for r in rows))


def rotation(axis: tuple[float, float, float], angle: float) -> list[float]:
    """3x4 matrix that turns about an axis of unit length."""
    x, y, z = axis
    c, s = math.cos(angle), math.sin(angle)
    t = 1 - c
    return [t * x * x + c, t * x * y - s * z, t * x * z + s * y, 0, t * x * y + s * z, t * y * y + c, t * y * z - s * x, 0, t * x * z - s * y, t * y * z + s * x, t * z * z + c, 0]


def tangent_axes(n: Vec) -> tuple[Vec, Vec]:
    """Two unit vectors that span the plane of a unit normal."""
    use_z = F.abs(n.z) < 0.999
    up = Vec(F.when(use_z, 0.0).otherwise(1.0), F.lit(0.0), F.when(use_z, 1.0).otherwise(0.0))
    u = up.cross(n).unit()
    return u, n.cross(u)


def catmull_rom(p0: Vec, p1: Vec, p2: Vec, p3: Vec, t: Column) -> Vec:
    a, b, c = (p1 * 3 - p0 - p2 * 3 + p3), (p0 * 2 - p1 * 5 + p2 * 4 - p3), p2 - p0
    return p1 + c * (t / 2) + b * (t * t / 2) + a * (t * t * t / 2)


def bezier(p0: Vec, p1: Vec, p2: Vec, p3: Vec, t: Column) -> Vec:
    s = 1 - t
    return p0 * (s * s * s) + p1 * (3 * s * s * t) + p2 * (3 * s * t * t) + p3 * (t * t * t)


def linear_path(p: Vec, q: Vec, t: Column) -> Vec:
    return mix(p, q, t)


# colours


def hue(n: Column) -> Column:
    """Hue in degrees of the n-th colour, by the golden ratio."""
    x = n * 0.618033988749895
    return (x - F.floor(x)) * 360


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Vec:
    """Red, green and blue in [0, 1]; hue in degrees."""

    def channel(k: int) -> Column:
        at = F.pmod(h / 60 + k, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(at, 4 - at, F.lit(1.0)))

    return Vec(channel(5), channel(3), channel(1))
