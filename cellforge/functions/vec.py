"""Three-component vectors of columns: every operation is plain column arithmetic, so it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


class Vec:
    """x, y and z, each a column, or a column's name that is looked up when it is used."""

    __slots__ = ("_parts",)

    def __init__(self, x: Column | str, y: Column | str, z: Column | str):
        self._parts = (x, y, z)

    def _part(self, k: int) -> Column:
        c = self._parts[k]
        return F.col(c) if isinstance(c, str) else c

    @property
    def x(self) -> Column:
        return self._part(0)

    @property
    def y(self) -> Column:
        return self._part(1)

    @property
    def z(self) -> Column:
        return self._part(2)

    @staticmethod
    def of(x, y, z) -> "Vec":
        return Vec(_col(x), _col(y), _col(z))

    @staticmethod
    def cols(*names: str) -> "Vec":
        return Vec(*names)

    @staticmethod
    def field(struct: str | Column) -> "Vec":
        s = F.col(struct) if isinstance(struct, str) else struct
        return Vec(s["x"], s["y"], s["z"])

    def __iter__(self):
        return iter((self.x, self.y, self.z))

    def zip(self, other: "Vec", f) -> "Vec":
        return Vec(*(f(a, b) for a, b in zip(self, other)))

    def map(self, f) -> "Vec":
        return Vec(*(f(a) for a in self))

    def __add__(self, o: "Vec") -> "Vec":
        return self.zip(o, lambda a, b: a + b)

    def __sub__(self, o: "Vec") -> "Vec":
        return self.zip(o, lambda a, b: a - b)

    def __mul__(self, k) -> "Vec":
        return self.map(lambda a: a * k)

    def __truediv__(self, k) -> "Vec":
        return self.map(lambda a: a / k)

    def dot(self, o: "Vec") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "Vec") -> "Vec":
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def length2(self) -> Column:
        return self.dot(self)

    def length(self) -> Column:
        return F.sqrt(self.length2())

    def unit(self) -> "Vec":
        """The direction; nulls for the zero vector."""
        n = self.length()
        return self.map(lambda a: F.when(n > 0, a / n))

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def named(self, prefix: str) -> list[Column]:
        return [c.alias(f"{prefix}{n}") for c, n in zip(self, "xyz")]


def mix(a: Vec, b: Vec, t) -> Vec:
    return a + (b - a) * _col(t)


def lerp(a, b, t) -> Column:
    return _col(a) + (_col(b) - _col(a)) * _col(t)


# distances between cells or points


def euclid(a: Vec, b: Vec) -> Column:
    return (a - b).length()


def euclid2(a: Vec, b: Vec) -> Column:
    """Squared distance; exact for integer cells and ordered like the distance."""
    return (a - b).length2()


def manhattan(a: Vec, b: Vec) -> Column:
    d = (a - b).map(F.abs)
    return d.x + d.y + d.z


def chebyshev(a: Vec, b: Vec) -> Column:
    return F.greatest(*(a - b).map(F.abs))


#: Metrics by name; the values order cells like the metric does.
METRICS = {"euclidean": euclid2, "manhattan": manhattan, "chebyshev": chebyshev}
