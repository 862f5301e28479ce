"""Cells of a voxel grid: places, indices, packing, Morton codes and reproducible noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import Vec

#: Values of a cell that belongs to no fragment; fragments count from 2.
EMPTY, FREE = 0, 1
#: Bit of the boundary flag and first bit of the sub-seed in a packed 16-bit cell.
BOUNDARY_BIT, SUB_SEED_BIT = 15, 8


def cell_of(p: Vec, lo: Vec, size: Vec, dims: tuple[int, int, int]) -> Vec:
    """Cell that holds a position, clamped to the grid."""
    return Vec(*(F.least(F.greatest(F.floor((a - b) / s), F.lit(0)), F.lit(d - 1)).cast("int") for a, b, s, d in zip(p, lo, size, dims)))


def cell_index(c: Vec, dims: tuple[int, int, int]) -> Column:
    """Linear index, x slowest."""
    return c.x.cast("long") * (dims[1] * dims[2]) + c.y * dims[2] + c.z


def index_cell(i: Column, dims: tuple[int, int, int]) -> Vec:
    plane = dims[1] * dims[2]
    return Vec(F.floor(i / plane).cast("int"), F.floor(i % plane / dims[2]).cast("int"), (i % dims[2]).cast("int"))


def cell_box(c: Vec, lo: Vec, size: Vec) -> tuple[Vec, Vec]:
    at = Vec(*(b + a * s for a, b, s in zip(c, lo, size)))
    return at, at + size


def in_bounds(c: Vec, dims: tuple[int, int, int]) -> Column:
    x, y, z = (a.between(0, d - 1) for a, d in zip(c, dims))
    return x & y & z


def grid_size(extent: Vec, per_unit: float, most: int) -> Vec:
    """Cells of a model: ceiling of extent times resolution, scaled down where an axis exceeds `most`; x and z to fours."""
    raw = extent.map(lambda e: F.ceil(e * per_unit))
    longest = F.greatest(*extent)
    scaled = extent.map(lambda e: F.floor(e * most / longest))
    over = F.greatest(*raw) > most
    v = raw.zip(scaled, lambda a, b: F.when(over, b).otherwise(a))
    four = lambda c: (F.ceil(c / 4) * 4).cast("int")
    return Vec(four(v.x), v.y.cast("int"), four(v.z))


def grid_size_interactive(extent: Vec, most: int) -> Vec:
    """Cells by aspect with the longest axis at `most`, every axis to fours and no more than `most`."""
    longest = F.greatest(*extent)
    return extent.map(lambda e: F.least(F.ceil(F.floor(e * most / longest) / 4) * 4, F.lit(most // 4 * 4)).cast("int"))


def homogenize(value: Column) -> Column:
    return F.when(value != EMPTY, FREE).otherwise(EMPTY)


def reset_filling(value: Column) -> Column:
    """Values above the first fragment become the first fragment."""
    return F.least(value, F.lit(FREE + 1))


def pack(fragment: Column, sub_seed: Column, boundary: Column) -> Column:
    """16-bit cell word; fragment below 256, sub-seed below 128."""
    return fragment.bitwiseOR(F.shiftleft(sub_seed, SUB_SEED_BIT)).bitwiseOR(F.when(boundary, 1 << BOUNDARY_BIT).otherwise(0))


def unpack(word: Column) -> Column:
    return F.struct(
        word.bitwiseAND(0xFF).alias("fragment"),
        F.shiftright(word, SUB_SEED_BIT).bitwiseAND(0x7F).alias("sub_seed"),
        (F.shiftright(word, BOUNDARY_BIT) > 0).alias("is_boundary"),
    )


def without_boundary(word: Column) -> Column:
    return word.bitwiseAND(0x7FFF)


def without_sub_seed(word: Column) -> Column:
    return word.bitwiseAND(0xFF)


def spread_bits(v: Column) -> Column:
    """The ten low bits of v, two zero bits after each."""
    v = v.cast("long").bitwiseAND(0x3FF)
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(mask)
    return v


def morton(c: Vec) -> Column:
    """30-bit Morton code of a cell, x in the highest bit of each three."""
    return spread_bits(c.x) * 4 + spread_bits(c.y) * 2 + spread_bits(c.z)


def morton_unit(p: Vec) -> Column:
    """Morton code of a point of the unit cube in 1024 steps an axis."""
    return morton(p.map(lambda a: F.least(F.greatest(F.floor(a * 1024), F.lit(0)), F.lit(1023))))


def noise(c: Vec, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the cell and the seed alone: two rounds of a multiplicative congruence."""
    mixed = F.pmod(c.x.cast("long") * 73856093 + c.y.cast("long") * 19349663 + c.z.cast("long") * 83492791 + seed * 15485863, F.lit(2147483647))
    for _ in range(2):
        mixed = F.pmod(mixed * 48271 + 11, F.lit(2147483647))
    return mixed / 2147483647


def noise_sql(x: str, y: str, z: str, seed: int = 0) -> str:
    """noise() in SQL, for oracles."""
    q = f"(({x})::BIGINT * 73856093 + ({y})::BIGINT * 19349663 + ({z})::BIGINT * 83492791 + {seed * 15485863}) % 2147483647"
    for _ in range(2):
        q = f"(({q}) * 48271 + 11) % 2147483647"
    return f"(({q}) / 2147483647.0)"


def halton(index: Column, base: int, digits: int = 32) -> Column:
    """Radical inverse of a number from 0 on in a base."""
    steps = F.sequence(F.lit(1), F.lit(digits))
    start = F.struct(index.cast("long").alias("i"), F.lit(1.0).alias("f"), F.lit(0.0).alias("r"))
    step = lambda s, _: F.struct(F.floor(s["i"] / base).alias("i"), (s["f"] / base).alias("f"), (s["r"] + s["f"] / base * (s["i"] % base)).alias("r"))
    return F.aggregate(steps, start, step, lambda s: s["r"])


def reversed_digits(c: Column, base: int, digits: int) -> Column:
    """A whole number with its first `digits` digits in a base in reverse order."""
    c = c.cast("long")
    return sum((F.floor(c / base**k) % base * base ** (digits - 1 - k) for k in range(digits)), F.lit(0).cast("long"))


def halton_indices(cx: Column, cy: Column, digits2: int, digits3: int, k: int) -> Column:
    """The first k indices of the two-dimensional Halton sequence (bases 2 and 3) whose points lie in a cell of a grid of 2^digits2
    by 3^digits3 cells of the unit square.

    The cell's column fixes the index modulo 2^digits2, as it is that many digits of the index in reverse, and its row modulo
    3^digits3; both together fix it modulo their product (Chinese remainders), and further points come at that distance.
    """
    m, n = 2**digits2, 3**digits3
    first = F.pmod(reversed_digits(cx, 2, digits2) * (n * pow(n, -1, m)) + reversed_digits(cy, 3, digits3) * (m * pow(m, -1, n)), F.lit(m * n))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: first + j * (m * n))
