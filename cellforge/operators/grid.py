"""Voxel grids as sparse tables (grid_id, x, y, z, value); EMPTY cells are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellforge.functions.cells import EMPTY, cell_index, in_bounds, index_cell
from cellforge.functions.vec import Vec

CELL = ["grid_id", "x", "y", "z"]
AT = Vec.cols("x", "y", "z")


def with_grid(df: DataFrame) -> DataFrame:
    """The table with a grid_id, 0 where it has none."""
    return df if "grid_id" in df.columns else df.withColumn("grid_id", F.lit(0).cast("long"))


def cube(radius: int, centre: bool = True) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [(x, y, z) for x in r for y in r for z in r if centre or (x, y, z) != (0, 0, 0)]


FACES6 = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
CUBE26 = cube(1, centre=False)
NEIGHBOURHOODS = {6: FACES6, 26: CUBE26}


def scatter(voxels: DataFrame, offsets: list[tuple], dims: tuple[int, int, int] | None = None, weights: list[float] | None = None) -> DataFrame:
    """Each cell's row at each place it can be seen from: `own` is true at its own place, `w` is the offset's weight and
    `far` its distance by the longest axis.

    A stencil is then one aggregation by place: its partial sums shrink the rows before the only shuffle, where a
    neighbour join would shuffle twice.
    """
    weights = weights or [1.0] * len(offsets)
    seen = F.array(*[F.struct(F.lit(x).alias("ox"), F.lit(y).alias("oy"), F.lit(z).alias("oz"), F.lit(float(w)).alias("w"), F.lit(max(map(abs, (x, y, z)))).alias("far")) for (x, y, z), w in zip(offsets, weights)])
    rest = [c for c in voxels.columns if c not in CELL]
    out = voxels.select(*CELL, *rest, F.explode(seen).alias("o")).select(
        "grid_id", (F.col("x") - F.col("o.ox")).alias("x"), (F.col("y") - F.col("o.oy")).alias("y"), (F.col("z") - F.col("o.oz")).alias("z"), *rest, F.col("o.w").alias("w"), F.col("o.far").alias("far"),
        (F.col("o.far") == 0).alias("own"),
    )
    return out.where(in_bounds(AT, dims)) if dims else out


def window_cells(radius: int, dims: tuple[int, int, int]) -> Column:
    """Cells of the cube about (x, y, z) that lie in the grid."""
    n = F.lit(1)
    for c, d in zip(AT, dims):
        n = n * (F.least(c + radius, F.lit(d - 1)) - F.greatest(c - radius, F.lit(0)) + 1)
    return n


def occupied(voxels: DataFrame) -> DataFrame:
    return voxels.where(F.col("value") != EMPTY)


def any_occupied(voxels: DataFrame) -> bool:
    """Whether some cell is not empty; stops at the first."""
    return not occupied(voxels).isEmpty()


def surface_flags(voxels: DataFrame, dims: tuple[int, int, int], radius: int = 1) -> DataFrame:
    """Occupied cells with `is_surface`: whether an empty cell lies in the clamped cube about them; an even radius grows by one."""
    radius += radius % 2 == 0
    seen = scatter(occupied(with_grid(voxels)).select(*CELL, "value"), cube(radius), dims)
    counted = seen.groupBy(*CELL).agg(F.count("*").alias("n"), F.max(F.when(F.col("own"), F.col("value"))).alias("value"))
    return counted.where("value is not null").select(*CELL, "value", (F.col("n") < window_cells(radius, dims)).alias("is_surface"))


def densify(voxels: DataFrame, dims: tuple[int, int, int], fill: int = EMPTY) -> DataFrame:
    """Every cell of every grid, `fill` where the table has none; one shuffle, as the cells are unioned, not joined."""
    voxels = with_grid(voxels)
    spark = voxels.sparkSession
    cells = spark.range(dims[0] * dims[1] * dims[2])
    x, y, z = index_cell(F.col("id"), dims)
    all_cells = voxels.select("grid_id").distinct().crossJoin(F.broadcast(cells) if dims[0] * dims[1] * dims[2] <= 1 << 18 else cells).select("grid_id", x.alias("x"), y.alias("y"), z.alias("z"), F.lit(None).cast("int").alias("value"))
    return voxels.select(*CELL, "value").union(all_cells).groupBy(*CELL).agg(F.coalesce(F.max("value"), F.lit(fill)).alias("value"))


def to_nested(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """One row per grid with its cells as x-major nested arrays; for grids that fit in a row."""
    flat = densify(voxels, dims).groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct(cell_index(AT, dims).alias("i"), "value"))).alias("c"))
    dx, dy, dz = dims
    row = lambda i, j: F.transform(F.slice(F.col("c"), (i * dy + j) * dz + 1, dz), lambda s: s["value"])
    return flat.select("grid_id", F.transform(F.sequence(F.lit(0), F.lit(dx - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(dy - 1)), lambda j: row(i, j))).alias("cells"))


def from_nested(grids: DataFrame) -> DataFrame:
    return (
        grids.select("grid_id", F.posexplode("cells").alias("x", "plane")).select("grid_id", "x", F.posexplode("plane").alias("y", "line"))
        .select("grid_id", "x", "y", F.posexplode("line").alias("z", "value")).where(F.col("value") != EMPTY)
    )


def insert_points(points: DataFrame, order: str, value: str) -> DataFrame:
    """Cell table from point rows that carry a cell: the last row of a cell by `order` gives its value."""
    return with_grid(points).groupBy(*CELL).agg(F.max(F.struct(order, value))[value].cast("int").alias("value"))


def parity_fill(voxels: DataFrame, dims: tuple[int, int, int], votes: int = 4) -> DataFrame:
    """Empty cells inside: for `votes` or more of the six axis directions an odd number of runs of occupied cells lies that way.

    Each axis is one window over its lines, so a task holds single lines of cells.
    """
    cells = densify(voxels, dims).withColumn("full", F.col("value") != EMPTY)
    tally = F.lit(0)
    for k in range(3):
        rest = [c for i, c in enumerate("xyz") if i != k]
        line = Window.partitionBy("grid_id", *rest).orderBy("xyz"[k])
        starts = F.when(F.col("full") & ~F.coalesce(F.lag("full").over(line), F.lit(False)), 1).otherwise(0)
        cells = cells.withColumn("start", starts)
        cells = cells.withColumn("before", F.sum("start").over(line.rowsBetween(Window.unboundedPreceding, -1)))
        cells = cells.withColumn("after", F.sum("start").over(line.rowsBetween(1, Window.unboundedFollowing)))
        cells = cells.withColumn(f"odd{k}", F.coalesce(F.col("before"), F.lit(0)) % 2 + F.coalesce(F.col("after"), F.lit(0)) % 2).drop("start", "before", "after")
        tally = tally + F.col(f"odd{k}")
    return cells.where(~F.col("full") & (tally >= votes)).select(*CELL)
