"""Run-length and column encodings of voxel grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import AT, CELL, densify, with_grid
from cellforge.functions.cells import cell_index


def run_lengths(voxels: DataFrame, dims: tuple[int, int, int], fill: int = 0) -> DataFrame:
    """(grid_id, start, value, length): runs of equal values in linear order over all cells of each grid.

    Empty stretches are not made into cells: runs are found among the stored cells by where the next index or the value
    breaks, first in slabs of one x, then across slabs, so that no task holds a whole grid; gaps become runs of `fill`.
    """
    cells = with_grid(voxels).where(F.col("value") != fill).select("grid_id", "x", cell_index(AT, dims).alias("i"), "value")
    slab = Window.partitionBy("grid_id", "x").orderBy("i")
    broken = (F.lag("value").over(slab) != F.col("value")) | (F.lag("i").over(slab) != F.col("i") - 1)
    marked = cells.withColumn("run", F.sum(F.when(F.coalesce(broken, F.lit(True)), 1).otherwise(0)).over(slab))
    parts = marked.groupBy("grid_id", "x", "run").agg(F.min("i").alias("start"), F.count("*").alias("length"), F.first("value").alias("value"))
    # stitch runs that go on in the next slab: only runs, no longer cells, meet here
    grid = Window.partitionBy("grid_id").orderBy("start")
    joined = (F.lag("value").over(grid) == F.col("value")) & (F.lag(F.col("start") + F.col("length")).over(grid) == F.col("start"))
    runs = (
        parts.withColumn("r", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(grid))
        .groupBy("grid_id", "r").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.first("value").alias("value"))
    )
    total = dims[0] * dims[1] * dims[2]
    end = F.col("start") + F.col("length")
    gaps = runs.select("grid_id", end.alias("start"), (F.coalesce(F.lead("start").over(grid), F.lit(total)) - end).alias("length"), F.lit(fill).alias("value"))
    head = runs.groupBy("grid_id").agg(F.min("start").alias("length")).select("grid_id", F.lit(0).cast("long").alias("start"), "length", F.lit(fill).alias("value"))
    return runs.select("grid_id", "start", "length", "value").unionByName(gaps).unionByName(head).where("length > 0").select("grid_id", "start", "value", "length")


def expand_runs(runs: DataFrame, dims: tuple[int, int, int], empty: int = 0) -> DataFrame:
    """Cells of run lengths, `empty` ones left out."""
    from cellforge.functions.cells import index_cell

    x, y, z = index_cell(F.col("i"), dims)
    return runs.where(F.col("value") != empty).select("grid_id", "value", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("i")).select("grid_id", x.alias("x"), y.alias("y"), z.alias("z"), "value")


def column_runs(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(grid_id, x, y, runs): each column of cells as an array of (value, length), bottom to top, empty cells included."""
    line = Window.partitionBy("grid_id", "x", "y").orderBy("z")
    dense = densify(voxels, dims)
    changed = F.coalesce(F.lag("value").over(line) != F.col("value"), F.lit(True))
    marked = dense.withColumn("run", F.sum(F.when(changed, 1).otherwise(0)).over(line))
    parts = marked.groupBy("grid_id", "x", "y", "run").agg(F.first("value").alias("value"), F.count("*").cast("int").alias("length"))
    return parts.groupBy("grid_id", "x", "y").agg(F.array_sort(F.collect_list(F.struct("run", "value", "length"))).alias("a")).select("grid_id", "x", "y", F.transform("a", lambda s: F.struct(s["value"].alias("value"), s["length"].alias("length"))).alias("runs"))


def quad_columns(columns: DataFrame, levels: int) -> DataFrame:
    """Square blocks of columns with one sequence of values: (grid_id, level, qx, qy, values), each column in its largest block.

    A block of level l spans 2^l columns an axis. Lengths are not compared, as columns of one value sequence are merged.
    """
    seq = columns.select("grid_id", "x", "y", F.concat_ws(",", F.transform("runs", lambda s: s["value"].cast("string"))).alias("seq"))
    each = seq.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    q = [F.expr(f"shiftright({c}, level)").alias(f"q{c}") for c in "xy"]
    blocks = (
        each.groupBy("grid_id", "level", *q)
        .agg(F.min("seq").alias("values"), F.max("seq").alias("last"), F.count("*").alias("n"))
        .where((F.col("values") == F.col("last")) & (F.col("n") == F.expr("shiftleft(1L, 2 * level)")))
        .select("grid_id", "level", "qx", "qy", "values")
    )
    parent = blocks.select("grid_id", (F.col("level") - 1).alias("level"), F.col("qx").alias("px"), F.col("qy").alias("py"))
    return blocks.withColumn("px", F.expr("shiftright(qx, 1)")).withColumn("py", F.expr("shiftright(qy, 1)")).join(parent, ["grid_id", "level", "px", "py"], "left_anti").select("grid_id", "level", "qx", "qy", "values")


def compression_ratio(columns: DataFrame, dims: tuple[int, int, int], cell_bytes: int = 2, run_bytes: int = 4) -> DataFrame:
    """Bytes of the plain and the run-length form of each grid, and their ratio."""
    plain = dims[0] * dims[1] * dims[2] * cell_bytes
    return columns.groupBy("grid_id").agg(F.sum(F.size("runs")).alias("runs")).select("grid_id", F.lit(plain).alias("plain_bytes"), (F.col("runs") * run_bytes).alias("run_bytes"), (F.lit(float(plain)) / (F.col("runs") * run_bytes)).alias("ratio"))


def to_cube(voxels: DataFrame, dims: tuple[int, int, int], pad: str = "center") -> DataFrame:
    """The cells of a grid in the cube of its longest side: centred, or at the start with the padding at the end."""
    side = max(dims)
    shift = [(side - d) // 2 if pad == "center" else 0 for d in dims]
    return with_grid(voxels).select("grid_id", *[(F.col(c) + s).alias(c) for c, s in zip("xyz", shift)], "value")


def vox_records(voxels: DataFrame, squared: bool = False) -> DataFrame:
    """Rows of the vox format: axes x, z, y; fragments count from 1 unless all cells are written."""
    cells = with_grid(voxels)
    if not squared:
        cells = cells.where("value > 1").withColumn("value", F.col("value") - 1)
    return cells.select("grid_id", "x", F.col("z").alias("y"), F.col("y").alias("z"), F.col("value").alias("color"))
