"""Aggregates of fragments, meshes and values, and the metadata tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellforge.functions.cells import FREE

from .grid import CELL, with_grid


def fragment_sizes(labelled: DataFrame) -> DataFrame:
    """(grid_id, value, voxels) of every fragment."""
    return with_grid(labelled).where(F.col("value") > FREE).groupBy("grid_id", "value").agg(F.count("*").alias("voxels"))


def occupied_count(labelled: DataFrame) -> DataFrame:
    return with_grid(labelled).groupBy("grid_id").agg(F.count_if(F.col("value") > FREE).alias("voxels"))


def fragment_shares(labelled: DataFrame) -> DataFrame:
    """Fragments with their dense id from 0, voxels, voxels of the grid, and share. The window is over fragments, not cells."""
    all_of = Window.partitionBy("grid_id")
    return fragment_sizes(labelled).select(
        "grid_id", "value", (F.row_number().over(all_of.orderBy("value")) - 1).alias("fragment_id"), "voxels",
        F.sum("voxels").over(all_of).alias("occupied"), (F.col("voxels") / F.sum("voxels").over(all_of)).alias("percentage"),
    )


def quadrant_occupancy(voxels: DataFrame, step: int) -> DataFrame:
    """Most cells in any block of `step` cells an axis, per grid."""
    block = [F.floor(F.col(c) / step).alias(f"q{c}") for c in "xyz"]
    return with_grid(voxels).groupBy("grid_id", *block).agg(F.count("*").alias("n")).groupBy("grid_id").agg(F.max("n").alias("most"))


def boxes(points: DataFrame, by: str | list[str]) -> DataFrame:
    """Axis-aligned box of each group of points."""
    return points.groupBy(by).agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"])


def unit_box(points: DataFrame, by: str) -> DataFrame:
    """Points moved to the centre of their group's box and scaled so that the longest side fits the unit box."""
    b = boxes(points, by)
    side = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"])
    scale = 0.499999 / side * 2
    rest = [c for c in points.columns if c not in "xyz"]
    return points.join(b, by).select(*rest, *[((F.col(c) - (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2) * scale).alias(c) for c in "xyz"])


def mesh_sizes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, vertices, faces)."""
    v = vertices.groupBy("mesh_id").agg(F.count("*").alias("vertices"))
    return v.join(faces.groupBy("mesh_id").agg(F.count("*").alias("faces")), "mesh_id", "full_outer").select("mesh_id", F.coalesce("vertices", F.lit(0)).alias("vertices"), F.coalesce("faces", F.lit(0)).alias("faces"))


def histogram(rows: DataFrame, value: str, bins: int, lo: float, hi: float, density: bool = False) -> DataFrame:
    """(bin, count): bins by rounding the scaled value, all bins present; shares of all rows with density."""
    at = F.round((F.col(value) - lo) / (hi - lo) * (bins - 1)).cast("int")
    counts = rows.where(F.col(value).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    full = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))
    if not density:
        return full
    total = rows.agg(F.count(value).alias("total"))
    return full.crossJoin(F.broadcast(total)).select("bin", (F.col("count") / F.col("total")).alias("count"))


def histogram_latex(hist: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """The histogram as one line of coordinates."""
    pair = F.format_string("(%.6f, %.6f)", F.col("bin") * (hi - lo) / bins + lo, F.col("count").cast("double"))
    return hist.agg(F.array_sort(F.collect_list(F.struct("bin", pair.alias("p")))).alias("a")).select(F.concat(F.lit("{ "), F.array_join(F.transform("a", lambda s: s["p"]), " "), F.lit(" }")).alias("latex"))


# names


def base_name(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def size_text(x: Column, y: Column, z: Column) -> Column:
    return F.concat_ws("x", x, y, z)


def output_name(model: Column, fragments: Column, resolution: Column, iteration: Column, index: Column | None = None, target: Column | None = None, unit: str = "p", extension: str = "") -> Column:
    """<model>_<n>f_<resolution>r_<iteration>it[_<index>][_<target>p|t][.<extension>]"""
    parts = [model, F.concat(fragments, F.lit("f")), F.concat(resolution, F.lit("r")), F.concat(iteration, F.lit("it"))]
    if index is not None:
        parts.append(index.cast("string"))
    if target is not None:
        parts.append(F.concat(target, F.lit(unit)))
    name = F.concat_ws("_", *[p.cast("string") for p in parts])
    return F.concat(name, F.lit(f".{extension}")) if extension else name


#: Columns of the three metadata files.
TABLES = {
    "grid": {"filename": "Filename", "size": "Voxelization size"},
    "mesh": {"filename": "Filename", "fragment_id": "Fragment id", "size": "Voxelization size", "voxels": "Voxels", "occupied": "Occupied voxels", "percentage": "Percentage", "vertices": "Vertices", "faces": "Faces"},
    "point_cloud": {"filename": "Filename", "size": "Voxelization size", "points": "Points"},
}


def metadata_tables(rows: DataFrame, kind: str = "kind") -> dict[str, DataFrame]:
    """Metadata rows by kind, each with its own columns and headings."""
    return {k: rows.where(F.col(kind) == k).select(*[F.col(a).alias(b) for a, b in columns.items()]) for k, columns in TABLES.items()}


def with_target_sizes(rows: DataFrame, targets: list[int]) -> DataFrame:
    """Each row once for every target size of an export."""
    return rows.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
