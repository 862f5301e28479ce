"""Stencils over labelled cells: fragment boundaries, erosion and despeckling, each one aggregation by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.functions.cells import FREE, noise

from .grid import AT, CELL, cube, occupied, scatter, window_cells, with_grid


def boundary_flags(labelled: DataFrame, radius: int = 1) -> DataFrame:
    """Labelled cells with `is_boundary`: whether a cell of another label is in the cube about them."""
    seen = scatter(occupied(with_grid(labelled)).select(*CELL, "value"), cube(radius))
    counted = seen.groupBy(*CELL).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.when(F.col("own"), F.col("value"))).alias("value"))
    return counted.where("value is not null").select(*CELL, "value", (F.col("low") != F.col("high")).alias("is_boundary"))


def structuring_element(kind: str, size: int) -> tuple[list[tuple[int, int, int]], float]:
    """Offsets of a square, cross or ellipse of an odd size (even grows by one), and the share of the cube it counts for."""
    size += size % 2 == 0
    r = size // 2
    if kind == "square":
        return cube(r), 1.0
    if kind == "cross":
        return [o for o in cube(r) if sum(c != 0 for c in o) <= 1], 1 / 3
    if kind == "ellipse":
        inside = [o for o in cube(r) if sum(c * c for c in o) <= r * r]
        return inside, len(inside) / size**3
    raise ValueError(f"no structuring element {kind!r}")


def erode(labelled: DataFrame, dims: tuple[int, int, int], kind: str = "square", size: int = 3, probability: float = 1.0, threshold: float = 0.5, rounds: int = 1, seed: int = 0, despeckle_after: bool = True) -> DataFrame:
    """Erodes fragments round by round: a boundary cell whose noise is below `probability` goes when the share of cells
    of its label under the element, of those in the grid, is less than the element's share times `threshold`.

    Every round reads the one before as a whole, so the result does not depend on the order of cells.
    """
    offsets, share = structuring_element(kind, size)
    radius = (size + (size % 2 == 0)) // 2
    weight = {o: 1.0 for o in offsets}
    around = sorted(set(cube(max(1, radius))))
    cells = occupied(with_grid(labelled)).select(*CELL, "value")
    for n in range(rounds):
        seen = scatter(cells, around, dims, [weight.get(o, 0.0) for o in around])
        # a cell's own label is known only after the sums, so they are kept by label first
        by_label = seen.groupBy(*CELL, "value").agg(F.sum("w").alias("same"), F.max(F.col("far") <= 1).alias("near"), F.max("own").alias("own"))
        place = by_label.groupBy(*CELL).agg(
            F.max(F.struct("own", "value", "same")).alias("mine"), F.sum(F.col("near").cast("int")).alias("labels")
        ).where("mine.own")
        gone = (F.col("labels") > 1) & (noise(AT, seed + n) < probability) & (F.col("mine.same") / window_cells(radius, dims) < share * threshold) & (F.col("mine.value") > FREE)
        cells = place.where(~gone).select(*CELL, F.col("mine.value").alias("value"))
    return despeckle(cells) if despeckle_after else cells


def despeckle(labelled: DataFrame, least: int = 6) -> DataFrame:
    """Cells with `least` or more of their 26 neighbours of the same label."""
    seen = scatter(occupied(with_grid(labelled)).select(*CELL, "value"), cube(1))
    return seen.groupBy(*CELL, "value").agg(F.count("*").alias("n"), F.max("own").alias("own")).where(F.col("own") & (F.col("n") > least)).select(*CELL, "value")
