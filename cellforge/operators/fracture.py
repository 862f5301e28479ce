"""Fragment labelling: nearest seed, flood and Voronoi; all runs of a table go through as one job."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellforge.lineage import cut
from cellforge.functions.cells import FREE
from cellforge.functions.vec import METRICS, Vec

from .blocks import BLOCK, flood_blocks, grid_parts
from .grid import AT, CELL, NEIGHBOURHOODS, occupied, with_grid

#: Seeds that may stand as literals in one expression.
LITERAL_SEEDS = 256
#: A distance and a seed id are compared as one number, distance * ID_STEP + id; ids are ints from 0, distances below 2^32.
ID_STEP = 1 << 31


@dataclass(frozen=True)
class FractureParams:
    """One fracture job."""

    algorithm: str = "naive"
    metric: str = "euclidean"
    neighbourhood: int | None = None
    dims: tuple[int, int, int] = (32, 32, 32)
    fragments: tuple[int, int] = (2, 10)
    iterations: tuple[int, int] = (25, 15)
    max_fragments: int = 1000

    def neighbours(self) -> int:
        return self.neighbourhood or (6 if self.metric == "manhattan" else 26)


class Fracturer(Protocol):
    """Anything that labels voxels from seeds."""

    def __call__(self, voxels: DataFrame, seeds: DataFrame, params: FractureParams) -> DataFrame: ...


def nearest_literal(at: Vec, seeds: list[tuple[int, int, int, int]], metric: str = "euclidean") -> Column:
    """Id of the nearest of a few seeds (id, x, y, z): a projection, without join or shuffle; ties go to the lowest id."""
    packed = [METRICS[metric](at, Vec.of(x, y, z)).cast("long") * ID_STEP + i for i, x, y, z in sorted(seeds)]
    return (F.least(*packed) if len(packed) > 1 else packed[0]).bitwiseAND(ID_STEP - 1).cast("int")


def nearest_seed(voxels: DataFrame, seeds: DataFrame | list[tuple[int, int, int, int]], params: FractureParams = FractureParams()) -> DataFrame:
    """Occupied cells with the id of their grid's nearest seed as value.

    A list of seeds is one projection. A table of seeds (grid_id, seed_id, sx, sy, sz) is gathered per grid to an array
    (a few seeds each) and joined by grid_id; the least of distance and id is then taken in place, so cells are never
    multiplied by seeds.
    """
    cells = occupied(with_grid(voxels))
    if isinstance(seeds, list):
        if len(seeds) <= LITERAL_SEEDS:
            return cells.select(*CELL, nearest_literal(AT, seeds, params.metric).alias("value"))
        seeds = cells.sparkSession.createDataFrame([(0, *s) for s in seeds], "grid_id long, seed_id int, sx int, sy int, sz int")
    per_grid = with_grid(seeds).groupBy("grid_id").agg(F.collect_list(F.struct("seed_id", "sx", "sy", "sz")).alias("seeds"))
    metric = METRICS[params.metric]
    packed = F.array_min(F.transform("seeds", lambda s: metric(AT, Vec(s["sx"], s["sy"], s["sz"])).cast("long") * ID_STEP + s["seed_id"]))
    return cells.join(per_grid, "grid_id").select(*CELL, packed.bitwiseAND(ID_STEP - 1).cast("int").alias("value"))


def delaunay_longest_edge(seeds: list[tuple[int, int, int, int]]) -> float:
    """Longest edge of the seeds' Delaunay graph; two seeds are joined if some point is nearest to both.

    For the few seeds of one run: an edge is kept unless the bisector is covered by the other seeds, which is tested as
    the feasibility of a small linear programme over the bisector plane.
    """
    p = np.array([s[1:] for s in seeds], float)
    best = 0.0
    for i in range(len(p)):
        for j in range(i):
            if _share_face(p, i, j):
                best = max(best, float(np.linalg.norm(p[i] - p[j])))
    return best


def _share_face(p: np.ndarray, i: int, j: int) -> bool:
    mid, normal = (p[i] + p[j]) / 2, p[i] - p[j]
    axis = np.eye(3)[np.argmin(np.abs(normal))]
    u = np.cross(normal, axis)
    u /= np.linalg.norm(u)
    v = np.cross(normal, u)
    v /= np.linalg.norm(v)
    others = [k for k in range(len(p)) if k not in (i, j)]
    # |x - p_i|^2 <= |x - p_k|^2 on x = mid + s u + t v  is  a s + b t <= c
    half = [(2 * (p[k] - p[i]) @ u, 2 * (p[k] - p[i]) @ v, p[k] @ p[k] - p[i] @ p[i] - 2 * mid @ (p[k] - p[i])) for k in others]
    poly = [np.array(q, float) for q in ((-1e6, -1e6), (1e6, -1e6), (1e6, 1e6), (-1e6, 1e6))]
    for a, b, c in half:
        out = []
        for k, q in enumerate(poly):
            r = poly[(k + 1) % len(poly)]
            dq, dr = a * q[0] + b * q[1] - c, a * r[0] + b * r[1] - c
            if dq <= 1e-9:
                out.append(q)
            if (dq < -1e-9 < 1e-9 < dr) or (dr < -1e-9 < 1e-9 < dq):
                out.append(q + (r - q) * (dq / (dq - dr)))
        poly = out
        if not poly:
            return False
    return True


def voronoi(voxels: DataFrame, seeds: list[tuple[int, int, int, int]], reach: float | None = None) -> DataFrame:
    """Occupied cells labelled by their Voronoi region around the seeds' cell centres, FREE beyond `reach`.

    A cell belongs to the seed whose bisector planes it is all in front of, that is the nearest; `reach` is the longest
    Delaunay edge unless given. Ties go to the lowest seed.
    """
    reach = delaunay_longest_edge(seeds) if reach is None else reach
    d2 = [(AT.x + AT.x - 2 * x - 1) * (AT.x + AT.x - 2 * x - 1) + (AT.y + AT.y - 2 * y - 1) * (AT.y + AT.y - 2 * y - 1) + (AT.z + AT.z - 2 * z - 1) * (AT.z + AT.z - 2 * z - 1) for _, x, y, z in seeds]
    packed = [d.cast("long") * ID_STEP + s[0] for d, s in zip(d2, seeds)]
    least = F.least(*packed) if len(packed) > 1 else packed[0]
    return occupied(with_grid(voxels)).select(*CELL, least.alias("p")).select(
        *CELL, F.when(F.shiftright("p", 31) < 4 * reach * reach, F.col("p").bitwiseAND(ID_STEP - 1)).otherwise(FREE).cast("int").alias("value")
    )


# flood


def flood(voxels: DataFrame, seeds: DataFrame, neighbourhood: int = 6, block: int = BLOCK) -> DataFrame:
    """(cell, value, level) of the cells that a breadth-first flood from the seeds reaches; unreached cells stay out.

    A level goes to all neighbours at once and the least seed id wins a cell. Grids are dealt to tasks by blocks (see
    blocks.flood_blocks), many runs side by side. Seeds on empty cells take no part.
    """
    sources = with_grid(seeds).select("grid_id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), F.col("seed_id").alias("label"))
    reached = flood_blocks(occupied(with_grid(voxels)), sources, neighbourhood, block).where("level >= 0")
    return reached.select(*CELL, F.col("label").cast("int").alias("value"), "level")


def flood_frontier(voxels: DataFrame, seeds: DataFrame, neighbourhood: int = 6, every: int = 4, max_levels: int = 4096) -> DataFrame:
    """As flood(), with each level a join of the frontier and the cells; for grids that no single task can hold."""
    cells = occupied(with_grid(voxels)).select(*CELL)
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in NEIGHBOURHOODS[neighbourhood]])
    front = with_grid(seeds).select("grid_id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), F.col("seed_id").alias("value")).join(cells, CELL, "left_semi")
    front = cut(front.groupBy(*CELL).agg(F.min("value").alias("value")).withColumn("level", F.lit(0)))
    done = front
    for level in range(1, max_levels):
        free = cells.join(done.select(*CELL), CELL, "left_anti")
        to = front.select("grid_id", "x", "y", "z", "value", F.explode(steps).alias("o")).select("grid_id", (F.col("x") + F.col("o.x")).alias("x"), (F.col("y") + F.col("o.y")).alias("y"), (F.col("z") + F.col("o.z")).alias("z"), "value")
        front = cut(to.groupBy(*CELL).agg(F.min("value").alias("value")).join(free, CELL).withColumn("level", F.lit(level)))
        if front.isEmpty():
            return done
        done = done.union(front)
        if level % every == 0:
            done = cut(done)
    raise RuntimeError(f"the flood did not end in {max_levels} levels")


def flood_repaired(voxels: DataFrame, seeds: DataFrame, neighbourhood: int = 26, max_rounds: int = 64, block: int = BLOCK) -> DataFrame:
    """Flood from several sub-seeds (seed_id, sub_seed) of each fragment, repaired until every fragment is connected.

    After a flood, touching cells of one fragment take the least sub-seed of their part. A fragment keeps the part of
    its least sub-seed; cells of other parts are freed and flooded again from what was kept, until none is freed; an error
    if that takes over `max_rounds` rounds. Cells that nothing reaches are FREE. Output: cell, value, sub_seed. Floods and parts
    are found by blocks, what a fragment keeps by an aggregate, so no task holds a grid or a fragment.
    """
    cells = cut(occupied(with_grid(voxels)).select(*CELL))
    at = [F.col(f"s{c}").alias(c) for c in "xyz"]
    word = F.col("seed_id").cast("long") * ID_STEP + F.col("sub_seed")
    sources = with_grid(seeds).select("grid_id", *at, word.alias("label"))
    for _ in range(max_rounds):
        flooded = flood_blocks(cells, sources, neighbourhood, block)
        live = flooded.where("level >= 0").select(*CELL, F.shiftright("label", 31).alias("value"), F.col("label").bitwiseAND(ID_STEP - 1).alias("sub_seed"))
        live = live.where(F.col("value") > FREE)
        parts = grid_parts(live, neighbourhood, block).join(live, [*CELL, "value"])
        least = parts.groupBy("grid_id", "value", "part").agg(F.min("sub_seed").alias("sub_seed"))
        kept = least.groupBy("grid_id", "value").agg(F.min("sub_seed").alias("keep"))
        labelled = cut(parts.drop("sub_seed").join(least, ["grid_id", "value", "part"]).join(kept, ["grid_id", "value"]).select(*CELL, "value", "sub_seed", "keep"))
        if labelled.where("sub_seed <> keep").isEmpty():
            break
        sources = labelled.where("sub_seed = keep").select(*CELL, (F.col("value") * ID_STEP + F.col("sub_seed")).alias("label"))
    else:
        raise RuntimeError(f"the repair did not end in {max_rounds} rounds")
    out = cells.join(labelled, CELL, "left")
    return out.select(*CELL, F.coalesce("value", F.lit(FREE)).cast("int").alias("value"), F.coalesce("sub_seed", F.lit(0)).cast("int").alias("sub_seed"))


def keep_connected(labelled: DataFrame, seeds: DataFrame, neighbourhood: int = 6, block: int = BLOCK) -> DataFrame:
    """Cells that their own seed reaches over cells of its label; the others become EMPTY, so they are left out.

    The connected parts of each label are found by blocks; those that hold a seed of their label stay.
    """
    parts = cut(grid_parts(occupied(with_grid(labelled)), neighbourhood, block))
    own = with_grid(seeds).select("grid_id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), F.col("seed_id").alias("value"))
    held = parts.join(own, [*CELL, "value"], "left_semi").select("grid_id", "part").distinct()
    return parts.join(held, ["grid_id", "part"], "left_semi").select(*CELL, "value")


def least_sub_seed(labelled: DataFrame) -> DataFrame:
    """Least sub-seed of each fragment."""
    return with_grid(labelled).where(F.col("value") > FREE).groupBy("grid_id", "value").agg(F.min("sub_seed").alias("sub_seed"))


#: Algorithms by name; a Fracturer of one's own can be added.
ALGORITHMS: dict[str, Fracturer] = {
    "naive": lambda v, s, p: nearest_seed(v, s, p),
    "flood": lambda v, s, p: flood(v, s, p.neighbours()).drop("level"),
    "voronoi": lambda v, s, p: voronoi(v, seed_list(s)),
}


def seed_list(seeds: DataFrame | list) -> list[tuple[int, int, int, int]]:
    """The few seeds of one run as tuples; refuses more than LITERAL_SEEDS."""
    if isinstance(seeds, list):
        return seeds
    rows = [tuple(r) for r in seeds.select("seed_id", "sx", "sy", "sz").limit(LITERAL_SEEDS + 1).collect()]
    if len(rows) > LITERAL_SEEDS:
        raise ValueError(f"more than {LITERAL_SEEDS} seeds in one run")
    return sorted(rows)


def fracture(voxels: DataFrame, seeds: DataFrame, params: FractureParams = FractureParams()) -> DataFrame:
    """Labels voxels by the algorithm that the parameters name."""
    if params.algorithm not in ALGORITHMS:
        raise ValueError(f"no algorithm {params.algorithm!r}; there are {sorted(ALGORITHMS)}")
    return ALGORITHMS[params.algorithm](voxels, seeds, params)


def runs(models: DataFrame, params: FractureParams = FractureParams()) -> DataFrame:
    """(model_id, run_id, n_fragments, iteration): the schedule of a data set as a table, so all runs are one job.

    Iterations fall linearly with the number of fragments, truncated; runs of a model stop before their fragments pass
    the limit.
    """
    lo, hi = params.fragments
    first, last = params.iterations
    n = F.col("n_fragments")
    count = F.floor(first + (last - first) * ((n - lo) / max(1, hi - lo))).cast("int")
    out = models.select("model_id", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("n_fragments")).withColumn("iteration", F.explode(F.sequence(F.lit(0), count - 1)))
    from pyspark.sql import Window

    order = Window.partitionBy("model_id").orderBy("n_fragments", "iteration")
    return (
        out.withColumn("total", F.sum("n_fragments").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("total") <= params.max_fragments)
        .select("model_id", (F.row_number().over(order) - 1).alias("run_id"), "n_fragments", "iteration")
    )
