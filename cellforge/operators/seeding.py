"""Seeds: reproducible uniform, Halton and impact-biased choices, and their merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellforge.functions.cells import halton, noise
from cellforge.functions.vec import METRICS, Vec, euclid2

from .fracture import ID_STEP
from .grid import AT, CELL, surface_flags, with_grid
from .scan import least_of_groups

#: Numbers in [0, 1) of a cell, by law.
LAWS = {
    "uniform": lambda at, seed: noise(at, seed),
    "normal": lambda at, seed: F.least(F.greatest(F.sqrt(-2 * F.log(F.greatest(noise(at, seed), F.lit(1e-12)))) * F.cos(6.283185307179586 * noise(at, seed + 1)) * 0.25 + 0.5, F.lit(0.0)), F.lit(1.0)),
    "halton": lambda at, seed: halton(at.x * 1048576 + at.y * 1024 + at.z + seed, 2),
}


def candidates(voxels: DataFrame, dims: tuple[int, int, int], location: str = "both") -> DataFrame:
    """Occupied cells that may hold a seed: on the surface (outer), below it (inner), or both."""
    cells = surface_flags(voxels, dims)
    return {"outer": cells.where("is_surface"), "inner": cells.where("not is_surface"), "both": cells}[location].select(*CELL)


def _numbered(chosen: DataFrame, first_id: int) -> DataFrame:
    order = Window.partitionBy("grid_id").orderBy("x", "y", "z")
    return chosen.select("grid_id", (F.row_number().over(order) + first_id - 1).cast("int").alias("seed_id"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"))


def uniform_seeds(voxels: DataFrame, n: int, dims: tuple[int, int, int], location: str = "both", law: str = "uniform", seed: int = 0) -> DataFrame:
    """n seeds per grid, exactly, without retries: the candidates of the least numbers; ids from 2 in order of the cell.

    A grid with fewer candidates gives them all.
    """
    drawn = Window.partitionBy("grid_id").orderBy(F.col("u"), "x", "y", "z")
    chosen = candidates(voxels, dims, location).withColumn("u", LAWS[law](AT, seed)).withColumn("n", F.row_number().over(drawn)).where(F.col("n") <= n)
    return _numbered(chosen, 2)


def near_seeds(voxels: DataFrame, fragments: DataFrame, n: int, dims: tuple[int, int, int], impacts: int = 1, spread: int = 2, seed: int = 0) -> DataFrame:
    """The fragment seeds and n more on the surface around `impacts` of them, denser near by.

    Offsets wrap around the grid, at most half its least dimension away. Of those cells the n with the least number
    noise^(1/spread) times distance are taken; ids follow the fragments'.
    """
    half = min(dims) // 2
    fragments = with_grid(fragments)
    hit = Window.partitionBy("grid_id").orderBy(noise(Vec.cols("sx", "sy", "sz"), seed), "seed_id")
    hits = fragments.withColumn("n", F.row_number().over(hit)).where(F.col("n") <= impacts).groupBy("grid_id").agg(F.collect_list(F.struct("sx", "sy", "sz")).alias("hits"))
    last = fragments.groupBy("grid_id").agg(F.max("seed_id").alias("last"))

    def wrapped(a: Column, b: Column, d: int) -> Column:
        gap = F.abs(a - b)
        return F.least(gap, d - gap)

    def distance2(s: Column) -> Column:
        d = [wrapped(a, b, k) for a, b, k in zip(AT, (s["sx"], s["sy"], s["sz"]), dims)]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

    near = candidates(voxels, dims, "outer").join(hits, "grid_id").withColumn("d2", F.array_min(F.transform("hits", distance2))).where(F.col("d2") <= half * half)
    taken = near.join(fragments.select("grid_id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z")), CELL, "left_anti")
    order = Window.partitionBy("grid_id").orderBy(F.pow(noise(AT, seed + 1), F.lit(1.0 / spread)) * F.sqrt(F.col("d2").cast("double")), "x", "y", "z")
    extra = _numbered(taken.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select(*CELL), 1).join(last, "grid_id").select("grid_id", (F.col("seed_id") + F.col("last")).alias("seed_id"), "sx", "sy", "sz")
    return fragments.select("grid_id", "seed_id", "sx", "sy", "sz").unionByName(extra)


def merge_seeds(fragments: DataFrame, extra: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Each extra seed with the id of its nearest fragment seed and its ordinal there as sub_seed (from 1)."""
    per_grid = with_grid(fragments).groupBy("grid_id").agg(F.collect_list(F.struct("seed_id", "sx", "sy", "sz")).alias("f"))
    measure = METRICS[metric]
    packed = F.array_min(F.transform("f", lambda s: measure(Vec.cols("sx", "sy", "sz"), Vec(s["sx"], s["sy"], s["sz"])).cast("long") * ID_STEP + s["seed_id"]))
    nearest = with_grid(extra).join(per_grid, "grid_id").withColumn("fragment", packed.bitwiseAND(ID_STEP - 1).cast("int"))
    order = Window.partitionBy("grid_id", "fragment").orderBy("seed_id")
    return nearest.select("grid_id", F.col("fragment").alias("seed_id"), F.row_number().over(order).alias("sub_seed"), "sx", "sy", "sz")


def select_points(points: DataFrame, n: int, key: str = "point_id", group: str | None = None, seed: int = 0) -> DataFrame:
    """n rows drawn without replacement by a hash of the key, from all rows or from each group."""
    number = noise(Vec.of(F.col(key), F.lit(1), F.lit(2)), seed)
    if group is None:
        return points.orderBy(number, key).limit(n)
    return least_of_groups(points, group, number, [key], n)


def pad_to_power_of_two(points: DataFrame, key: str = "point_id", group: str = "cloud_id", seed: int = 0) -> DataFrame:
    """Each cloud filled up to the next power of two with copies of points drawn with replacement; copies have `copy` above 0."""
    sized = points.groupBy(group).agg(F.count("*").alias("__n"))
    whole = F.pow(F.lit(2.0), F.ceil(F.log2("__n"))).cast("long")
    draws = sized.withColumn("copy", F.explode(F.when(whole > F.col("__n"), F.sequence(F.lit(1).cast("long"), whole - F.col("__n"))).otherwise(F.array())))
    draws = draws.withColumn("__at", (F.floor(noise(Vec.of(F.col(group), F.col("copy"), F.lit(3)), seed) * F.col("__n")) + 1).cast("int"))
    order = Window.partitionBy(group).orderBy(key)
    ranked = points.withColumn("__at", F.row_number().over(order))
    copies = ranked.join(draws.select(group, "copy", "__at"), [group, "__at"])
    return points.withColumn("copy", F.lit(0).cast("long")).unionByName(copies.drop("__at"))


def random_points(spark, n: int, lo=(0.0, 0.0, 0.0), hi=(1.0, 1.0, 1.0), radius: float | None = None, seed: int = 0) -> DataFrame:
    """n points in a box, or in a ball about the origin; numbers depend on the row and the seed alone."""
    u = [noise(Vec.of(F.col("id"), F.lit(k), F.lit(7)), seed) for k in range(3)]
    if radius is None:
        at = [F.lit(a) + x * (b - a) for a, b, x in zip(lo, hi, u)]
    else:
        r, cos, phi = radius * F.cbrt(u[0]), 2 * u[1] - 1, 6.283185307179586 * u[2]
        sin = F.sqrt(1 - cos * cos)
        at = [r * sin * F.cos(phi), r * sin * F.sin(phi), r * cos]
    return spark.range(n).select(F.lit(0).cast("long").alias("cloud_id"), F.col("id").alias("point_id"), *(c.alias(k) for c, k in zip(at, "xyz")))
