"""A tree of boxes over triangles, and rays that traverse it level by level."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellforge.functions.cells import cell_of, morton
from cellforge.functions.geometry import triangle_box
from cellforge.functions.vec import Vec
from cellforge.lineage import cut

from .scan import global_scan
from .spatial import A, B, C, D, O, _tested, cut_up, slab

#: Children of a node, and triangles of a leaf.
FAN, LEAF = 8, 8
#: Nodes of a level that may go to all tasks; larger levels are joined by a shuffle.
SMALL_LEVEL = 1 << 15
#: Triangles are cut up into cells of which an axis has about the cube root of n / CUT_UP, but has been halved so often at most.
CUT_UP, MOST_HALVED = 20, 6
BOX = [f"{n}_{c}" for n in ("min", "max") for c in "xyz"]
LO, HI = Vec.cols(*BOX[:3]), Vec.cols(*BOX[3:])


@dataclass
class BoxTree:
    """Levels of nodes (node, min_x .. max_z), leaves first, and the triangles with their leaves; node n's parent is n div FAN."""

    levels: list[DataFrame]
    sizes: list[int]
    triangles: DataFrame


def box_levels(triangles: DataFrame) -> BoxTree:
    """The tree over triangles (tri_id, ax .. cz) in the Morton order of their centres.

    Triangles are placed by one scan of the order; LEAF of them in a row are a leaf, FAN nodes in a row a node of the level
    above. So a level is one aggregate of the one below, a node's number says its parent, and nothing is merged pair by pair.
    Boxes are a little larger than what they hold, so that rounding hides no triangle.

    Boxes of triangles as large as the scene would all lie over each other, and rays visit all. So triangles that are larger
    than the cells of a grid that their number gives are cut up into its cells: a cell is a leaf, its Morton code its number,
    and its box only what lies in the cell. Those leaves come behind the others', in a branch of their own below the root.
    """
    lo, hi = triangle_box(A, B, C)
    boxed = triangles.select("*", *lo.named("min_"), *hi.named("max_"))
    ends = boxed.agg(*[F.min(c) for c in BOX[:3]], *[F.max(c) for c in BOX[3:]], F.count("*")).first()
    *ends, n = ends
    if not n:
        return BoxTree([], [], triangles.limit(0))
    side = max(b - a for a, b in zip(ends[:3], ends[3:])) or 1.0
    give = 1e-9 * max(side, *map(abs, ends))
    halved = max(0, min(MOST_HALVED, round(math.log2(n / CUT_UP) / 3)))
    cells = 1 << halved
    wide = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]) > side / cells
    large = boxed.where(wide)
    cut_n = large.count() if halved else 0
    small_n = n - cut_n
    placed, levels, sizes, depth = [], [], [], 0
    if small_n:
        cell = cell_of((LO + HI) * 0.5, Vec.of(*ends[:3]), Vec.of(*[side / 1024] * 3), (1024, 1024, 1024))
        small = boxed.where(~wide) if cut_n else boxed
        small = global_scan(small.withColumn("code", morton(cell)), ["code", "tri_id"]).withColumn("node", F.floor(F.col("place") / LEAF)).drop("code", "place")
        placed.append(small)
        while LEAF * FAN**depth < small_n:
            depth += 1
    if cut_n:
        depth = max(depth, halved)
        first = FAN**depth if small_n else 0
        low, width = Vec.of(*ends[:3]), side / cells
        pieces = cut_up(large, low, [side] * 3, halved)
        corner = Vec(*(a + F.col(f"k{c}") * width for a, c in zip(low, "xyz")))
        within = {f"min_{c}": F.greatest(F.col(f"min_{c}"), k - 1e-6 * width) for c, k in zip("xyz", corner)} | {f"max_{c}": F.least(F.col(f"max_{c}"), k + width * (1 + 1e-6)) for c, k in zip("xyz", corner)}
        placed.append(pieces.withColumns(within | {"node": morton(Vec.cols("kx", "ky", "kz")).cast("long") + first}).drop("kx", "ky", "kz"))
    placed = cut(reduce(DataFrame.unionByName, placed))
    rows = placed.select("node", *[(F.col(c) + (give if c.startswith("max") else -give)).alias(c) for c in BOX])
    for k in range(depth + (2 if small_n and cut_n else 1)):
        size = max(1, -(-small_n // (LEAF * FAN**k))) * (small_n > 0) + FAN ** max(halved - k, 0) * (cut_n > 0)
        level = cut(rows.groupBy("node").agg(*[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in BOX]), size)
        levels.append(level)
        sizes.append(size)
        rows = level.withColumn("node", F.floor(F.col("node") / FAN))
    return BoxTree(levels, sizes, placed.drop(*BOX))


def traverse(rays: DataFrame, tree: BoxTree, width: int = 1, widen: int = 8) -> DataFrame:
    """(ray_id, tri_id, t, u, v, visited): the nearest hit of each ray that hits (ties: least tri_id), and the nodes that it visited.

    Rays go down the levels together, as a join of the frontier with the children of its nodes. On each level a ray keeps the
    `width` nodes that it enters first and notes the entry of the nearest one that it leaves. At the leaves it has a hit, or none; a hit before all that
    was left is the nearest, and the ray is done. The others go down again with `widen` times as many nodes, but only into
    boxes before their best hit so far. So a ray among many triangles looks at one path mostly, and all nodes are only
    visited by rays that meet none of their triangles. A leaf gives the hits inside its box. Results are exact.
    """
    hits = None
    if not tree.levels:
        return rays.select("ray_id").limit(0).selectExpr("ray_id", "0L as tri_id", "0D as t", "0D as u", "0D as v", "0L as visited")
    kind = dict(tree.triangles.dtypes)["tri_id"]
    none = [F.lit(None).cast(k).alias(c) for c, k in (("tri_id", kind), ("t", "double"), ("u", "double"), ("v", "double"))]
    live = cut(rays.select("ray_id", *(f"{a}{c}" for a in "od" for c in "xyz"), *none, F.lit(0).cast("long").alias("visited")))
    ray = ["ray_id", *(f"{a}{c}" for a in "od" for c in "xyz"), "t"]
    spark = rays.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = Window.partitionBy("ray_id").orderBy("entry", "node")
    while True:
        front, passed = live.select(*ray, F.lit(0).cast("long").alias("parent")), []
        for size, level in reversed(list(zip(tree.sizes, tree.levels))):
            front, children = front.drop("exit"), level.withColumn("parent", F.floor(F.col("node") / FAN))
            near = front.join(F.broadcast(children) if size <= SMALL_LEVEL else children, "parent")
            entry, exit_ = slab(O, D, LO, HI)
            near = near.withColumn("entry", entry).withColumn("exit", exit_).where("entry <= exit and exit >= 0 and (t is null or entry <= t)")
            near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width + 1)
            near = cut(near.select(*ray, "node", "entry", "exit", "place"))
            passed.append(near.select("ray_id", "entry", "place"))
            front = near.where(F.col("place") <= width).select(*ray, F.col("node").alias("parent"), "exit")
        went = reduce(DataFrame.union, passed).groupBy("ray_id").agg(F.min(F.when(F.col("place") > width, F.col("entry"))).alias("left"), F.count_if(F.col("place") <= width).alias("seen"))
        # tests cost far more than the bytes of a pair tell, so leaves are dealt by number; hits behind a leaf are those of others
        met = front.withColumnRenamed("parent", "node").repartition(tasks, "node").join(tree.triangles.repartition(tasks, "node").hint("merge"), "node")
        tested = _tested(met, lambda t: t <= F.col("exit") * 1.01).select("ray_id", "tri_id", F.col("t").alias("t1"), F.col("u").alias("u1"), F.col("v").alias("v1"))
        found = tested.groupBy("ray_id").agg(F.min(F.struct("t1", "tri_id", "u1", "v1")).alias("h"))
        now = live.join(went, "ray_id", "left").join(found, "ray_id", "left")
        better = F.col("h").isNotNull() & (F.col("t").isNull() | (F.col("h.t1") < F.col("t")) | ((F.col("h.t1") == F.col("t")) & (F.col("h.tri_id") < F.col("tri_id"))))
        take = lambda c, h: F.when(better, F.col(f"h.{h}")).otherwise(F.col(c)).alias(c)
        now = now.select(*[c for c in ray if c != "t"], take("tri_id", "tri_id"), take("t", "t1"), take("u", "u1"), take("v", "v1"), (F.col("visited") + F.coalesce("seen", F.lit(0))).alias("visited"), F.coalesce("left", F.lit(float("inf"))).alias("left"))
        now = cut(now)
        done = now.where("left = double('inf') or t < left").select("ray_id", "tri_id", "t", "u", "v", "visited").where("t is not null")
        hits = done if hits is None else hits.union(done)
        live = now.where("left < double('inf') and (t is null or t >= left)").drop("left")
        if live.isEmpty():
            return hits
        width *= widen
