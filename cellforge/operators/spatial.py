"""Spatial joins: points, rays and meshes against cells and triangles, by equal cells instead of by all pairs."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellforge.lineage import cut
from cellforge.functions.cells import cell_of
from cellforge.functions.geometry import triangle_box
from cellforge.functions.vec import EPSILON, Vec

from .grid import CELL, with_grid
from .scan import global_scan

O, D = Vec.cols("ox", "oy", "oz"), Vec.cols("dx", "dy", "dz")
A, B, C = Vec.cols("ax", "ay", "az"), Vec.cols("bx", "by", "bz"), Vec.cols("cx", "cy", "cz")


def label_points(points: DataFrame, labelled: DataFrame, lo: tuple, size: tuple, dims: tuple[int, int, int], none: int = 0) -> DataFrame:
    """Points with the label of the cell that holds them, `none` where that is empty."""
    c = cell_of(Vec.cols("x", "y", "z"), Vec.of(*map(float, lo)), Vec.of(*map(float, size)), dims)
    cells = with_grid(labelled).select("grid_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), F.col("value").alias("label"))
    placed = with_grid(points).select("*", *[a.alias(f"c{k}") for a, k in zip(c, "xyz")])
    return placed.join(cells, ["grid_id", "cx", "cy", "cz"], "left").withColumn("label", F.coalesce("label", F.lit(none)))


def slab(o: Vec, d: Vec, lo: Vec, hi: Vec) -> tuple[Column, Column]:
    """Entry and exit parameter of a ray in a box; it hits where entry <= exit and exit >= 0."""
    ins, outs = [], []
    for a, b, x, y in zip(o, d, lo, hi):
        t1, t2 = (x - a) / F.nullif(b, F.lit(0.0)), (y - a) / F.nullif(b, F.lit(0.0))
        inside = a.between(x, y)
        ins.append(F.when(b == 0, F.when(inside, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(F.least(t1, t2)))
        outs.append(F.when(b == 0, F.when(inside, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.greatest(t1, t2)))
    return F.greatest(*ins), F.least(*outs)


def ray_triangle(o: Vec, d: Vec, a: Vec, b: Vec, c: Vec, eps: float = EPSILON) -> tuple[Column, Column, Column]:
    """Parameter and barycentric u, v where a ray meets a triangle; nulls where it does not."""
    e1, e2 = b - a, c - a
    p = d.cross(e2)
    det = e1.dot(p)
    inv = F.when(F.abs(det) > eps, 1 / det)
    s = o - a
    u = s.dot(p) * inv
    q = s.cross(e1)
    v = d.dot(q) * inv
    t = e2.dot(q) * inv
    ok = (u >= 0) & (v >= 0) & (u + v <= 1) & (t > eps)
    return F.when(ok, t), F.when(ok, u), F.when(ok, v)


def traversed_cells(rays: DataFrame, lo: tuple[float, float, float], size: tuple[float, float, float], dims: tuple[int, int, int], reach: float | None = None) -> DataFrame:
    """Rays with each cell (kx, ky, kz) of a grid that they pass, slab by slab of x, then of y, then of z.

    Rows grow with the cells on a ray's way, the sum of the dims at most, not with the cells of the grid. Cells are
    taken a hair wide, so none on an edge is missed; exact tests come after.
    """
    low, cell = Vec.of(*map(float, lo)), Vec.of(*map(float, size))
    high = Vec(*(a + s * n for a, s, n in zip(low, cell, dims)))
    t0, t1 = slab(O, D, low, high)
    out = rays.withColumn("t0", F.greatest(t0, F.lit(0.0))).withColumn("t1", t1 if reach is None else F.least(t1, F.lit(float(reach)))).where("t0 <= t1")
    for k, (o, d, a, s, n) in enumerate(zip(O, D, low, cell, dims)):
        name = f"k{'xyz'[k]}"
        p0, p1 = o + d * F.col("t0"), o + d * F.col("t1")
        hair = s * 1e-9
        first = F.greatest(F.floor((F.least(p0, p1) - hair - a) / s), F.lit(0)).cast("int")
        last = F.least(F.floor((F.greatest(p0, p1) + hair - a) / s), F.lit(n - 1)).cast("int")
        out = out.withColumn("__a", first).withColumn("__b", last).where("__a <= __b").withColumn(name, F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")
        x, y = a + F.col(name) * s - hair, a + (F.col(name) + 1) * s + hair
        u, v = (x - o) / F.nullif(d, F.lit(0.0)), (y - o) / F.nullif(d, F.lit(0.0))
        out = out.withColumn("__u", F.greatest(F.col("t0"), F.coalesce(F.least(u, v), F.col("t0")))).withColumn("__v", F.least(F.col("t1"), F.coalesce(F.greatest(u, v), F.col("t1")))).drop("t0", "t1").withColumnsRenamed({"__u": "t0", "__v": "t1"}).where("t0 <= t1")
    return out


def in_cell(low: Vec, cell: list[float], last: int) -> Callable[[Column], Column]:
    """Whether the point at a parameter of a ray lies in the cell (kx, ky, kz)."""

    def lies(t: Column) -> Column:
        at = (F.least(F.greatest(F.floor((o + d * t - l) / size), F.lit(0)), F.lit(last)) == F.col(f"k{c}") for o, d, l, size, c in zip(O, D, low, cell, "xyz"))
        return reduce(and_, at)

    return lies


def _tested(met: DataFrame, where: Callable[[Column], Column], carry: tuple[str, ...] = (), eps: float = EPSILON) -> DataFrame:
    """(ray_id, tri_id, t, u, v) and the columns of `carry` of the pairs of rays and triangles that hit where `where` allows the parameter.

    As ray_triangle(), in steps that Spark keeps apart, so that each product is computed once a pair; the explosion of a
    hit keeps the test from being computed again as a condition of the join.
    """
    def put(df: DataFrame, **vectors) -> DataFrame:
        return df.withColumns({f"__{n}{k}": c for n, vec in vectors.items() for k, c in (zip("xyz", vec) if isinstance(vec, Vec) else [("", vec)])})

    of = lambda n: Vec.cols(*[f"__{n}{k}" for k in "xyz"])
    e1, e2, p, s, q = map(of, ("e", "f", "p", "s", "q"))
    met = put(met, e=B - A, f=C - A, s=O - A)
    met = put(met, p=D.cross(e2), q=s.cross(e1))
    met = put(met, det=e1.dot(p))
    met = put(met, inv=F.when(F.abs("__det") > eps, 1 / F.col("__det")))
    inv = F.col("__inv")
    met = put(met, t=e2.dot(q) * inv, u=s.dot(p) * inv, v=D.dot(q) * inv)
    t, u, v = (F.col(f"__{n}") for n in "tuv")
    ok = (u >= 0) & (v >= 0) & (u + v <= 1) & (t > eps) & where(t)
    return met.select("ray_id", "tri_id", *carry, F.explode(F.when(ok, F.array(F.struct(t.alias("t"), u.alias("u"), v.alias("v"))))).alias("h")).select("ray_id", "tri_id", "h.t", "h.u", "h.v", *carry)


#: Most halvings of a scene's axes; cells then have names of 60 bits.
MOST_LEVELS = 20
#: Pieces of triangles, by a rough count, that may go to all tasks; more of them meet rays by a shuffle.
SENT_PIECES = 1 << 15


def _scene(triangles: DataFrame, levels: int | None) -> tuple[list[float], list[float], int, int, int]:
    """Box of all triangles, how often its axes may be halved, how often they are for the largest triangles, and the number
    of triangles.

    A surface of n triangles has a dozen or so in a cell if an axis has about the square root of n / 16 cells. Triangles as
    large as the scene are cut up by an axis of about the cube root of 1.5 n cells: finer cells cost more than they save.
    """
    lo, hi = triangle_box(A, B, C)
    r = triangles.agg(*[F.min(c) for c in lo], *[F.max(c) for c in hi], F.count("*")).first()
    if r[0] is None:
        return [0.0] * 3, [1.0] * 3, 0, 0, 0
    most = min(MOST_LEVELS, levels if levels is not None else (max(1, r[6] // 16).bit_length() + 1) // 2)
    return list(r[:3]), list(r[3:6]), most, min(most, round(math.log2(1.5 * r[6]) / 3)), r[6]


def _halves(rows: DataFrame) -> DataFrame:
    """Rows with each of the eight halves of their cell (kx, ky, kz) in its place."""
    out = rows.withColumn("__h", F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i in (0, 1) for j in (0, 1) for k in (0, 1)])))
    for c in "xyz":
        out = out.withColumn(f"k{c}", F.col(f"k{c}") * 2 + F.col(f"__h.{c}"))
    return out.drop("__h")


def cut_up(triangles: DataFrame, low: Vec, side: list[float], levels: int) -> DataFrame:
    """Triangles with each cell (kx, ky, kz) that their box and their plane meet after so many halvings, a hair wide."""
    e, f = B - A, C - A
    length = lambda v: sum((F.abs(c) for c in v), F.lit(0.0))
    ta, tb = triangle_box(A, B, C)
    out = triangles.select("*", *ta.named("__a"), *tb.named("__b"), *e.cross(f).named("__n"), (length(e) * length(f) * (1e-12 * sum(side))).alias("__s"), *[F.lit(0).alias(f"k{c}") for c in "xyz"])
    n = Vec.cols("__nx", "__ny", "__nz")
    for level in range(1, levels + 1):
        out = _halves(out)
        half = [s / (2 << level) for s in side]
        mid = Vec(*(a + (F.col(f"k{c}") * 2 + 1) * h for a, h, c in zip(low, half, "xyz")))
        near = F.abs(n.dot(mid - A)) <= sum((F.abs(c) * (h * (1 + 1e-6)) for c, h in zip(n, half)), F.col("__s"))
        for c, m, h in zip("xyz", mid, half):
            near = near & (F.col(f"__a{c}") <= m + h * (1 + 1e-6)) & (F.col(f"__b{c}") >= m - h * (1 + 1e-6))
        out = out.where(near)
    return out.drop("__s", *[f"__{v}{c}" for v in "abn" for c in "xyz"])


#: Triangles of a block, which a task holds while rays pass by, and tests of all pairs, for each hit that a scene's sizes let expect, that cost no more than cells.
BLOCK, TESTS = 4096, 16


def _wide(numbers: dict[int, int], coarse: int) -> int:
    """The level whose larger triangles are tested against all rays, from the numbers of triangles on each level.

    A triangle of a level is hit by a share of the rays that falls fourfold with each level, so among large ones all pairs
    are a fixed multiple of the hits, and cells and pieces cost more than they save.
    """
    hit = sum(n / 4**level for level, n in numbers.items())
    levels = [w for w in range(1, max(numbers) + 2) if 0 < sum(n for level, n in numbers.items() if level < w) <= TESTS * hit]
    return max(levels) if coarse and levels else 0


def _all_pairs(rays: DataFrame, triangles: DataFrame, n: int, tasks: int) -> DataFrame:
    """Pairs of rays and n triangles where the ray's line passes the ball around the triangle; a task holds one block of triangles.

    Rays are dealt to as many parts as keep all tasks busy, and each part meets each block once.
    """
    def plain(df: DataFrame, names: list[str]) -> DataFrame:
        # no hit either way, and numbers that cannot be null are compared faster
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names})

    mid = (A + B + C) * F.lit(1 / 3)
    tri = plain(triangles, [f"{v}{k}" for v in "abc" for k in "xyz"])
    tri = tri.withColumns({f"__m{k}": c for k, c in zip("xyz", mid)})
    m = Vec.cols("__mx", "__my", "__mz")
    tri = tri.withColumn("__r2", F.greatest(*[(p - m).dot(p - m) for p in (A, B, C)]) * (1 + 1e-6))
    rays = plain(rays, [f"{v}{k}" for v in "od" for k in "xyz"]).withColumn("__dd", D.dot(D))
    s = m - O
    # the last factor is a slack of a millionth of the distance, far above rounding
    passed = s.dot(s) * F.col("__dd") * (1 - 1e-12) - s.dot(D) * s.dot(D) <= F.col("__dd") * F.col("__r2")
    if n <= SENT_PIECES:
        return rays.join(F.broadcast(tri), passed)
    blocks = -(-n // BLOCK)
    parts = -(-4 * tasks // blocks)
    spread = lambda df, own, count, each, copies: df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(count)).cast("int")).withColumn(each, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    keys = ["__part", "__block"]
    rays, tri = spread(rays, "__part", parts, "__block", blocks), spread(tri, "__block", blocks, "__part", parts)
    return rays.repartition(tasks, *keys).join(tri.repartition(tasks, *keys).hint("merge"), keys).where(passed)


def ray_hits(rays: DataFrame, triangles: DataFrame, levels: int | None = None, reach: float | Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(ray_id, tri_id, t, u, v) and the columns of triangles in `carry`: every hit of a ray and a triangle in front of it.

    Triangles so large that rays hit a fair share of them (see _wide) are tested against all rays, unless there is a reach:
    their hits grow with the square anyway. For the others the scene's box is halved again and again. A triangle belongs to
    the level whose cells are just larger than its box, so to eight cells at most, but those larger than the cells of a level that the number of triangles gives are cut up into
    its cells: else triangles that span the scene would meet all rays in a few cells. Rays go down from level to level into
    the halves that they pass and that hold triangles, and meet the triangles of a cell on each. A hit is given by the cell
    that holds its point, so a pair that shares several cells comes out once, without another shuffle. With `reach`, only
    hits up to that parameter, which may be a column of rays.
    """
    lo, hi, most, coarse, n = _scene(triangles, levels)
    side = [max(b - a, 1e-9) for a, b in zip(lo, hi)]
    low = Vec.of(*lo)
    ta, tb = triangle_box(A, B, C)
    fits = F.least(*[F.floor(-F.log2(F.greatest((b - a) / s, F.lit(0.5 ** (most + 1))))) for a, b, s in zip(ta, tb, side)])
    levelled = triangles.withColumn("level", F.least(F.greatest(fits, F.lit(0)), F.lit(most)).cast("int"))
    numbers = {r["level"]: r["count"] for r in levelled.groupBy("level").count().collect() if r["level"] is not None}  # at most MOST_LEVELS + 1 numbers
    wide = _wide(numbers, coarse) if numbers and reach is None else 0
    held = sorted({max(level, coarse) for level in numbers if level >= wide})
    if not numbers:
        return rays.select("ray_id").join(triangles.select("tri_id", *carry), F.lit(False)).select("ray_id", "tri_id", *[F.lit(0.0).alias(c) for c in "tuv"], *carry)
    tri = levelled.where(F.col("level") >= max(coarse, wide)).withColumn("__n", F.expr("shiftleft(1, level)"))
    for a, b, l, s, name in zip(ta, tb, low, side, "xyz"):
        step = F.lit(s) / F.col("__n")
        first, last = (F.least(F.greatest(F.floor((p - l) / step + h), F.lit(0)), F.col("__n") - 1).cast("int") for p, h in ((a, -1e-6), (b, 1e-6)))
        tri = tri.withColumn(f"k{name}", F.explode(F.sequence(first, last)))
    tri = tri.drop("__n")
    if coarse > wide:
        tri = tri.unionByName(cut_up(levelled.where((F.col("level") < coarse) & (F.col("level") >= wide)), low, side, coarse).withColumn("level", F.lit(coarse)))

    def passes(way: DataFrame, level: int) -> DataFrame:
        cell = [s / (1 << level) for s in side]
        corner = Vec(*(a + F.col(f"k{c}") * s - s * 1e-9 for a, s, c in zip(low, cell, "xyz")))
        t0, t1 = slab(O, D, corner, Vec(*(a + s * (1 + 2e-9) for a, s in zip(corner, cell))))
        t1 = t1 if reach is None else F.least(t1, reach if isinstance(reach, Column) else F.lit(float(reach)))
        return way.where((F.greatest(t0, F.lit(0.0)) <= t1))

    # tests cost far more than the bytes of a ray tell, so rays are spread by number, not merged by size
    spark = rays.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rays = rays.repartition(tasks)
    out = None
    if wide:
        many = sum(count for level, count in numbers.items() if level < wide)
        out = _tested(_all_pairs(rays, levelled.where(F.col("level") < wide).drop("level"), many, tasks), lambda t: F.lit(True), carry)
    if not held:
        return out
    # pieces of triangles are many more than their table's size tells, so Spark does not choose whether to send them to all tasks
    few = n << 2 * coarse <= SENT_PIECES
    cell = ["kx", "ky", "kz"]
    way = passes(rays.select("*", *[F.lit(0).alias(f"k{c}") for c in "xyz"]), 0)
    for level in range(max(held) + 1):
        if level in held:
            held_here = tri.where(F.col("level") == level)
            met = way.join(F.broadcast(held_here), cell) if few else way.repartition(tasks, *cell).join(held_here.repartition(tasks, *cell).hint("merge"), cell)
            lies = in_cell(low, [s / (1 << level) for s in side], (1 << level) - 1)
            met = _tested(met, lies if reach is None else lambda t, lies=lies: lies(t) & (t <= reach), carry)
            out = met if out is None else out.union(met)
        if level < max(held):
            way = passes(_halves(way), level + 1)
            if level % 3 == 2:  # only into cells below which there are triangles
                below = tri.where(F.col("level") > level).select(*[F.expr(f"shiftright(k{c}, level - {level + 1})").alias(f"k{c}") for c in "xyz"]).distinct()
                way = cut(way.join(below, ["kx", "ky", "kz"], "left_semi"))
    return out


#: Triangles that rays are tested against first, to know how far they need to be followed, and how many times more of them next.
FIRST, MORE = 256, 16


def nearest_hit(rays: DataFrame, triangles: DataFrame, levels: int | None = None) -> DataFrame:
    """(ray_id, tri_id, t, u, v) of the first triangle on each ray's way; ties go to the lowest id.

    Where triangles are many, each ray meets some FIRST of them, chosen by a hash, then MORE times as many, and so on to all,
    and is followed no further each time than to the first of the hits before. So a ray has some MORE hits each time, however
    many triangles there are.
    """
    least = lambda hits: hits.groupBy("ray_id").agg(F.min(F.struct("t", "tri_id", "u", "v")).alias("h"))
    parts, early, near, reach = triangles.count() // FIRST, None, rays, None
    while parts >= 2:
        some = triangles.where(F.pmod(F.xxhash64("tri_id"), F.lit(parts)) == 0)
        hits = ray_hits(near, some, 0 if early is None else levels, reach)
        if early is not None:
            hits = hits.union(early.select("ray_id", "h.tri_id", "h.t", "h.u", "h.v"))
        early = cut(least(hits))
        # a hair further, so that hits at the same place are met
        far = early.select(F.col("ray_id").alias("__ray"), (F.col("h.t") * (1 + 1e-9)).alias("__far"))
        near = rays.join(far, rays["ray_id"] == far["__ray"], "left").withColumn("__far", F.coalesce("__far", F.lit(float("inf")))).drop("__ray")
        reach = F.col("__far")
        parts //= MORE
    hits = ray_hits(near, triangles, levels, reach)
    if early is not None:
        hits = hits.union(early.select("ray_id", "h.tri_id", "h.t", "h.u", "h.v"))
    return least(hits).select("ray_id", "h.tri_id", "h.t", "h.u", "h.v")


def mesh_collisions(left: DataFrame, right: DataFrame, levels: int | None = None) -> DataFrame:
    """Ids of the left mesh's faces one of whose edges passes through a face of the right mesh."""
    edges = left.select("tri_id", F.explode(F.array(*[F.struct(*[F.col(f"{p}{k}").alias(f"o{k}") for k in "xyz"], *[(F.col(f"{q}{k}") - F.col(f"{p}{k}")).alias(f"d{k}") for k in "xyz"]) for p, q in ("ab", "bc", "ca")])).alias("e"))
    rays = edges.select(F.col("tri_id").alias("face_id"), "e.*").withColumn("ray_id", F.struct("face_id", "ox", "oy", "oz"))
    return ray_hits(rays, right, levels, reach=1.0).select(F.col("ray_id.face_id").alias("tri_id")).distinct()


def points_in_mesh(points: DataFrame, triangles: DataFrame, levels: int | None = None) -> DataFrame:
    """Points with `inside`: for two or more of the three axes a ray crosses the mesh an odd number of times."""
    axes = F.array(*[F.struct(F.lit(k).alias("axis"), *[F.lit(float(i == k)).alias(f"d{c}") for i, c in enumerate("xyz")]) for k in range(3)])
    rays = points.select("point_id", *[F.col(c).alias(f"o{c}") for c in "xyz"], F.explode(axes).alias("a")).select(F.struct("point_id", "a.axis").alias("ray_id"), "ox", "oy", "oz", "a.dx", "a.dy", "a.dz")
    odd = ray_hits(rays, triangles, levels).groupBy("ray_id").agg((F.count("*") % 2).alias("odd"))
    votes = odd.groupBy(F.col("ray_id.point_id").alias("point_id")).agg(F.sum("odd").alias("votes"))
    return points.join(votes, "point_id", "left").withColumn("inside", F.coalesce(F.col("votes") >= 2, F.lit(False))).drop("votes")


def first_voxel(rays: DataFrame, voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(ray_id, x, y, z, t): the first occupied cell on each ray's way and where the ray enters it; cells have unit size.

    A ray that starts in an occupied cell hits it at 0. Cells are 0-based; rays without a hit are left out.
    """
    way = traversed_cells(rays, (0, 0, 0), (1, 1, 1), dims).select("ray_id", "ox", "oy", "oz", "dx", "dy", "dz", *[F.col(f"k{k}").alias(k) for k in "xyz"])
    cells = voxels.where("value <> 0").select("x", "y", "z").distinct()
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    t0, t1 = slab(O, D, Vec(x.cast("double"), y.cast("double"), z.cast("double")), Vec(x + 1.0, y + 1.0, z + 1.0))
    met = way.join(cells, ["x", "y", "z"]).withColumn("t", F.greatest(t0, F.lit(0.0))).where(t1 > F.col("t"))
    return met.groupBy("ray_id").agg(F.min(F.struct("t", "x", "y", "z")).alias("h")).select("ray_id", "h.x", "h.y", "h.z", "h.t")


def interpolate(hits: DataFrame, attributes: DataFrame, names: list[str]) -> DataFrame:
    """Hits with attributes of the three corners (name0, name1, name2) blended by u and v."""
    return blended(hits.join(attributes, "tri_id"), hits.columns, names)


def blended(hits: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """The columns and the attributes of hits that carry those of the corners (see interpolate); no join."""
    w = 1 - F.col("u") - F.col("v")
    return hits.select(*columns, *[(F.col(f"{n}0") * w + F.col(f"{n}1") * F.col("u") + F.col(f"{n}2") * F.col("v")).alias(n) for n in names])


def close_vertices(points: DataFrame, eps: float, group: str | None = None) -> DataFrame:
    """(a, b): pairs of points closer than eps, a below b. Points go to cells of side eps and meet in neighbouring ones.

    The points of a crowded cell are dealt to blocks of some BLOCK, each of which is a key of its own, so that many tasks
    share a cell and a task holds one block of it. With `group`, only pairs of different groups.
    """
    rest, cell = [group] if group else [], ["kx", "ky", "kz"]
    known = points.dropna(subset=["point_id", "x", "y", "z", *rest])
    # numbers that cannot be null are compared faster
    placed = known.select("point_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in "xyz"], *rest)
    placed = placed.select("*", *[F.floor(F.col(c) / eps).cast("long").alias(f"k{c}") for c in "xyz"])
    crowded = F.broadcast(placed.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK).alias("__blocks")).where("__blocks > 1"))  # a row for BLOCK points at most
    named = lambda n: [F.col("point_id").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"], *[F.col(g).alias(f"{n}g") for g in rest]]
    block = F.coalesce(F.pmod(F.xxhash64("b", "bx", "by", "bz"), F.col("__blocks")), F.lit(0))
    own = placed.select(*named("b"), *cell).join(crowded, cell, "left").withColumn("__block", block).drop("__blocks")
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    seen = placed.select(*named("a"), *cell, F.explode(near).alias("n"))
    seen = seen.withColumn("kx", F.col("kx") + F.col("n.i")).withColumn("ky", F.col("ky") + F.col("n.j")).withColumn("kz", F.col("kz") + F.col("n.k")).drop("n")
    blocks = F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1)
    seen = seen.join(crowded, cell, "left").withColumn("__block", F.explode(blocks)).drop("__blocks")
    # pairs are many more than the bytes of points tell, so they are spread by number, not merged by size
    spark, keys = points.sparkSession, [*cell, "__block"]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = seen.repartition(tasks, *keys).join(own.repartition(tasks, *keys).hint("merge"), keys).where("a < b")
    if group:
        both = both.where("ag <> bg")
    return both.where((Vec.cols("ax", "ay", "az") - Vec.cols("bx", "by", "bz")).length() < eps).select("a", "b")


def face_adjacency(faces: DataFrame) -> DataFrame:
    """(mesh_id, a, b, shared): faces that share a vertex, a below b, with the number of shared vertices."""
    corner = faces.select("mesh_id", "face_id", F.explode(F.array_distinct(F.array("v0", "v1", "v2"))).alias("v"))
    left, right = corner.withColumnRenamed("face_id", "a"), corner.withColumnRenamed("face_id", "b")
    return left.join(right, ["mesh_id", "v"]).where("a < b").groupBy("mesh_id", "a", "b").agg(F.count("*").alias("shared"))


def best_neighbours(boxes: DataFrame, radius: int = 100, chunk: int | None = None) -> DataFrame:
    """(id, other, area): for each box the one within `radius` places in Morton order whose union has the least surface.

    Places are cut into chunks of twice the radius unless given, which overlap by the radius, so a box meets four times as many
    as it needs, and a task holds some chunks, not the whole order.
    """
    chunk = chunk or max(2 * radius, 1)
    places = boxes.select("id", "place", *[f"{n}_{c}" for n in ("min", "max") for c in "xyz"])
    chunks = F.array_distinct(F.transform(F.array(F.lit(-radius), F.lit(0), F.lit(radius)), lambda s: F.floor((F.col("place") + s) / chunk)))
    other = places.select(F.explode(chunks).alias("chunk"), *[F.col(c).alias(f"o_{c}") for c in places.columns])
    own = places.withColumn("chunk", F.floor(F.col("place") / chunk))
    both = own.join(other, "chunk").where((F.col("place") != F.col("o_place")) & (F.abs(F.col("place") - F.col("o_place")) <= radius))
    e = [F.greatest(f"max_{c}", f"o_max_{c}") - F.least(f"min_{c}", f"o_min_{c}") for c in "xyz"]
    area = 2 * (e[0] * e[1] + e[1] * e[2] + e[0] * e[2])
    return both.groupBy("id").agg(F.min(F.struct(area.alias("area"), F.col("o_id").alias("other"))).alias("m")).select("id", "m.other", "m.area")


def agglomerate(boxes: DataFrame, radius: int = 100, local: int = 4096) -> DataFrame:
    """(round, left, right, area): the binary tree over boxes (id, place, min_x .. max_z) that merging best neighbours builds.

    In each round every two clusters that are each other's best neighbour (see best_neighbours; ties go to the lower id)
    become one, which keeps the id and the place of the one that comes first; places are then counted anew. It ends with
    one cluster, so n boxes give n - 1 rows; `area` is the surface of the merged box. Once `local` clusters or fewer are
    left, one task goes on alone: the same rounds, over that many rows at most. Fewer than two boxes give no rows.
    """
    box = [f"{n}_{c}" for n in ("min", "max") for c in "xyz"]
    live = cut(boxes.select("id", "place", *[F.col(c).cast("double").alias(c) for c in box]))
    kind = live.schema["id"].dataType.simpleString()
    n, turn, out = live.count(), 0, None
    while n > max(local, 1):
        turn += 1
        best = best_neighbours(live, radius)
        at = F.struct("place", "id")
        pairs = (
            live.join(best, "id").groupBy(F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi"))
            .agg(F.count("*").alias("c"), F.min(at).alias("l"), F.max(at).alias("r"), F.min("area").alias("area"), *[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in box])
            .where("c = 2").select("l", "r", "area", *box)
        )
        pairs = cut(pairs, n)
        gone = pairs.select(F.explode(F.array("l.id", "r.id")).alias("id"))
        next_ = live.join(gone, "id", "left_anti").select("id", F.col("place").alias("before"), *box).union(pairs.select("l.id", F.col("l.place"), *box))
        n -= pairs.count()
        live = cut(global_scan(next_, ["before"]).drop("before"), n)
        rows = pairs.select(F.lit(turn).alias("round"), F.col("l.id").alias("left"), F.col("r.id").alias("right"), "area")
        out = rows if out is None else out.union(rows)
    rest = live.groupBy(F.lit(turn).alias("turn")).applyInPandas(_agglomerated(radius), f"round int, left {kind}, right {kind}, area double")
    return rest if out is None else out.union(rest)


def _agglomerated(radius: int):
    """The rounds of agglomerate() over one task's clusters."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        ids, lo, hi = rows["id"].to_numpy(), rows[["min_x", "min_y", "min_z"]].to_numpy(), rows[["max_x", "max_y", "max_z"]].to_numpy()
        found, turn = [], key[0]
        while len(ids) > 1:
            turn += 1
            area, other = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
            for d in range(1, min(radius, len(ids) - 1) + 1):
                e = np.maximum(hi[d:], hi[:-d]) - np.minimum(lo[d:], lo[:-d])
                both = 2 * (e[:, 0] * e[:, 1] + e[:, 1] * e[:, 2] + e[:, 0] * e[:, 2])
                for one, far in ((np.arange(len(ids) - d), np.arange(d, len(ids))), (np.arange(d, len(ids)), np.arange(len(ids) - d))):
                    better = (both < area[one]) | ((both == area[one]) & (ids[far] < ids[other[one]]))
                    area[one[better]], other[one[better]] = both[better], far[better]
            left = np.flatnonzero((other[other] == np.arange(len(ids))) & (other > np.arange(len(ids))))
            right = other[left]
            found.append(pd.DataFrame({"round": turn, "left": ids[left], "right": ids[right], "area": area[left]}))
            lo[left], hi[left] = np.minimum(lo[left], lo[right]), np.maximum(hi[left], hi[right])
            stay = np.ones(len(ids), bool)
            stay[right] = False
            ids, lo, hi = ids[stay], lo[stay], hi[stay]
        return pd.concat(found) if found else pd.DataFrame({"round": [], "left": [], "right": [], "area": []})

    return run


def octree_leaves(triangles: DataFrame, levels: int, lo: tuple, side: float) -> DataFrame:
    """(tri_id, level, code): the octree boxes of the last level that each triangle's box overlaps, by path code."""
    step = side / (1 << levels)
    ta, tb = triangle_box(A, B, C)
    out = triangles
    for k, name in enumerate("xyz"):
        first, last = (F.least(F.greatest(F.floor((p - float(lo[k])) / step), F.lit(0)), F.lit((1 << levels) - 1)).cast("int") for p in (list(ta)[k], list(tb)[k]))
        out = out.withColumn(f"k{name}", F.explode(F.sequence(first, last)))
    from cellforge.functions.cells import morton

    return out.select("tri_id", F.lit(levels).alias("level"), morton(Vec.cols("kx", "ky", "kz")).alias("code"))


def column_hits(triangles: DataFrame, axis: int, dims: tuple[int, int, int]) -> DataFrame:
    """(mesh_id, a, b, t): where lines along an axis through cell centres meet triangles; a and b are the other axes' cells.

    Cells have unit size. A shared edge counts for one of its triangles only (by the sign of the edge), so crossings of
    a closed mesh pair up.
    """
    u, v = [k for k in range(3) if k != axis]
    name = "xyz"
    pts = [[F.col(f"{p}{name[k]}") for k in range(3)] for p in "abc"]
    out = triangles
    for col, k in (("a_", u), ("b_", v)):
        ends = [p[k] for p in pts]
        first = F.greatest(F.ceil(F.least(*ends) - 0.5), F.lit(0)).cast("int")
        last = F.least(F.floor(F.greatest(*ends) - 0.5), F.lit(dims[k] - 1)).cast("int")
        out = out.withColumn("__f", first).withColumn("__l", last).where("__f <= __l").withColumn(col, F.explode(F.sequence("__f", "__l"))).drop("__f", "__l")
    x, y = F.col("a_") + 0.5, F.col("b_") + 0.5

    def side(p, q) -> Column:
        return (q[u] - p[u]) * (y - p[v]) - (q[v] - p[v]) * (x - p[u])

    area = (pts[1][u] - pts[0][u]) * (pts[2][v] - pts[0][v]) - (pts[1][v] - pts[0][v]) * (pts[2][u] - pts[0][u])
    sign = F.when(area > 0, 1.0).otherwise(-1.0)
    inside = area != 0
    for p, q in ((pts[0], pts[1]), (pts[1], pts[2]), (pts[2], pts[0])):
        w = side(p, q) * sign
        du, dv = (q[u] - p[u]) * sign, (q[v] - p[v]) * sign
        inside = inside & ((w > 0) | ((w == 0) & ((dv < 0) | ((dv == 0) & (du > 0)))))
    w0, w1, w2 = side(pts[1], pts[2]) / area, side(pts[2], pts[0]) / area, side(pts[0], pts[1]) / area
    t = w0 * pts[0][axis] + w1 * pts[1][axis] + w2 * pts[2][axis]
    return out.where(inside).select("mesh_id", F.col("a_").alias("a"), F.col("b_").alias("b"), t.alias("t"))


def enclosed_cells(triangles: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(mesh_id, x, y, z): cells with mesh on all six sides along the axes through their centres."""
    spans = []
    for axis in range(3):
        u, v = ["xyz"[k] for k in range(3) if k != axis]
        spans.append(column_hits(triangles, axis, dims).groupBy("mesh_id", F.col("a").alias(u), F.col("b").alias(v)).agg(F.min("t").alias(f"lo{axis}"), F.max("t").alias(f"hi{axis}")))
    x = spans[0].join(spans[1], ["mesh_id", "z"]).join(spans[2], ["mesh_id", "x", "y"])
    mid = lambda c: F.col(c) + 0.5
    ok = F.lit(True)
    for axis, c in enumerate("xyz"):
        ok = ok & (F.col(f"lo{axis}") < mid(c)) & (F.col(f"hi{axis}") > mid(c))
    return x.where(ok).select("mesh_id", "x", "y", "z")
