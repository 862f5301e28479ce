"""Iso-surfaces of labelled voxels and what is done to their meshes' vertices."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellforge.lineage import cut
from cellforge.functions.cells import morton
from cellforge.functions.vec import Vec

from .grid import densify, occupied, with_grid

#: Corner i of a cube is at (i & 1, i >> 1 & 1, i >> 2 & 1); the edges join corners that differ in one bit.
EDGES = [(a, a | 1 << k) for k in range(3) for a in range(8) if not a >> k & 1]


def _faces() -> list[list[int]]:
    """The corners of the six faces, each in the same turning sense seen from outside."""
    out = []
    for k in range(3):
        u, v = 1 << (k + 1) % 3, 1 << (k + 2) % 3
        ring = [0, u, u | v, v]
        out.append([(1 << k) | c for c in ring])
        out.append(ring[::-1])
    return out


@cache
def surface_table() -> tuple[tuple[int, int, int, int, int], ...]:
    """(config, triangle, edge, edge, edge) for every way the corners can be inside (bit set), derived by rule.

    On each face, every run of inside corners is cut off by a segment from the edge where the run ends to the one where
    it starts; equal edges chain the segments of the faces to closed loops, and a loop is a fan of triangles. Runs of a
    face with two opposite inside corners stay apart, on both cubes that share it, so the surface has no holes.
    """
    number = {frozenset(e): n for n, e in enumerate(EDGES)}
    rows = []
    for config in range(256):
        inside = lambda c: config >> c & 1
        follow = {}
        for ring in _faces():
            for i in range(4):
                a, b = ring[i], ring[(i + 1) % 4]
                if inside(a) and not inside(b):
                    j = i
                    while inside(ring[j]):
                        j = (j - 1) % 4
                    follow[number[frozenset((a, b))]] = number[frozenset((ring[j], ring[(j + 1) % 4]))]
        n = 0
        while follow:
            start = min(follow)
            loop = [start]
            at = follow.pop(start)
            while at != start:
                loop.append(at)
                at = follow.pop(at)
            for k in range(1, len(loop) - 1):
                rows.append((config, n, loop[0], loop[k + 1], loop[k]))
                n += 1
    return tuple(rows)


def pad_free(voxels: DataFrame, dims: tuple[int, int, int], free: int = 1) -> DataFrame:
    """All cells of the grid with a border of one FREE cell around it, moved by one; other empty cells are FREE too."""
    moved = with_grid(voxels).select("grid_id", *[(F.col(c) + 1).alias(c) for c in "xyz"], "value")
    return densify(moved, tuple(d + 2 for d in dims), free)


def cube_configs(labelled: DataFrame) -> DataFrame:
    """(grid_id, label, x, y, z, config) of every cube of eight cells that a label's surface may cross: one aggregation."""
    bits = F.array(*[F.struct(F.lit(c & 1).alias("ox"), F.lit(c >> 1 & 1).alias("oy"), F.lit(c >> 2 & 1).alias("oz"), F.lit(1 << c).alias("bit")) for c in range(8)])
    seen = occupied(with_grid(labelled)).select("grid_id", F.col("value").alias("label"), "x", "y", "z", F.explode(bits).alias("o"))
    return seen.groupBy("grid_id", "label", (F.col("x") - F.col("o.ox")).alias("x"), (F.col("y") - F.col("o.oy")).alias("y"), (F.col("z") - F.col("o.oz")).alias("z")).agg(F.sum("o.bit").cast("int").alias("config"))


def iso_triangles(labelled: DataFrame) -> DataFrame:
    """Triangles of every label's surface: (grid_id, label, x, y, z, tri, and corners ax..cz in half cells).

    The field is an indicator, so each vertex is the middle of a cube edge, exact in doubled integer coordinates. The
    triangle table has a few hundred rows and is broadcast.
    """
    spark = labelled.sparkSession
    edge = [[EDGES[e][0] >> k & 1 for k in range(3)] for e in range(12)]
    both = [[(EDGES[e][0] >> k & 1) + (EDGES[e][1] >> k & 1) for k in range(3)] for e in range(12)]
    assert all(abs(b - 2 * a) <= 1 for x, y in zip(edge, both) for a, b in zip(x, y))
    rows = [(c, t, *both[e0], *both[e1], *both[e2]) for c, t, e0, e1, e2 in surface_table()]
    names = ["config", "tri", *[f"o{v}{k}" for v in "abc" for k in "xyz"]]
    triangles = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    return cube_configs(labelled).where("config < 255").join(F.broadcast(triangles), "config").select(
        "grid_id", "label", "x", "y", "z", "tri", *[(2 * F.col(k) + F.col(f"o{v}{k}")).alias(f"{v}{k}") for v in "abc" for k in "xyz"]
    )


def fuse(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (grid_id, label, vertex_id, x, y, z) and faces (grid_id, label, v0, v1, v2) of triangle soup.

    A vertex is named by its doubled integer position, packed, so equal corners need no search and faces no join.
    """
    lead = 1 << 20
    key = lambda v: ((F.col(f"{v}x").cast("long") + 2) * lead + (F.col(f"{v}y") + 2)) * lead + (F.col(f"{v}z") + 2)
    faces = triangles.select("grid_id", "label", *[key(v).alias(f"v{n}") for n, v in enumerate("abc")])
    corners = triangles.select("grid_id", "label", F.explode(F.array(*[F.struct(key(v).alias("vertex_id"), *[(F.col(f"{v}{k}") / 2).alias(k) for k in "xyz"]) for v in "abc"])).alias("p"))
    return corners.select("grid_id", "label", "p.*").distinct(), faces


def fuse_sorted(points: DataFrame, eps: float, order: str = "code") -> DataFrame:
    """Points with `fused`, the ordinal of their merged vertex: in Morton order, one begins where the distance to the
    point before is over eps. Windows run within mesh_id."""
    w = Window.partitionBy("mesh_id").orderBy(order, "vertex_id")
    at, before = Vec.cols("x", "y", "z"), Vec(*[F.lag(c).over(w) for c in "xyz"])
    new = F.when(F.coalesce((at - before).length() > eps, F.lit(True)), 1).otherwise(0)
    return points.withColumn("fused", F.sum(new).over(w) - 1)


def dense_ids(vertices: DataFrame, by: list[str], key: str = "vertex_id") -> DataFrame:
    """The table with `id`, numbering the keys of each group from 0 without gaps."""
    return vertices.withColumn("id", F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1)


def corner_flags(faces: DataFrame, boundary_vertices: DataFrame) -> DataFrame:
    """Faces with `is_boundary`: whether one of their vertices is flagged."""
    flagged = boundary_vertices.select("mesh_id", F.col("vertex_id").alias("v")).distinct()
    corner = faces.select("mesh_id", "face_id", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    hit = corner.join(flagged, ["mesh_id", "v"], "left_semi").select("mesh_id", "face_id").distinct().withColumn("is_boundary", F.lit(True))
    return faces.join(hit, ["mesh_id", "face_id"], "left").withColumn("is_boundary", F.coalesce("is_boundary", F.lit(False)))


def laplacian(vertices: DataFrame, faces: DataFrame, rounds: int = 1, weight: float = 0.5, kind: bool | None = None, every: int = 5) -> DataFrame:
    """Vertices moved `rounds` times by `weight` towards the mean of their neighbours, once per shared face side.

    vertices: (mesh_id, vertex_id, x, y, z, is_boundary). With `kind`, only vertices of that flag move, and only faces
    all of whose corners have it count.
    """
    sides = F.array(*[F.struct(F.col(a).alias("vertex_id"), F.col(b).alias("other")) for a in ("v0", "v1", "v2") for b in ("v0", "v1", "v2") if a != b])
    if kind is not None:
        good = vertices.where(F.col("is_boundary") == kind).select("mesh_id", "vertex_id")
        for c in ("v0", "v1", "v2"):
            faces = faces.join(good.withColumnRenamed("vertex_id", c), ["mesh_id", c], "left_semi")
    links = faces.select("mesh_id", F.explode(sides).alias("s")).select("mesh_id", "s.*")
    for n in range(rounds):
        other = vertices.select("mesh_id", F.col("vertex_id").alias("other"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
        mean = links.join(other, ["mesh_id", "other"]).groupBy("mesh_id", "vertex_id").agg(*[F.avg(f"o{c}").alias(f"m{c}") for c in "xyz"])
        moves = F.col("mx").isNotNull() & (F.lit(True) if kind is None else F.col("is_boundary") == kind)
        vertices = vertices.join(mean, ["mesh_id", "vertex_id"], "left").select(
            "mesh_id", "vertex_id", *[F.when(moves, F.col(c) + (F.col(f"m{c}") - F.col(c)) * weight).otherwise(F.col(c)).alias(c) for c in "xyz"], "is_boundary"
        )
        if n % every == every - 1:
            vertices = cut(vertices)
    return vertices


def smooth_surface(vertices: DataFrame, faces: DataFrame, dims: tuple[int, int, int], fraction: float, weight: float = 0.5) -> DataFrame:
    """Laplacian smoothing of the interior and then of the boundary, `fraction` of the longest dimension rounds each."""
    rounds = max(1, int(max(dims) * fraction))
    return laplacian(laplacian(vertices, faces, rounds, weight, False), faces, rounds, weight, True)


def morton_codes(points: DataFrame) -> DataFrame:
    """Points with the Morton code of their cell."""
    return points.withColumn("code", morton(Vec.cols("x", "y", "z")))
