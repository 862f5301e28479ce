"""Triangle meshes as vertex and face tables: sampling, normals, topology, subdivision, simplification, voxelization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellforge.lineage import cut
from cellforge.functions.cells import cell_of, noise
from cellforge.functions.geometry import point_in_triangle, triangle_area, triangle_box, triangle_normal
from cellforge.functions.vec import Vec

from .scan import least_of_groups, place_in_group
from .simplify import simplified
from .spatial import A, B, C, column_hits


def triangles_of(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, tri_id, ax..cz) from faces and the vertices they name."""
    out = faces.select("mesh_id", F.col("face_id").alias("tri_id"), "v0", "v1", "v2")
    for n, p in enumerate("abc"):
        v = vertices.select("mesh_id", F.col("vertex_id").alias(f"v{n}"), *[F.col(k).alias(f"{p}{k}") for k in "xyz"])
        out = out.join(v, ["mesh_id", f"v{n}"])
    return out.select("mesh_id", "tri_id", *[f"{p}{k}" for p in "abc" for k in "xyz"])


def areas(triangles: DataFrame) -> DataFrame:
    return triangles.withColumn("area", triangle_area(A, B, C))


def area_summary(triangles: DataFrame) -> DataFrame:
    return areas(triangles).groupBy("mesh_id").agg(F.count("*").alias("faces"), F.sum("area").alias("total"), F.max("area").alias("largest"))


def _pair(key: F, n, seed: int) -> tuple:
    return noise(Vec.of(key, n, F.lit(1)), seed), noise(Vec.of(key, n, F.lit(2)), seed)


def sample_surface(triangles: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(mesh_id, tri_id, k, x, y, z): n points on each mesh's surface, by area.

    With more points than faces each face gives ceil(area share * n), at least one, and n of them all are kept by a
    hash; otherwise n faces are drawn by a hash and give one point each. Numbers depend on the face, k and the seed.
    """
    sized = areas(triangles).join(area_summary(triangles).select("mesh_id", "faces", "total"), "mesh_id")
    count = F.when(F.col("faces") < n, F.greatest(F.ceil(F.col("area") / F.col("total") * n), F.lit(1))).otherwise(1).cast("int")
    each = sized.withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    u, v = _pair(F.col("tri_id"), F.col("k"), seed)
    at = point_in_triangle(A, B, C, u, v)
    points = each.select("mesh_id", "tri_id", "k", *at.named(""))
    return least_of_groups(points, "mesh_id", noise(Vec.of(F.col("tri_id"), F.col("k"), F.lit(5)), seed), ["tri_id", "k"], n)


def surface_cells(triangles: DataFrame, n: int, lo: tuple, size: tuple, dims: tuple[int, int, int], seed: int = 0) -> DataFrame:
    """Cells that hold one of n surface samples of a mesh, as FREE voxels."""
    c = cell_of(Vec.cols("x", "y", "z"), Vec.of(*map(float, lo)), Vec.of(*map(float, size)), dims)
    return sample_surface(triangles, n, seed).select(F.col("mesh_id").alias("grid_id"), *c.named("")).distinct().withColumn("value", F.lit(1))


def bin_points(points: DataFrame, lo: tuple, size: tuple, dims: tuple[int, int, int], value: str) -> DataFrame:
    """(grid_id, x, y, z, total, n): sum and count of a value over the points of each cell."""
    c = cell_of(Vec.cols("x", "y", "z"), Vec.of(*map(float, lo)), Vec.of(*map(float, size)), dims)
    return points.select(F.col("cloud_id").alias("grid_id"), *c.named(""), F.col(value).alias("v")).groupBy("grid_id", "x", "y", "z").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def solid_cells(triangles: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Cells whose centre lies inside each closed mesh, as FREE voxels (grid_id is the mesh id; cells have unit size).

    Lines along z through cell centres meet the surface; sorted crossings pair up, and the cells between a pair fill.
    Only crossings are shuffled, not cells, and each line is a group of its own.
    """
    hits = column_hits(triangles, 2, dims)
    line = Window.partitionBy("mesh_id", "a", "b").orderBy("t")
    spans = hits.withColumn("k", F.row_number().over(line)).withColumn("to", F.lead("t").over(line)).where("k % 2 = 1 and to is not null")
    first = F.greatest(F.ceil(F.col("t") - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.col("to") - 0.5) - 1, F.lit(dims[2] - 1)).cast("int")
    return spans.withColumn("f", first).withColumn("l", last).where("f <= l").select(F.col("mesh_id").alias("grid_id"), F.col("a").alias("x"), F.col("b").alias("y"), F.explode(F.sequence("f", "l")).alias("z"), F.lit(1).alias("value")).distinct()


# normals and topology


def face_normals(triangles: DataFrame) -> DataFrame:
    return triangles.select("mesh_id", "tri_id", *triangle_normal(A, B, C).named("n"))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, vertex_id, nx, ny, nz): unit mean of the normals of the faces around each vertex."""
    n = face_normals(triangles_of(vertices, faces))
    corner = faces.select("mesh_id", F.col("face_id").alias("tri_id"), F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    mean = corner.join(n, ["mesh_id", "tri_id"]).groupBy("mesh_id", "vertex_id").agg(*[F.avg(f"n{k}").alias(f"m{k}") for k in "xyz"])
    return mean.select("mesh_id", "vertex_id", *Vec.cols("mx", "my", "mz").unit().named("n"))


def tangents(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, vertex_id, tx, ty, tz): tangents along u, summed over faces and made square to the normal.

    vertices: (mesh_id, vertex_id, x, y, z, u, v, nx, ny, nz).
    """
    at = faces.select("mesh_id", "v0", "v1", "v2")
    for n in range(3):
        at = at.join(vertices.select("mesh_id", F.col("vertex_id").alias(f"v{n}"), *[F.col(k).alias(f"p{k}{n}") for k in "xyzuv"]), ["mesh_id", f"v{n}"])
    p = [Vec.cols(*[f"p{k}{n}" for k in "xyz"]) for n in range(3)]
    e1, e2 = p[1] - p[0], p[2] - p[0]
    du1, dv1, du2, dv2 = F.col("pu1") - F.col("pu0"), F.col("pv1") - F.col("pv0"), F.col("pu2") - F.col("pu0"), F.col("pv2") - F.col("pv0")
    det = du1 * dv2 - du2 * dv1
    t = (e1 * dv2 - e2 * dv1).map(lambda c: F.when(det != 0, c / det).otherwise(0.0))
    corner = at.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), *t.named("t"))
    total = corner.groupBy("mesh_id", "vertex_id").agg(*[F.sum(f"t{k}").alias(f"s{k}") for k in "xyz"])
    n, s = Vec.cols("nx", "ny", "nz"), Vec.cols("sx", "sy", "sz")
    return total.join(vertices.select("mesh_id", "vertex_id", "nx", "ny", "nz"), ["mesh_id", "vertex_id"]).select("mesh_id", "vertex_id", *(s - n * n.dot(s)).unit().named("t"))


def face_boxes(triangles: DataFrame) -> DataFrame:
    """Box and normal of every face."""
    lo, hi = triangle_box(A, B, C)
    return triangles.select("mesh_id", "tri_id", *lo.named("min_"), *hi.named("max_"), *triangle_normal(A, B, C).named("n"))


def unique_edges(faces: DataFrame) -> DataFrame:
    """Undirected edges, each once."""
    pairs = F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    return faces.select("mesh_id", F.explode(pairs).alias("e")).select("mesh_id", "e.a", "e.b").distinct()


def index_list(faces: DataFrame) -> DataFrame:
    """Corner indices in face order, the restart sentinel after each face: (mesh_id, position, vertex_id)."""
    return place_in_group(faces.select("mesh_id", "face_id", "v0", "v1", "v2"), "mesh_id", ["face_id"], "n").select("mesh_id", "n", F.posexplode(F.array("v0", "v1", "v2", F.lit(0xFFFFFFF).cast("long"))).alias("k", "vertex_id")).select("mesh_id", (F.col("n").cast("long") * 4 + F.col("k")).alias("position"), "vertex_id")


def join_parts(vertices: DataFrame, faces: DataFrame, part: str = "part_id") -> tuple[DataFrame, DataFrame]:
    """The parts of each mesh as one: ids move by the number of vertices, or faces, of the parts before. Ids count from 0 in each part."""

    def offsets(df: DataFrame) -> DataFrame:
        before = Window.partitionBy("mesh_id").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        return df.groupBy("mesh_id", part).agg(F.count("*").alias("n")).select("mesh_id", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))

    v, f = offsets(vertices), offsets(faces)
    rest = [c for c in vertices.columns if c not in ("mesh_id", part, "vertex_id")]
    return vertices.join(v, ["mesh_id", part]).select("mesh_id", (F.col("vertex_id") + F.col("o")).alias("vertex_id"), *rest), _faces_moved(faces, v, f, part)


def _faces_moved(faces: DataFrame, by_vertex: DataFrame, by_face: DataFrame, part: str) -> DataFrame:
    both = faces.join(by_vertex.withColumnRenamed("o", "ov"), ["mesh_id", part]).join(by_face.withColumnRenamed("o", "of"), ["mesh_id", part])
    return both.select("mesh_id", (F.col("face_id") + F.col("of")).alias("face_id"), *[(F.col(c) + F.col("ov")).alias(c) for c in ("v0", "v1", "v2")])


def remap(faces: DataFrame, mapping: DataFrame) -> DataFrame:
    """Faces with vertices renamed by (mesh_id, old, new); faces that become degenerate go."""
    for c in ("v0", "v1", "v2"):
        m = mapping.select("mesh_id", F.col("old").alias(c), F.col("new").alias(f"n_{c}"))
        faces = faces.join(m, ["mesh_id", c], "left").withColumn(c, F.coalesce(f"n_{c}", c)).drop(f"n_{c}")
    return faces.select("mesh_id", "face_id", "v0", "v1", "v2").where("v0 <> v1 and v1 <> v2 and v2 <> v0")


def merge_equal_vertices(vertices: DataFrame, step: float) -> DataFrame:
    """(mesh_id, old, new): each vertex and the least one in its cell of side `step`."""
    cell = [F.floor(F.col(k) / step).alias(f"c{k}") for k in "xyz"]
    placed = vertices.select("mesh_id", F.col("vertex_id").alias("old"), *cell)
    least = placed.groupBy("mesh_id", "cx", "cy", "cz").agg(F.min("old").alias("new"))
    return placed.join(least, ["mesh_id", "cx", "cy", "cz"]).select("mesh_id", "old", "new")


def pick_faces(faces: DataFrame, ids: DataFrame) -> DataFrame:
    return faces.join(ids, ["mesh_id", "face_id"], "left_semi")


def planar_mesh(spark: SparkSession, nx: int, ny: int, width: float = 1.0, depth: float = 1.0, mesh_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """A flat mesh of nx by ny tiles, two faces each, as vertices and faces."""
    v = spark.range((nx + 1) * (ny + 1)).select(
        F.lit(mesh_id).cast("long").alias("mesh_id"), F.col("id").alias("vertex_id"), (F.floor(F.col("id") / (ny + 1)) * (width / nx) - width / 2).alias("x"), F.lit(0.0).alias("y"),
        (F.col("id") % (ny + 1) * (depth / ny) - depth / 2).alias("z"), (F.floor(F.col("id") / (ny + 1)) / nx).alias("u"), (F.col("id") % (ny + 1) / ny).alias("v"),
    )
    base = F.floor(F.col("id") / ny) * (ny + 1) + F.col("id") % ny
    two = F.array(F.struct(base.alias("v0"), (base + 1).alias("v1"), (base + ny + 1).alias("v2")), F.struct((base + 1).alias("v0"), (base + ny + 2).alias("v1"), (base + ny + 1).alias("v2")))
    f = spark.range(nx * ny).select("id", F.posexplode(two).alias("k", "t")).select(F.lit(mesh_id).cast("long").alias("mesh_id"), (F.col("id") * 2 + F.col("k")).alias("face_id"), "t.v0", "t.v1", "t.v2")
    return v, f


def subdivide(triangles: DataFrame, largest: float, max_rounds: int = 32) -> DataFrame:
    """Triangles halved at the middle of their longest edge until none is larger than `largest`; ids are paths of halves."""
    from cellforge.functions.geometry import longest_edge

    todo = triangles.select("mesh_id", F.col("tri_id").cast("string").alias("path"), *[f"{p}{k}" for p in "abc" for k in "xyz"])
    done = None
    for n in range(max_rounds):
        small = triangle_area(A, B, C) <= largest
        part = todo.where(small)
        done = part if done is None else done.union(part)
        todo = todo.where(~small).withColumn("e", longest_edge(A, B, C))
        p = [A, B, C]

        def pick(shift: int) -> Vec:
            return Vec(*[F.when(F.col("e") == 0, list(p[shift % 3])[k]).when(F.col("e") == 1, list(p[(1 + shift) % 3])[k]).otherwise(list(p[(2 + shift) % 3])[k]) for k in range(3)])

        a, b, c = pick(0), pick(1), pick(2)
        mid = (a + b) / 2
        half = lambda i, x, y, z: F.struct(F.concat("path", F.lit(f".{i}")).alias("path"), *x.named("a"), *y.named("b"), *z.named("c"))
        todo = todo.select("mesh_id", F.explode(F.array(half(0, mid, b, c), half(1, mid, a, c))).alias("t")).select("mesh_id", "t.*")
        if n % 4 == 3:
            todo, done = cut(todo), cut(done)
            if todo.isEmpty():
                return done
    if not todo.isEmpty():
        raise RuntimeError(f"triangles stay above the limit after {max_rounds} rounds")
    return done


# simplification


def simplify(vertices: DataFrame, faces: DataFrame, target: int) -> DataFrame:
    """Triangles of each mesh after quadric simplification to `target` faces (see simplify.simplified); tri_id is the face's."""
    return triangles_of(*simplified(vertices, faces, target))


def signed_volume(triangles: DataFrame) -> DataFrame:
    """Volume that each closed mesh encloses; positive where normals point outwards."""
    return triangles.groupBy("mesh_id").agg((F.sum(A.dot(B.cross(C))) / 6).alias("volume"))
