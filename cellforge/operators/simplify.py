"""Quadric simplification of meshes by rounds of independent edge collapses, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellforge.functions.cells import noise
from cellforge.functions.vec import Vec
from cellforge.lineage import cut

from .scan import place_in_group

#: A vertex' quadric, the sum of its planes' squares: ten columns, as the matrix is symmetric.
TERMS = [a + b for n, a in enumerate("xyzw") for b in "xyzw"[n:]]
Q = [f"q{t}" for t in TERMS]
#: Digits by which costs are compared, so that sums in another order choose the same edges.
DIGITS = 9
#: Below this determinant the best point of an edge is one of its ends or its middle.
SINGULAR = 1e-6
#: Choices of independent edges in a round, each among what the ones before leave free.
PASSES = 3
#: A face turns over if the cosine between its old and new normal is at most this.
TURNS = 0.2


def corners(faces: DataFrame) -> DataFrame:
    """(mesh_id, face_id, v, u, w): each face from each of its vertices, in its own direction."""
    v = ("v0", "v1", "v2")
    turned = [F.struct(*(F.col(v[(k + n) % 3]).alias(c) for n, c in enumerate("vuw"))) for k in range(3)]
    return faces.select("mesh_id", "face_id", F.explode(F.array(*turned)).alias("t")).select("mesh_id", "face_id", "t.*")


def _at(vertices: DataFrame, name: str, more: list[str] = []) -> DataFrame:
    """Vertices under another name: (mesh_id, name, namex, namey, namez, and `more` after the name)."""
    return vertices.select("mesh_id", F.col("vertex_id").alias(name), *[F.col(c).alias(f"{name}{c}") for c in ("x", "y", "z", *more)])


def quadrics(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The vertices with their quadrics, from the unit normals of the faces around them; faces without area have no plane."""
    tri = faces
    for n, c in enumerate("abc"):
        tri = tri.join(_at(vertices, c).withColumnRenamed(c, f"v{n}"), ["mesh_id", f"v{n}"])
    a = Vec.cols("ax", "ay", "az")
    normal = (Vec.cols("bx", "by", "bz") - a).cross(Vec.cols("cx", "cy", "cz") - a).unit()
    plane = tri.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), *normal.named("p"), (-normal.dot(a)).alias("pw"))
    sums = plane.groupBy("mesh_id", "vertex_id").agg(*[F.sum(F.col(f"p{t[0]}") * F.col(f"p{t[1]}")).alias(f"q{t}") for t in TERMS])
    return vertices.select("mesh_id", "vertex_id", "x", "y", "z").join(sums, ["mesh_id", "vertex_id"], "left").select("mesh_id", "vertex_id", "x", "y", "z", *[F.coalesce(q, F.lit(0.0)).alias(q) for q in Q])


def quadric_error(q: dict[str, Column], p: Vec) -> Column:
    """Sum of the squared distances of a point from the planes of a quadric."""
    at = {"x": p.x, "y": p.y, "z": p.z, "w": F.lit(1.0)}
    return sum((q[t] * at[t[0]] * at[t[1]] * (1 if t[0] == t[1] else 2) for t in TERMS[1:]), q["xx"] * p.x * p.x)


def best_point(q: dict[str, Column], ends: list[Vec], inner: Column) -> Column:
    """(cost, x, y, z) of the best of the two ends, their middle and, for an inner edge, the point of least error.

    The last is the solution of three linear equations by determinants. Costs are compared by DIGITS digits; of equal ones
    the first counts, in this order: ends, middle, least point.
    """
    rows = [[q["xx"], q["xy"], q["xz"]], [q["xy"], q["yy"], q["yz"]], [q["xz"], q["yz"], q["zz"]]]
    right = [-q["xw"], -q["yw"], -q["zw"]]

    def det(m: list[list[Column]]) -> Column:
        (a, b, c), (d, e, f), (g, h, i) = m
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = det(rows)
    some = inner & (F.abs(whole) > SINGULAR)
    least = Vec(*(F.when(some, det([[right[r] if k == n else x for k, x in enumerate(row)] for r, row in enumerate(rows)]) / whole) for n in range(3)))
    found = [*ends, (ends[0] + ends[1]) * 0.5, least]
    cost = lambda p: F.round(quadric_error(q, p), DIGITS) + F.lit(0.0)
    choice = lambda n, p: F.struct(cost(p).alias("cost"), F.lit(n).alias("n"), *(c.alias(k) for k, c in zip("xyz", p)))
    choices = [F.when(some, choice(n, p)) if n == 3 else choice(n, p) for n, p in enumerate(found)]
    return F.least(*choices)  # nulls do not count


def collapses(vertices: DataFrame, faces: DataFrame, share: float | None = None, passes: int = 1) -> DataFrame:
    """(mesh_id, a, b, cost, key, x, y, z): edges that may collapse together, b into a, which then lies at (x, y, z).

    `vertices` carry their quadrics. An edge may collapse if both its ends lie on a border or neither does (and a border edge
    is a border's own), if its ends have no neighbours in common but those of its faces, if no two faces would fall on each other, and if no face around it turns over.
    With `share`, only the cheapest such share of a mesh's edges is looked at. Of the edges that may, one goes if it comes first (by cost, then a
    number made of its ends) among all edges that touch its ends or their neighbours; so no face has two moving vertices, and the
    tests of one collapse hold whatever the others do. Each further one of the `passes` chooses in the same way among the
    edges that touch nothing chosen so far, nor its neighbours.
    """
    around = corners(faces)
    edge = around.select("mesh_id", F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).groupBy("mesh_id", "a", "b").agg(F.count("*").alias("n_faces"))
    rim = edge.where("n_faces <> 2").select("mesh_id", F.explode(F.array("a", "b")).alias("v")).distinct()
    placed = vertices.join(rim.select("mesh_id", F.col("v").alias("vertex_id"), F.lit(True).alias("rim")), ["mesh_id", "vertex_id"], "left").withColumn("rim", F.coalesce("rim", F.lit(False)))
    both = edge.join(_at(placed, "a", ["rim", *Q]), ["mesh_id", "a"]).join(_at(placed, "b", ["rim", *Q]), ["mesh_id", "b"])
    both = both.where("arim = brim and n_faces = if(arim, 1, 2)")
    q = {t: F.col(f"aq{t}") + F.col(f"bq{t}") for t in TERMS}
    best = best_point(q, [Vec.cols("ax", "ay", "az"), Vec.cols("bx", "by", "bz")], ~F.col("arim"))
    key = noise(Vec(*(F.pmod(c, F.lit(2147483647)) for c in ("a", "b")), F.lit(1)))  # ids may have all 64 bits
    able = both.select("mesh_id", "a", "b", "n_faces", key.alias("key"), best.alias("p")).select("mesh_id", "a", "b", "n_faces", "p.cost", "key", "p.x", "p.y", "p.z")
    able = cut(able)
    if share is not None and share < 1:
        most = able.groupBy("mesh_id").agg(F.percentile_approx("cost", share).alias("most"))
        able = able.join(most, "mesh_id").where("cost <= most").drop("most")

    # what a collapse would do to the faces around its ends, but for those that go with the edge
    ends = able.select("mesh_id", "a", "b", "x", "y", "z", F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("other")), F.struct(F.col("b").alias("v"), F.col("a").alias("other")))).alias("e"))
    ends = ends.select("mesh_id", "a", "b", "x", "y", "z", "e.v", "e.other")
    ring = around
    for c in "vuw":
        ring = ring.join(_at(vertices, c), ["mesh_id", c])
    seen = ends.join(ring, ["mesh_id", "v"]).where("u <> other and w <> other")
    u, w = Vec.cols("ux", "uy", "uz"), Vec.cols("wx", "wy", "wz")
    normal = lambda p: (u - p).cross(w - p)
    old, new = normal(Vec.cols("vx", "vy", "vz")), normal(Vec.cols("x", "y", "z"))
    turns = old.dot(new) <= F.sqrt(old.length2() * new.length2()) * TURNS + 1e-12
    turned = seen.where(turns).select("mesh_id", "a", "b").distinct()
    near = cut(around.select("mesh_id", "v", F.explode(F.array("u", "w")).alias("near")).distinct())
    common = (
        able.select("mesh_id", "a", "b", "n_faces").join(near.select("mesh_id", F.col("v").alias("a"), "near"), ["mesh_id", "a"])
        .join(near.select("mesh_id", F.col("v").alias("b"), "near"), ["mesh_id", "b", "near"], "left_semi")
        .groupBy("mesh_id", "a", "b", "n_faces").agg(F.count("*").alias("n")).where("n <> n_faces").select("mesh_id", "a", "b")
    )
    # faces that would fall on each other: with a and with b to the same other two corners, as in a tetrahedron
    facing = around.select("mesh_id", "v", F.least("u", "w").alias("p"), F.greatest("u", "w").alias("q"))
    folded = (
        able.select("mesh_id", "a", "b").join(facing.withColumnRenamed("v", "a"), ["mesh_id", "a"])
        .join(facing.withColumnRenamed("v", "b"), ["mesh_id", "b", "p", "q"], "left_semi").select("mesh_id", "a", "b")
    )
    able = cut(able.join(turned.union(common).union(folded), ["mesh_id", "a", "b"], "left_anti"))

    chosen = None
    for n in range(passes):
        first = _first(able, near) if n + 1 == passes else cut(_first(able, near))
        chosen = first if chosen is None else chosen.union(first)
        if n + 1 < passes:
            moving = first.select("mesh_id", F.explode(F.array("a", "b")).alias("v"))
            shut = moving.union(near.join(moving, ["mesh_id", "v"]).select("mesh_id", "near")).distinct()
            for c in "ab":
                able = able.join(shut.withColumnRenamed("v", c), ["mesh_id", c], "left_anti")
            able = cut(able)
    return chosen.select("mesh_id", "a", "b", "n_faces", "cost", "key", "x", "y", "z")


def _first(able: DataFrame, near: DataFrame) -> DataFrame:
    """The edges that come first among all that touch their ends or the neighbours of these."""
    rank = F.struct("cost", "key", "a", "b")
    own = able.select("mesh_id", rank.alias("r"), F.explode(F.array("a", "b")).alias("v")).groupBy("mesh_id", "v").agg(F.min("r").alias("r"))
    wide = own.union(near.join(own, ["mesh_id", "v"]).select("mesh_id", F.col("near").alias("v"), "r")).groupBy("mesh_id", "v").agg(F.min("r").alias("r"))
    at = lambda c: wide.select("mesh_id", F.col("v").alias(c), F.col("r").alias(f"r{c}"))
    first = able.join(at("a"), ["mesh_id", "a"]).join(at("b"), ["mesh_id", "b"]).where((rank == F.col("ra")) & (rank == F.col("rb")))
    return first.select(*able.columns)


def collapse(vertices: DataFrame, faces: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mesh after independent collapses: b's faces go over to a, faces that have both are gone, quadrics add up."""
    gone = vertices.select("mesh_id", F.col("vertex_id").alias("b"), *[F.col(q).alias(f"b{q}") for q in Q])
    moved = chosen.select("mesh_id", F.col("a").alias("vertex_id"), "b", *[F.col(c).alias(f"n{c}") for c in "xyz"]).join(gone, ["mesh_id", "b"])
    kept = vertices.join(chosen.select("mesh_id", F.col("b").alias("vertex_id")), ["mesh_id", "vertex_id"], "left_anti").join(moved, ["mesh_id", "vertex_id"], "left")
    v = kept.select("mesh_id", "vertex_id", *[F.coalesce(f"n{c}", c).alias(c) for c in "xyz"], *[(F.col(q) + F.coalesce(f"b{q}", F.lit(0.0))).alias(q) for q in Q])
    f = faces
    for c in ("v0", "v1", "v2"):
        to = chosen.select("mesh_id", F.col("b").alias(c), F.col("a").alias("to"))
        f = f.join(to, ["mesh_id", c], "left").withColumn(c, F.coalesce("to", c)).drop("to")
    f = f.where("v0 <> v1 and v1 <> v2 and v2 <> v0").select("mesh_id", "face_id", "v0", "v1", "v2")
    return cut(v), cut(f)


def simplified(vertices: DataFrame, faces: DataFrame, target: int, share: float = 0.5, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """(vertices with their quadrics, faces) after collapses to `target` faces a mesh; meshes at or below it stay.

    Each round collapses a set of independent edges (see collapses), the cheaper half of a mesh first, in joins and aggregates by mesh
    and vertex, so a mesh is spread over tasks like any other rows. The last round of a mesh takes only as many edges as are needed,
    the cheapest. A mesh of which no edge may collapse any more stays above the target. Rounds grow with the logarithm of the
    faces over the target.
    """
    v = cut(quadrics(vertices, faces))
    f = cut(faces.select("mesh_id", "face_id", "v0", "v1", "v2"))
    part = share
    for _ in range(max_rounds):
        sizes = f.groupBy("mesh_id").agg(F.count("*").alias("faces"))
        over = cut(sizes.where(F.col("faces") > target).withColumn("need", F.col("faces") - target))
        if over.isEmpty():
            break
        open_v, open_f = (x.join(over, "mesh_id", "left_semi") for x in (v, f))
        chosen = cut(collapses(open_v, open_f, part, PASSES))
        many = chosen.groupBy("mesh_id").agg(F.sum("n_faces").alias("n")).join(over, "mesh_id").where("n > need").select("mesh_id", "need")
        if chosen.isEmpty():
            if part >= 1:
                break
            part = 1.0
            continue
        part = share
        if not many.isEmpty():
            # an edge takes n_faces with it, so the first need / 2 edges (rounded up) reach the target, or more on a border
            places = place_in_group(chosen, "mesh_id", ["cost", "key", "a", "b"])
            chosen = places.join(over, "mesh_id").where("2 * place < need").select(*chosen.columns)
        v, f = collapse(v, f, cut(chosen))
    else:
        raise RuntimeError(f"the simplification did not end in {max_rounds} rounds")
    return v, f
