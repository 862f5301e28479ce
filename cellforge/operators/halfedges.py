"""Half-edge tables of meshes, and border lines by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.lineage import cut


def half_edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, h, face_id, v, u, next, twin, manifold): a row for each side of each face, from v to u.

    h is 3 * face_id + the side's place; `next` follows in the face, `twin` is the side of the neighbouring face the other way
    round, null at a border. An edge that is not shared by two faces in opposite directions, or alone on a border, is not manifold: its sides have no
    twin. One aggregate by undirected edge finds the twins, whatever the number of faces around an edge.
    """
    sides = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("v"), F.col(f"v{(k + 1) % 3}").alias("u")) for k in range(3)])
    s = faces.select("mesh_id", "face_id", F.explode(sides).alias("s")).select("mesh_id", "face_id", "s.*")
    at = F.col("face_id") * 3
    s = s.select("mesh_id", (at + F.col("k")).alias("h"), "face_id", "v", "u", (at + (F.col("k") + 1) % 3).alias("next"), F.least("v", "u").alias("lo"), F.greatest("v", "u").alias("hi"), (F.col("v") < F.col("u")).alias("up"))
    pair = s.groupBy("mesh_id", "lo", "hi").agg(F.count("*").alias("n"), F.count_if("up").alias("n_up"), F.max(F.when(F.col("up"), F.col("h"))).alias("h_up"), F.max(F.when(~F.col("up"), F.col("h"))).alias("h_down"))
    two = (F.col("n") == 2) & (F.col("n_up") == 1)
    twin = F.when(two, F.when(F.col("up"), F.col("h_down")).otherwise(F.col("h_up")))
    return s.join(pair, ["mesh_id", "lo", "hi"]).select("mesh_id", "h", "face_id", "v", "u", "next", twin.alias("twin"), (two | (F.col("n") == 1)).alias("manifold"))


def faces_of(edges: DataFrame) -> DataFrame:
    """(mesh_id, face_id, v0, v1, v2): the faces of a half-edge table, each from its first side on."""
    corner = lambda k: F.max(F.when(F.col("h") % 3 == k, F.col("v"))).alias(f"v{k}")
    return edges.groupBy("mesh_id", "face_id").agg(*map(corner, range(3)))


def _doubled(links: DataFrame, more, done: str, max_rounds: int = 64) -> DataFrame:
    """`links` (mesh_id, h, to, ...) after pointer doubling: in each round h's link goes on to where `to`'s link leads, and `more`
    merges the other columns, until no row is left for which `done` is false."""
    rest = [c for c in links.columns if c not in ("mesh_id", "h", "to")]
    links = cut(links)
    for _ in range(max_rounds):
        if links.where(f"not ({done})").isEmpty():
            return links
        on = links.select("mesh_id", F.col("h").alias("to"), F.col("to").alias("to2"), *[F.col(c).alias(f"{c}2") for c in rest])
        links = cut(links.join(on, ["mesh_id", "to"]).select("mesh_id", "h", F.col("to2").alias("to"), *more))
    raise RuntimeError(f"the links did not end in {max_rounds} rounds")


def border_loops(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(mesh_id, cluster, loop, position, vertex_id, h): the border lines of each cluster of faces, as closed lines of sides.

    `labels` gives (mesh_id, face_id, cluster); without it a mesh is one cluster, 0. A side is a border if it has no twin or its twin's
    face is of another cluster. The side after it on the border is found by turning about its end through the cluster's faces;
    the line is named by its least side and counted from there. Turning, the least side and the places are each found by pointer
    doubling: every side follows its link, then its link's link and so on, in rounds that grow with the logarithm of the line, without a task for
    a cluster or a line.
    """
    e = edges.join(labels, ["mesh_id", "face_id"]) if labels is not None else edges.withColumn("cluster", F.lit(0))
    across = e.select("mesh_id", F.col("h").alias("twin"), F.col("cluster").alias("far"), F.col("next").alias("after_twin"))
    e = cut(e.join(across, ["mesh_id", "twin"], "left").withColumn("rim", F.col("far").isNull() | (F.col("far") != F.col("cluster"))))
    # where one arrives from a side by turning until a border comes
    turn = e.select("mesh_id", "h", F.when(F.col("rim"), F.col("h")).otherwise(F.col("after_twin")).alias("to"))
    rims = e.where("rim").select("mesh_id", F.col("h").alias("to"), F.lit(True).alias("at_rim"))
    asked = e.where("rim").select("mesh_id", F.col("next").alias("h"), F.lit(True).alias("asked"))
    turn = turn.join(rims, ["mesh_id", "to"], "left").join(asked, ["mesh_id", "h"], "left").select("mesh_id", "h", "to", F.coalesce("at_rim", F.lit(False)).alias("there"), F.coalesce("asked", F.lit(False)).alias("asked"))
    # about a point inside a cluster one would turn for ever, but a turn that starts behind a border ends at one
    turned = _doubled(turn, [F.col("there2").alias("there"), "asked"], "there or not asked").where("asked").select("mesh_id", F.col("h").alias("next"), F.col("to").alias("after"))
    line = cut(e.where("rim").join(turned, ["mesh_id", "next"]).select("mesh_id", "cluster", "h", "v", "after"))
    # the least side of each line: windows of 1, 2, 4, ... sides, until no window changes what a side knows
    least = line.select("mesh_id", "h", F.col("after").alias("to"), F.least("h", "after").alias("loop"), F.lit(False).alias("same"))
    least = _doubled(least, [F.least("loop", "loop2").alias("loop"), (F.col("loop") <= F.col("loop2")).alias("same")], "same")
    # places: back along the line to its least side, which leads to itself
    back = line.select("mesh_id", F.col("after").alias("h"), F.col("h").alias("before")).join(least.select("mesh_id", "h", "loop"), ["mesh_id", "h"])
    first = F.col("h") == F.col("loop")
    back = back.select("mesh_id", "h", F.when(first, F.col("h")).otherwise(F.col("before")).alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("position"), "loop")
    placed = _doubled(back, [(F.col("position") + F.col("position2")).alias("position"), "loop"], "to = loop")
    return line.join(placed, ["mesh_id", "h"]).select("mesh_id", "cluster", "loop", "position", F.col("v").alias("vertex_id"), "h")
