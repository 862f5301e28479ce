"""Labels on mesh faces: histograms, majority, borders, relabelling and border walks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellforge.functions.vec import EPSILON, Vec

from .spatial import label_points


def face_histogram(samples: DataFrame, labelled: DataFrame, lo: tuple, size: tuple, dims: tuple[int, int, int]) -> DataFrame:
    """(mesh_id, tri_id, label, share): share of each label among a face's surface samples."""
    points = samples.select(F.lit(0).cast("long").alias("grid_id"), "mesh_id", "tri_id", "x", "y", "z")
    counts = label_points(points, labelled, lo, size, dims).groupBy("mesh_id", "tri_id", "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("mesh_id", "tri_id"))
    return counts.select("mesh_id", "tri_id", "label", (F.col("n") / total).alias("share"))


def face_label(histogram: DataFrame) -> DataFrame:
    """(mesh_id, tri_id, label, is_boundary, shares): the most frequent label, the lowest of equals; boundary where there are several."""
    return histogram.groupBy("mesh_id", "tri_id").agg(
        F.max(F.struct(F.col("share"), (-F.col("label")).alias("minus"))).alias("best"), (F.count("*") > 1).alias("is_boundary"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "share")))).alias("shares")
    ).select("mesh_id", "tri_id", (-F.col("best.minus")).alias("label"), "is_boundary", "shares")


def vertex_clusters(faces: DataFrame) -> DataFrame:
    """(mesh_id, vertex_id, clusters): the labels of the faces around each vertex. faces: (mesh_id, face_id, v0, v1, v2, label)."""
    corner = faces.select("mesh_id", "label", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    return corner.groupBy("mesh_id", "vertex_id").agg(F.array_sort(F.collect_set("label")).alias("clusters"))


def border_faces(faces: DataFrame) -> DataFrame:
    """Faces with `is_border` (two or more corners whose faces have several labels) and `clusters`, the labels around them."""
    around = vertex_clusters(faces)
    corner = faces.select("mesh_id", "face_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    flags = corner.join(around, ["mesh_id", "vertex_id"]).groupBy("mesh_id", "face_id").agg(
        (F.count_if(F.size("clusters") > 1) >= 2).alias("is_border"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("clusters")))).alias("clusters")
    )
    return faces.join(flags, ["mesh_id", "face_id"])


def edge_neighbours(faces: DataFrame) -> DataFrame:
    """(mesh_id, face_id, other, label, other_label, nx..oz): each face with those across its edges; an edge join."""
    sides = F.array(*[F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    edge = faces.select("mesh_id", "face_id", "label", "nx", "ny", "nz", F.explode(sides).alias("e")).select("mesh_id", "e.p", "e.q", "face_id", "label", "nx", "ny", "nz")
    other = edge.select("mesh_id", "p", "q", F.col("face_id").alias("other"), F.col("label").alias("other_label"), *[F.col(f"n{k}").alias(f"o{k}") for k in "xyz"])
    return edge.join(other, ["mesh_id", "p", "q"]).where("face_id <> other").drop("p", "q")


def relabel_by_energy(faces: DataFrame, shares: DataFrame, smoothness: float, floor: float = 1e-6) -> DataFrame:
    """(mesh_id, face_id, label): one step of iterated conditional modes.

    For a face each label of itself and its neighbours costs -log of its share plus, for every neighbour of another
    label, `smoothness` times how flat the edge is; the cheapest label wins, the lowest of equals.
    shares: (mesh_id, face_id, label, share).
    """
    near = edge_neighbours(faces).withColumn("flat", (1 + F.col("nx") * F.col("ox") + F.col("ny") * F.col("oy") + F.col("nz") * F.col("oz")) / 2)
    options = near.select("mesh_id", "face_id", F.col("other_label").alias("option")).union(faces.select("mesh_id", "face_id", "label")).distinct()
    bends = options.join(near.select("mesh_id", "face_id", "other_label", "flat"), ["mesh_id", "face_id"], "left").groupBy("mesh_id", "face_id", "option").agg(
        F.sum(F.when(F.col("other_label") != F.col("option"), F.col("flat")).otherwise(0.0)).alias("bend")
    )
    own = shares.select("mesh_id", "face_id", F.col("label").alias("option"), "share")
    cost = bends.join(own, ["mesh_id", "face_id", "option"], "left").withColumn("cost", -F.log(F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(floor))) + smoothness * F.coalesce("bend", F.lit(0.0)))
    return cost.groupBy("mesh_id", "face_id").agg(F.min(F.struct("cost", "option")).alias("b")).select("mesh_id", "face_id", F.col("b.option").alias("label"))


def relabel_by_majority(faces: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(mesh_id, face_id, label): the most frequent label across a face's edges where its share is above the threshold."""
    counts = edge_neighbours(faces).groupBy("mesh_id", "face_id", "other_label").agg(F.count("*").alias("n"))
    best = counts.groupBy("mesh_id", "face_id").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("other_label")).alias("minus"))).alias("b"))
    return faces.select("mesh_id", "face_id", F.col("label").alias("old")).join(best, ["mesh_id", "face_id"], "left").select(
        "mesh_id", "face_id", F.when(F.col("b.n") / F.col("total") > threshold, -F.col("b.minus")).otherwise(F.col("old")).alias("label")
    )


def border_convexity(faces: DataFrame, centroids: DataFrame) -> DataFrame:
    """(mesh_id, face_id, other, convex): across borders between labels, whether the neighbour's centroid lies behind the face.

    centroids: (mesh_id, face_id, x, y, z).
    """
    near = edge_neighbours(faces).where("label <> other_label")
    a = centroids.select("mesh_id", "face_id", *[F.col(k).alias(f"a{k}") for k in "xyz"])
    b = centroids.select("mesh_id", F.col("face_id").alias("other"), *[F.col(k).alias(f"b{k}") for k in "xyz"])
    d = (Vec.cols("bx", "by", "bz") - Vec.cols("ax", "ay", "az")).dot(Vec.cols("nx", "ny", "nz"))
    return near.join(a, ["mesh_id", "face_id"]).join(b, ["mesh_id", "other"]).select("mesh_id", "face_id", "other", (d <= EPSILON).alias("convex"))


def most_probable(rows: DataFrame, by: list[str], label: str, probability: str) -> DataFrame:
    """The label of the highest probability of each group, the lowest of equals."""
    return rows.groupBy(*by).agg(F.max(F.struct(F.col(probability).alias("p"), (-F.col(label)).alias("m"))).alias("b")).select(*by, (-F.col("b.m")).alias(label))


def border_walk(adjacent: DataFrame) -> DataFrame:
    """(mesh_id, cluster, chain, position, face_id): border faces of each cluster in walking order, from the lowest face on.

    adjacent: (mesh_id, cluster, a, b). From a face the walk goes to the lowest neighbour not yet seen; where none is
    left a new chain starts at the lowest unseen face. A cluster's border is one group.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(rows["a"], rows["b"]):
            near.setdefault(int(a), set()).add(int(b))
            near.setdefault(int(b), set()).add(int(a))
        left, out, chain = set(near), [], 0
        for start in sorted(near):
            if start not in left:
                continue
            at, n = start, 0
            while at is not None:
                left.discard(at)
                out.append((key[0], key[1], chain, n, at))
                n += 1
                at = min((x for x in near[at] if x in left), default=None)
            chain += 1
        return pd.DataFrame(out, columns=["mesh_id", "cluster", "chain", "position", "face_id"])

    return adjacent.groupBy("mesh_id", "cluster").applyInPandas(run, "mesh_id long, cluster int, chain int, position int, face_id long")


def path_lengths(points: DataFrame, by: str, order: str) -> DataFrame:
    """Points of polylines with the length so far and as a share of the whole."""
    w = Window.partitionBy(by).orderBy(order)
    step = (Vec.cols("x", "y", "z") - Vec(*[F.lag(k).over(w) for k in "xyz"])).length()
    out = points.withColumn("step", F.coalesce(step, F.lit(0.0)))
    out = out.withColumn("length", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("share", F.col("length") / F.nullif(F.sum("step").over(Window.partitionBy(by)), F.lit(0.0))).drop("step")


def exclusive_sum(rows: DataFrame, by: str | None, order: list[str], value: str) -> DataFrame:
    """Rows with `before`, the sum of the values that precede them in their group."""
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def fill_forward(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows with nulls of a column replaced by the last value before."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


