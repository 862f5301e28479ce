"""Traversal of the tree of boxes against all pairs, and the nodes that rays visit."""

import random

import pytest
from pyspark.sql import functions as F

from cellforge.operators import tree
from cellforge.operators.spatial import A, B, C, D, O, ray_triangle

TRI = "tri_id long, " + ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz")
RAY = "ray_id long, " + ", ".join(f"{p}{k} double" for p in "od" for k in "xyz")


def nearest(rays, triangles):
    t, _, _ = ray_triangle(O, D, A, B, C)
    hits = rays.crossJoin(triangles).select("ray_id", "tri_id", t.alias("t")).where("t is not null")
    return {r.ray_id: (r.h.t, r.h.tri_id) for r in hits.groupBy("ray_id").agg(F.min(F.struct("t", "tri_id")).alias("h")).collect()}


@pytest.mark.parametrize("small", [1 << 15, 1])
def test_hits_equal_all_pairs(spark, monkeypatch, small):
    """Small triangles with gaps, so that the first path of many rays meets nothing; copies of a triangle tie."""
    monkeypatch.setattr(tree, "SMALL_LEVEL", small)
    random.seed(small)
    rows = []
    for i in range(1500):
        c = [random.uniform(0, 10) for _ in range(3)]
        rows.append((i, *[x + random.gauss(0, 0.25) for _ in range(3) for x in c]))
    rows += [(2000 + r[0], *r[1:]) for r in rows[:50]] + [(5000, *[1.0] * 9), (5001, 2.0, 2.0, 5.0, 8.0, 2.0, 5.0, 2.0, 8.0, 5.0)]
    rays = [(i, *[random.uniform(-3, 13) for _ in range(3)], *[random.gauss(0, 1) for _ in range(3)]) for i in range(150)]
    rays += [(900 + k, *[5.0 if j != k else -1.0 for j in range(3)], *[1.0 if j == k else 0.0 for j in range(3)]) for k in range(3)] + [(990, 50.0, 50.0, 50.0, 1.0, 1.0, 1.0), (991, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    triangles, rays = spark.createDataFrame(rows, TRI), spark.createDataFrame(rays, RAY)
    got = tree.traverse(rays, tree.box_levels(triangles)).collect()
    want = nearest(rays, triangles)
    assert {r.ray_id: (r.t, r.tri_id) for r in got} == want and len(got) == len(want) > 20


def test_few_and_no_triangles(spark):
    one = spark.createDataFrame([(7, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0)], TRI)
    rays = spark.createDataFrame([(1, 0.2, 0.2, 0.0, 0.0, 0.0, 2.0), (2, 3.0, 0.2, 0.0, 0.0, 0.0, 2.0)], RAY)
    assert [(r.ray_id, r.tri_id, r.t, r.visited) for r in tree.traverse(rays, tree.box_levels(one)).collect()] == [(1, 7, 0.5, 1)]
    assert tree.traverse(rays, tree.box_levels(one.limit(0))).count() == 0
    assert tree.traverse(rays.limit(0), tree.box_levels(one)).count() == 0


def test_visits_grow_with_the_logarithm(spark):
    """A height field of four and of sixteen times as many triangles: rays from above visit little more."""

    def visits(n):
        at = spark.range(n * n * 2).select("id", F.floor(F.col("id") / 2 / n).alias("i"), (F.floor(F.col("id") / 2) % n).alias("j"), (F.col("id") % 2).alias("k"))
        z = lambda i, j: F.sin(i * (9.0 / n)) * F.cos(j * (7.0 / n))
        corner = lambda p, i, j: [(i / n).alias(f"{p}x"), (j / n).alias(f"{p}y"), z(i, j).alias(f"{p}z")]
        i, j, k = F.col("i"), F.col("j"), F.col("k")
        tri = at.select(F.col("id").alias("tri_id"), *corner("a", i + k, j + k), *corner("b", i + 1, j), *corner("c", i, j + 1))
        rays = spark.range(64).select(F.col("id").alias("ray_id"), (F.col("id") % 8 / 10 + 0.03).alias("ox"), (F.floor(F.col("id") / 8) / 10 + 0.04).alias("oy"), F.lit(3.0).alias("oz"), F.lit(0.05).alias("dx"), F.lit(0.03).alias("dy"), F.lit(-1.0).alias("dz"))
        got = tree.traverse(rays, tree.box_levels(tri)).agg(F.count("*"), F.avg("visited")).first()
        assert got[0] == 64
        return got[1]

    few, more, most = visits(32), visits(64), visits(128)
    assert most < 2 * few, (few, more, most)


def test_rays_among_triangles_as_large_as_the_scene_visit_few_nodes(spark):
    """Boxes of whole triangles would all lie over each other; rays visited 219 nodes on average, now 32."""
    random.seed(3)
    triangles = spark.createDataFrame([(i, *[random.gauss(0, 1) for _ in range(9)]) for i in range(1200)], TRI)
    rays = spark.createDataFrame([(i, *[random.gauss(0, 1) for _ in range(6)]) for i in range(100)], RAY)
    got = tree.traverse(rays, tree.box_levels(triangles)).collect()
    want = nearest(rays, triangles)
    assert {r.ray_id: (r.t, r.tri_id) for r in got} == want and len(got) > 80
    assert sum(r.visited for r in got) < 64 * len(got), sum(r.visited for r in got) / len(got)
