"""Simplification by rounds of independent collapses against the sequential one, cheapest edge first."""

import heapq
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellforge.operators import mesh, simplify, surface
from cellforge.plans.fixtures import mesh as height_field


def sequential(points, faces, target):
    """Final quadric error of all vertices after collapses in the order of their cost, one by one."""
    p, f = points.astype(float).copy(), [list(x) for x in faces]
    around = [{i for i, t in enumerate(f) if v in t} for v in range(len(p))]
    q = np.zeros((len(p), 4, 4))
    for t in f:
        n = np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
        plane = np.append(n, -n @ p[t[0]]) / np.linalg.norm(n)
        q[t] += np.outer(plane, plane)
    ring = lambda v: {w for i in around[v] for w in f[i]} - {v}
    shared = lambda a, b: around[a] & around[b]
    rim = {v for v in range(len(p)) for w in ring(v) if len(shared(v, w)) == 1}

    def best(a, b):
        m = q[a] + q[b]
        ends = [p[a], p[b], (p[a] + p[b]) / 2]
        if a not in rim and abs(np.linalg.det(m[:3, :3])) > 1e-6:
            ends.append(-np.linalg.solve(m[:3, :3], m[:3, 3]))
        errors = [float(np.append(x, 1) @ m @ np.append(x, 1)) for x in ends]
        k = int(np.argmin(np.round(errors, 9)))
        return errors[k], tuple(ends[k])

    version, left, heap = [0] * len(p), len(f), []
    push = lambda a, b: heapq.heappush(heap, (*best(a, b), a, b, version[a], version[b]))
    for a, b in {tuple(sorted(e)) for t in f for e in itertools.combinations(t, 2)}:
        push(a, b)
    while left > target and heap:
        _, x, a, b, va, vb = heapq.heappop(heap)
        if (va, vb) != (version[a], version[b]) or (a in rim) != (b in rim) or len(shared(a, b)) != (1 if a in rim else 2) or len(ring(a) & ring(b)) != len(shared(a, b)):
            continue
        if {frozenset(set(f[i]) - {a}) for i in around[a]} & {frozenset(set(f[i]) - {b}) for i in around[b]}:
            continue
        turns = False
        for i in around[a] ^ around[b]:
            old, new = (np.cross(c[1] - c[0], c[2] - c[0]) for c in (p[f[i]], np.array([x if v in (a, b) else p[v] for v in f[i]])))
            turns |= bool(old @ new <= 0.2 * np.linalg.norm(old) * np.linalg.norm(new) + 1e-12)
        if turns:
            continue
        for i in shared(a, b):
            left -= 1
            for v in list(f[i]):
                around[v].discard(i)
        for i in around[b]:
            f[i] = [a if v == b else v for v in f[i]]
        around[a] |= around[b]
        around[b] = set()
        p[a], q[a] = x, q[a] + q[b]
        version[a] += 1
        version[b] = -1
        for w in ring(a):
            push(*sorted((a, w)))
    live = [v for v in range(len(p)) if around[v]]
    return sum(float(np.append(p[v], 1) @ q[v] @ np.append(p[v], 1)) for v in live)


def error(vertices, faces):
    used = faces.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).distinct()
    q = {t: F.col(f"q{t}") for t in simplify.TERMS}
    return vertices.join(used, ["mesh_id", "vertex_id"]).agg(F.sum(simplify.quadric_error(q, simplify.Vec.cols("x", "y", "z")))).first()[0]


@pytest.fixture(scope="module")
def ball(spark):
    cells = [(0, x, y, z, 2) for x, y, z in itertools.product(range(10), repeat=3) if sum((a - 4.5) ** 2 for a in (x, y, z)) <= 16]
    v, f = surface.fuse(surface.iso_triangles(spark.createDataFrame(cells, "grid_id long, x int, y int, z int, value int")))
    f = f.select(F.col("grid_id").alias("mesh_id"), F.monotonically_increasing_id().alias("face_id"), "v0", "v1", "v2").cache()
    return v.select(F.col("grid_id").alias("mesh_id"), "vertex_id", "x", "y", "z").cache(), f


def test_a_closed_mesh_stays_closed_near_the_sequential_error(spark, ball):
    v, f = ball
    before = mesh.signed_volume(mesh.triangles_of(v, f)).first().volume
    small_v, small_f = simplify.simplified(v, f, 200)
    assert small_f.count() in (199, 200)
    edges = {(r.v, r.u) for r in simplify.corners(small_f).collect()}
    assert len(edges) == 3 * small_f.count() and {(b, a) for a, b in edges} == edges
    assert abs(mesh.signed_volume(mesh.triangles_of(small_v, small_f)).first().volume - before) < 0.1 * before
    rows = v.collect()
    place = {r.vertex_id: n for n, r in enumerate(rows)}
    plain = sequential(np.array([(r.x, r.y, r.z) for r in rows]), [[place[x] for x in (r.v0, r.v1, r.v2)] for r in f.collect()], 200)
    assert error(small_v, small_f) <= 2 * plain + 1e-6


def test_a_height_field_keeps_near_the_sequential_error(spark, sf):
    v, f = height_field(spark, sf)
    v, f = v.where("mesh_id = 1"), f.where("mesh_id = 1")
    small = simplify.simplified(v, f, 500)
    rows = v.orderBy("vertex_id").collect()
    plain = sequential(np.array([(r.x, r.y, r.z) for r in rows]), [(r.v0, r.v1, r.v2) for r in f.collect()], 500)
    assert small[1].count() in (499, 500) and error(*small) <= 2 * plain


def test_meshes_at_their_target_and_meshes_that_cannot_shrink(spark):
    """A tetrahedron has no edge that may go; two faces and none at all stay as they are; each mesh by itself."""
    corners = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    v = spark.createDataFrame([(m, i, *p) for m in (1, 2) for i, p in enumerate(corners)], "mesh_id long, vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 0, 2, 1), (1, 1, 0, 1, 3), (1, 2, 0, 3, 2), (1, 3, 1, 2, 3), (2, 0, 0, 2, 1), (2, 1, 1, 2, 3)], "mesh_id long, face_id long, v0 long, v1 long, v2 long")
    out = simplify.simplified(v, f, 2)[1]
    assert sorted(map(tuple, out.select("mesh_id", "face_id").collect())) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    assert simplify.simplified(v.limit(0), f.limit(0), 2)[1].count() == 0
