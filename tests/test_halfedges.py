"""Half edges of closed, open and broken meshes, and border lines against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from cellforge.operators import halfedges

FACES = "mesh_id long, face_id long, v0 long, v1 long, v2 long"


def grid_faces(n, mesh_id=0, first=0):
    out = []
    for i in range(n):
        for j in range(n):
            a, b, c, d = first + i * (n + 1) + j, first + (i + 1) * (n + 1) + j, first + i * (n + 1) + j + 1, first + (i + 1) * (n + 1) + j + 1
            out += [(mesh_id, len(out), a, b, c), (mesh_id, len(out) + 1, c, b, d)]
    return out


def plain_loops(faces, cluster):
    """Border lines of each cluster, walked side by side."""
    side = {(m, v[k], v[(k + 1) % 3]): (f, k) for m, f, *v in faces for k in range(3)}
    at = {(m, f): v for m, f, *v in faces}
    lines, seen = set(), set()

    def rim(m, f, k):
        v = at[m, f]
        far = side.get((m, v[(k + 1) % 3], v[k]))
        return far is None or cluster[m, far[0]] != cluster[m, f]

    for m, f, *_ in faces:
        for k in range(3):
            if not rim(m, f, k) or (m, f, k) in seen:
                continue
            line, here = [], (f, k)
            while (m, *here) not in seen:
                seen.add((m, *here))
                line.append((3 * here[0] + here[1], at[m, here[0]][here[1]]))
                g, j = here[0], (here[1] + 1) % 3
                while not rim(m, g, j):
                    v = at[m, g]
                    g, j = side[m, v[(j + 1) % 3], v[j]]
                    j = (j + 1) % 3
                here = (g, j)
            least = min(h for h, _ in line)
            turn = [h for h, _ in line].index(least)
            line = line[turn:] + line[:turn]
            lines |= {(m, cluster[m, f], least, p, v, h) for p, (h, v) in enumerate(line)}
    return lines


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_loops_equal_plain_walks(spark, seed):
    random.seed(seed)
    faces = [f for f in grid_faces(9) if random.random() < 0.85] + [(4, f, *v) for _, f, *v in grid_faces(6)]
    cluster = {(m, f): random.randrange(2) if m == 0 else f // 30 for m, f, *_ in faces}
    df = spark.createDataFrame(faces, FACES)
    labels = spark.createDataFrame([(m, f, c) for (m, f), c in cluster.items()], "mesh_id long, face_id long, cluster int")
    got = [tuple(r) for r in halfedges.border_loops(halfedges.half_edges(df), labels).collect()]
    want = plain_loops(faces, cluster)
    assert len(got) == len(want) and set(got) == want


def test_closed_open_and_broken_meshes(spark):
    tetrahedron = [(1, 0, 0, 2, 1), (1, 1, 0, 1, 3), (1, 2, 0, 3, 2), (1, 3, 1, 2, 3)]
    strip = [(2, 0, 0, 1, 2)]
    fin = [(3, 0, 0, 1, 2), (3, 1, 1, 0, 3), (3, 2, 0, 1, 4)]  # three faces about one edge
    turned = [(5, 0, 0, 1, 2), (5, 1, 0, 1, 3)]  # two that run the same way
    e = halfedges.half_edges(spark.createDataFrame(tetrahedron + strip + fin + turned, FACES)).cache()
    rows = {(r.mesh_id, r.h): r for r in e.collect()}
    assert len(rows) == 3 * 10
    for (m, _), r in rows.items():
        if r.twin is not None:
            t = rows[m, r.twin]
            assert (t.v, t.u, t.twin) == (r.u, r.v, r.h)
        assert rows[m, r.next].v == r.u and rows[m, rows[m, r.next].next].next == r.h
    assert all(r.twin is not None for (m, _), r in rows.items() if m == 1)
    bad = {(m, frozenset((r.v, r.u))) for (m, _), r in rows.items() if not r.manifold}
    assert bad == {(3, frozenset((0, 1))), (5, frozenset((0, 1)))}
    loops = halfedges.border_loops(e).groupBy("mesh_id", "loop").count().collect()
    assert {r.mesh_id for r in loops} == {2, 3, 5} and [r["count"] for r in loops if r.mesh_id == 2] == [3]
    faces = spark.createDataFrame(tetrahedron + strip + fin + turned, FACES)
    assert halfedges.faces_of(e).exceptAll(faces).count() == 0 and halfedges.faces_of(e).count() == faces.count()
    assert halfedges.border_loops(halfedges.half_edges(faces.limit(0))).count() == 0


def test_a_long_line_takes_few_rounds(spark):
    """The border of a strip of 2000 faces is one line of 2002 sides."""
    strip = spark.range(2000).select(F.lit(0).cast("long").alias("mesh_id"), F.col("id").alias("face_id"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1).alias("v0"), F.when(F.col("id") % 2 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("v1"), (F.col("id") + 2).alias("v2"))
    got = halfedges.border_loops(halfedges.half_edges(strip)).agg(F.count("*"), F.max("position"), F.countDistinct("position"), F.countDistinct("loop")).first()
    assert tuple(got) == (2002, 2001, 2002, 1)
