"""Known values, invariants and plain re-implementations of the definitions on small grids and meshes."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellforge.functions.vec import Vec
from cellforge.operators import clusters, encode, fracture, grid, mesh, metadata, morphology, seeding, spatial, surface
from cellforge.operators.scan import least_of_groups, place_in_group
from cellforge.plans import fixtures as fx
from cellforge.sources import binary, listing, obj, tables

ALL6 = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def voxels(spark, cells, value=1):
    return spark.createDataFrame([(0, *map(int, c), int(v)) for c, v in (cells.items() if isinstance(cells, dict) else ((c, value) for c in cells))], "grid_id long, x int, y int, z int, value int")


def as_dict(df):
    return {(r.x, r.y, r.z): r.value for r in df.collect()}


def blob(n, seed=0, p=0.7):
    rng = np.random.default_rng(seed)
    return {c for c in itertools.product(range(n), repeat=3) if rng.random() < p}


def test_known_fragment_counts(spark):
    lab = fx.labelled(spark, "/root/testdata/sf0.01")
    counts = {r.value: r.voxels for r in metadata.fragment_sizes(lab).collect()}
    assert counts == {2: 5560, 3: 9577, 4: 6150, 5: 6203}
    assert morphology.boundary_flags(lab).where("is_boundary").count() == 5035
    runs = encode.run_lengths(lab, (32, 32, 32))
    assert runs.count() == 10218 and runs.agg(F.sum("length")).first()[0] == 32768
    # the grid of 16 cells an axis is full at this scale, so its hollow ball is whole
    assert fx.shell(spark, "/root/testdata/sf0.01", 16).count() == 1512


def test_nearest_seed_forms_agree(spark):
    cells = voxels(spark, blob(8))
    seeds = [(2, 1, 1, 1), (3, 6, 2, 3), (4, 2, 6, 6), (5, 2, 6, 6)]
    for metric in ("euclidean", "manhattan", "chebyshev"):
        p = fracture.FractureParams(metric=metric)
        a = as_dict(fracture.nearest_seed(cells, seeds, p))
        assert a == as_dict(fracture.nearest_seed(cells, fx.seed_table(spark, seeds), p))
        assert 5 not in a.values()
    one = as_dict(fracture.nearest_seed(cells, seeds[:1]))
    assert set(one.values()) == {2}


def test_voronoi_default_reach(spark):
    seeds = [(2, 0, 0, 0), (3, 4, 0, 0), (4, 0, 3, 0), (5, 0, 0, 2)]
    assert abs(fracture.delaunay_longest_edge(seeds) - 5.0) < 1e-9
    line = [(2, 0, 0, 0), (3, 1, 0, 0), (4, 5, 0, 0)]
    assert abs(fracture.delaunay_longest_edge(line) - 4.0) < 1e-9
    out = as_dict(fracture.voronoi(voxels(spark, [(0, 0, 0), (20, 0, 0)]), line))
    assert out == {(0, 0, 0): 2, (20, 0, 0): 1}


def plain_flood(cells, seeds, offsets):
    label, level, front = {}, {}, {}
    for i, x, y, z in seeds:
        if (x, y, z) in cells:
            front[(x, y, z)] = min(i, front.get((x, y, z), i))
    n = 0
    while front:
        for c, v in front.items():
            label[c], level[c] = v, n
        new = {}
        for (x, y, z), v in front.items():
            for dx, dy, dz in offsets:
                c = (x + dx, y + dy, z + dz)
                if c in cells and c not in label:
                    new[c] = min(v, new.get(c, v))
        front, n = new, n + 1
    return {c: (label[c], level[c]) for c in label}


@pytest.mark.parametrize("n", [6, 26])
def test_flood_matches_plain_search(spark, n):
    cells = blob(7, 1, 0.5)
    seeds = [(2, 0, 0, 0), (3, 6, 6, 6), (4, 3, 3, 3), (5, 3, 2, 3)]
    want = plain_flood(cells, seeds, grid.NEIGHBOURHOODS[n])
    v, s = voxels(spark, cells), fx.seed_table(spark, seeds)
    for run in (fracture.flood, fracture.flood_frontier):
        assert {(r.x, r.y, r.z): (r.value, r.level) for r in run(v, s, n).collect()} == want


def connected(cells, offsets=ALL6):
    cells = set(cells)
    if not cells:
        return True
    seen, todo = set(), [next(iter(cells))]
    while todo:
        c = todo.pop()
        if c in seen:
            continue
        seen.add(c)
        todo += [d for o in offsets if (d := tuple(a + b for a, b in zip(c, o))) in cells]
    return seen == cells


def test_repaired_flood_gives_connected_fragments(spark):
    cells = blob(9, 3, 0.8)
    rows = [(0, 2, 1, 0, 0, 0), (0, 2, 2, 8, 8, 8), (0, 2, 3, 0, 8, 0), (0, 3, 1, 4, 4, 4), (0, 3, 2, 8, 0, 0), (0, 4, 1, 0, 0, 8)]
    cells |= {r[3:] for r in rows}
    out = fracture.flood_repaired(voxels(spark, cells), spark.createDataFrame(rows, "grid_id long, seed_id int, sub_seed int, sx int, sy int, sz int"), 6).collect()
    assert {(r.x, r.y, r.z) for r in out} == cells
    for f in (2, 3, 4):
        part = [(r.x, r.y, r.z) for r in out if r.value == f]
        assert part and connected(part) and {r.sub_seed for r in out if r.value == f} == {1}
    reach = plain_flood(cells, [(r[1], *r[3:]) for r in rows], ALL6)
    assert {(r.x, r.y, r.z) for r in out if r.value > 1} <= set(reach)


def test_fracture_registry_and_schedule(spark):
    v, s = voxels(spark, blob(4)), fx.seed_table(spark, [(2, 0, 0, 0), (3, 3, 3, 3)])
    for name in fracture.ALGORITHMS:
        assert fracture.fracture(v, s, fracture.FractureParams(algorithm=name)).count() > 0
    with pytest.raises(ValueError):
        fracture.fracture(v, s, fracture.FractureParams(algorithm="none"))
    runs = fracture.runs(spark.createDataFrame([(1,)], "model_id long"), fracture.FractureParams(max_fragments=10**6))
    assert runs.count() == sum(int(25 - 10 * (n - 2) / 8) for n in range(2, 11))


def test_erosion_and_empty_grids(spark):
    lab = {c: 2 if c[0] < 4 else 3 for c in itertools.product(range(8), repeat=3)}
    out = as_dict(morphology.erode(voxels(spark, lab), (8, 8, 8), "square", 3, 1.0, 0.9, despeckle_after=False))
    assert set(out) < set(lab) and all(c[0] not in (3, 4) or False for c in out if 0 < c[1] < 7 and 0 < c[2] < 7)
    empty = voxels(spark, [(0, 0, 0)]).limit(0)
    assert morphology.erode(empty, (8, 8, 8)).count() == morphology.despeckle(empty).count() == 0
    assert fracture.nearest_seed(empty, [(2, 0, 0, 0)]).count() == grid.surface_flags(empty, (8, 8, 8)).count() == 0
    assert encode.run_lengths(empty, (2, 2, 2)).count() == 0 and not grid.any_occupied(empty)


def test_run_lengths_expand_back(spark):
    cells = {c: 2 + (c[2] > 2) for c in blob(6, 5, 0.6)}
    v = voxels(spark, cells)
    assert as_dict(encode.expand_runs(encode.run_lengths(v, (6, 6, 6)), (6, 6, 6))) == cells


# surfaces


def edge_counts(triangles):
    count = {}
    for t in triangles:
        p = [(t.ax, t.ay, t.az), (t.bx, t.by, t.bz), (t.cx, t.cy, t.cz)]
        for a, b in ((0, 1), (1, 2), (2, 0)):
            count[(p[a], p[b])] = count.get((p[a], p[b]), 0) + 1
    return count


def test_surfaces_are_closed_and_face_outwards(spark):
    assert len(surface.surface_table()) == 820
    for seed in range(3):
        cells = blob(5, seed, 0.5)
        t = surface.iso_triangles(voxels(spark, cells, 2)).collect()
        count = edge_counts(t)
        assert all(count.get((b, a), 0) == n for (a, b), n in count.items())
    solid = surface.iso_triangles(voxels(spark, itertools.product(range(4), repeat=3), 2))
    volume = mesh.signed_volume(solid.withColumn("mesh_id", F.lit(0))).first().volume / 8
    assert 4**3 - 20 < volume < 4**3
    v, f = surface.fuse(solid)
    edges = {frozenset(e) for r in f.collect() for e in ((r.v0, r.v1), (r.v1, r.v2), (r.v2, r.v0))}
    assert v.count() - len(edges) + f.count() == 2


def test_simplified_mesh_keeps_its_shape(spark):
    t = surface.iso_triangles(voxels(spark, [c for c in itertools.product(range(10), repeat=3) if sum((a - 4.5) ** 2 for a in c) <= 16], 2))
    v, f = surface.fuse(t)
    v = v.select(F.col("grid_id").alias("mesh_id"), "vertex_id", "x", "y", "z")
    f = f.select(F.col("grid_id").alias("mesh_id"), F.monotonically_increasing_id().alias("face_id"), "v0", "v1", "v2").cache()
    before = mesh.signed_volume(mesh.triangles_of(v, f)).first().volume
    small = mesh.simplify(v, f, 120)
    assert small.count() <= 121 and abs(mesh.signed_volume(small).first().volume - before) < 0.1 * before
    count = edge_counts(small.collect())
    assert all(count.get((b, a), 0) == n for (a, b), n in count.items())
    assert mesh.simplify(v, f, 10**6).count() == f.count()


def test_solid_and_enclosed_cells_of_a_box(spark):
    lo, hi = (1.2, 2.1, 0.7), (6.3, 5.9, 7.4)
    corner = [tuple((hi if b >> k & 1 else lo)[k] for k in range(3)) for b in range(8)]
    rows, n = [], 0
    for ring in surface._faces():
        for a, b, c in ((0, 1, 2), (0, 2, 3)):
            rows.append((1, n, *corner[ring[a]], *corner[ring[b]], *corner[ring[c]]))
            n += 1
    t = spark.createDataFrame(rows, "mesh_id long, tri_id long, " + ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz"))
    want = {c for c in itertools.product(range(8), repeat=3) if all(l < x + 0.5 < h for x, l, h in zip(c, lo, hi))}
    assert set(as_dict(mesh.solid_cells(t, (8, 8, 8)))) == want
    assert {(r.x, r.y, r.z) for r in spatial.enclosed_cells(t, (8, 8, 8)).collect()} == want
    v = mesh.signed_volume(t).first().volume
    assert abs(v - 5.1 * 3.8 * 6.7) < 1e-9
    pts = spark.createDataFrame([(i, x + 0.5, y + 0.5, z + 0.5) for i, (x, y, z) in enumerate(itertools.product(range(8), repeat=3))], "point_id long, x double, y double, z double")
    shifted = pts.select("point_id", (F.col("x") + 0.013).alias("x"), (F.col("y") + 0.027).alias("y"), (F.col("z") + 0.041).alias("z"))
    inside = {r.point_id for r in spatial.points_in_mesh(shifted, t.drop("mesh_id")).where("inside").collect()}
    assert inside == {i for i, c in enumerate(itertools.product(range(8), repeat=3)) if c in want}


def test_seeds_are_exact_and_distinct(spark):
    v = fx.shell(spark, "/root/testdata/sf0.01", 16)
    for where in ("outer", "inner", "both"):
        s = seeding.uniform_seeds(v, 5, (16, 16, 16), where).collect()
        assert [r.seed_id for r in sorted(s, key=lambda r: (r.sx, r.sy, r.sz))] == [2, 3, 4, 5, 6]
    for law in seeding.LAWS:
        assert seeding.uniform_seeds(v, 3, (16, 16, 16), law=law).count() == 3
    r = spark.range(2000).select(F.col("id").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"))
    u = [x[0] for x in r.select(seeding.noise(Vec.cols("x", "y", "z"), 1)).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03 and len(set(u)) > 1990


def test_walk_covers_each_border_once(spark):
    pairs = [(0, 2, 1, 2), (0, 2, 2, 3), (0, 2, 7, 8), (0, 3, 5, 6)]
    rows = clusters.border_walk(spark.createDataFrame(pairs, "mesh_id long, cluster int, a long, b long")).collect()
    assert [(r.cluster, r.chain, r.face_id) for r in sorted(rows, key=lambda r: (r.cluster, r.chain, r.position))] == [(2, 0, 1), (2, 0, 2), (2, 0, 3), (2, 1, 7), (2, 1, 8), (3, 0, 5), (3, 0, 6)]


# files


def test_grid_files(spark, tmp_path):
    cells = {c: 2 + c[0] % 3 for c in blob(6, 8, 0.5)}
    v = voxels(spark, {c: x for c, x in cells.items() if c[1] < 4})
    for kind in binary.GRID_FORMATS:
        binary.write_grids(v, (6, 4, 6), str(tmp_path / kind), kind, plain_files=True)
    back = as_dict(binary.read_rle(spark, str(tmp_path / "rle"), flip_y=False))
    assert back == {c: x for c, x in cells.items() if c[1] < 4}
    flipped = as_dict(binary.read_rle(spark, str(tmp_path / "rle"), pad="end"))
    assert flipped == {(x, 3 - y, z): v for (x, y, z), v in back.items()}
    centred = as_dict(binary.read_raw(spark, str(tmp_path / "raw"), (6, 6, 6)))
    assert centred == {(x, y + 1, z): v for (x, y, z), v in back.items()}
    assert (tmp_path / "vox" / "0.vox").read_bytes()[:4] == b"VOX "
    with pytest.raises(ValueError):
        binary.encode_grids(v, (6, 4, 6), "none")
    with pytest.raises(ValueError):
        binary.decode_rle(struct.pack("<III", 2, 2, 2) + struct.pack("<HI", 1, 3))


def test_mesh_and_point_files(spark, tmp_path):
    text = "# c\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0.5\nvt 0 0\nvn 0 0 1\nf 1/1/1 2/1/1 3/1/1 4/1/1\nf -4 -3 -1\n"
    (tmp_path / "a.obj").write_text(text)
    v, f = obj.read_obj(spark, str(tmp_path / "a.obj"))
    assert v.count() == 4 and v.where("vertex_id = 3").first().z == 0.5
    assert sorted((r.v0, r.v1, r.v2, r.t0) for r in f.collect()) == [(0, 1, 2, 0), (0, 1, 3, None), (0, 2, 3, 0)] or sorted((r.v0, r.v1, r.v2) for r in f.collect()) == [(0, 1, 2), (0, 1, 3), (0, 2, 3)]
    vm, fm = mesh.planar_mesh(spark, 2, 2)
    obj.write_obj(vm, fm, str(tmp_path / "out"))
    assert (tmp_path / "out" / "mesh_id=0").exists()
    for count_bytes in (4, 8):
        content = binary.encode_binm(vm, fm, count_bytes).first().content
        p, t = binary.decode_binm(bytes(content), count_bytes)
        assert p.shape == (9, 3) and t.shape == (8, 3) and t.max() == 8
    ply = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 1 2\n3 4 5\n3 0 1 0\n"
    (tmp_path / "p.ply").write_bytes(ply)
    assert [(r.x, r.y, r.z) for r in binary.read_ply(spark, str(tmp_path / "p.ply"), True).orderBy("point_id").collect()] == [(0, 2, -1), (3, 5, -4)]
    assert listing.list_models(spark, str(tmp_path), "obj").first().name == "a"
    with pytest.raises(FileNotFoundError):
        listing.list_models(spark, str(tmp_path), "stl")
    pts = seeding.random_points(spark, 50, radius=2.0)
    assert pts.where(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2 > 4.0001).count() == 0
    binary.write_xyz(pts, str(tmp_path / "xyz"))
    tables.write_cache(pts, str(tmp_path / "cache"))
    assert tables.read_cache(spark, str(tmp_path / "cache")).count() == 50


def test_metadata_files(spark, tmp_path):
    rows = spark.createDataFrame([("grid", "g", "4x4x4", None), ("point_cloud", "p", "4x4x4", 7)], "kind string, filename string, size string, points int")
    for c in ("fragment_id", "voxels", "occupied", "percentage", "vertices", "faces"):
        rows = rows.withColumn(c, F.lit(None).cast("int"))
    tables.write_metadata(rows, str(tmp_path / "m"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "m" / "point_cloud"))
    assert back.columns == ["Filename", "Voxelization size", "Points"] and back.first()[2] == "7"


def test_frontier_floods_the_whole_grid(spark):
    from cellforge.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, QUERIES["flood_by_frontier"](spark, sf).select("x", "y", "z", "value", "level").collect()))
    assert got == sorted(map(tuple, QUERIES["flood_fragments"](spark, sf).select("x", "y", "z", "value", "level").collect()))
    assert 20_000 < len(got) <= fx.grid(spark, sf).count() < 32**3


def test_every_mesh_is_subdivided(spark, sf):
    from cellforge.plans.catalog import QUERIES

    assert {r.mesh_id for r in QUERIES["subdivided_triangles"](spark, sf).select("mesh_id").distinct().collect()} == {0, 1, 2, 3}


def test_large_seed_ids_and_unended_repairs(spark):
    cells = voxels(spark, blob(5))
    seeds = [(65538, 0, 0, 0), (70000, 4, 4, 4), (2**31 - 1, 0, 4, 4)]
    for s in (seeds, fx.seed_table(spark, seeds)):
        assert set(as_dict(fracture.nearest_seed(cells, s)).values()) == {65538, 70000, 2**31 - 1}
    assert set(as_dict(fracture.voronoi(cells, seeds, 50.0)).values()) == {65538, 70000, 2**31 - 1}
    extra = spark.createDataFrame([(0, 9, 1, 0, 0)], "grid_id long, seed_id int, sx int, sy int, sz int")
    assert seeding.merge_seeds(fx.seed_table(spark, seeds), extra).first().seed_id == 65538
    rows = spark.createDataFrame([(0, 70001, 70002, 0, 0, 0)], "grid_id long, seed_id int, sub_seed int, sx int, sy int, sz int")
    out = fracture.flood_repaired(voxels(spark, [(0, 0, 0), (1, 0, 0)]), rows, 6).collect()
    assert {(r.value, r.sub_seed) for r in out} == {(70001, 70002)}
    with pytest.raises(Exception, match="repair did not end"):
        fracture.flood_repaired(voxels(spark, [(0, 0, 0), (1, 0, 0)]), rows, 6, max_rounds=0).collect()


def test_rays_against_all_pairs(spark):
    """Large and tiny triangles, rays along axes and edges, a flat scene and an empty one."""
    rng = np.random.default_rng(4)
    tri = []
    for i in range(300):
        at, size = rng.random(3) * 10, 10 ** rng.uniform(-3, 1)
        tri.append((i, *[float(v) for p in range(3) for v in at + size * (rng.random(3) - 0.5)]))
    tri += [(300, 0.0, 0.0, 5.0, 10.0, 0.0, 5.0, 0.0, 10.0, 5.0), (301, 10.0, 10.0, 5.0, 10.0, 0.0, 5.0, 0.0, 10.0, 5.0)]
    rays = [(i, *map(float, rng.random(3) * 12 - 1), *map(float, rng.normal(size=3))) for i in range(120)] + [(200, 2.5, 2.5, -1.0, 0.0, 0.0, 1.0), (201, 5.0, 2.5, 11.0, 0.0, 0.0, -1.0)]
    td = spark.createDataFrame(tri, "tri_id long, " + ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz"))
    rd = spark.createDataFrame(rays, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    t, u, v = spatial.ray_triangle(spatial.O, spatial.D, spatial.A, spatial.B, spatial.C)
    want = {(r.ray_id, r.tri_id): r.t for r in rd.crossJoin(td).withColumn("t", t).where("t is not null").collect()}
    for levels in (None, 0, 3, 7):
        got = [((r.ray_id, r.tri_id), r.t) for r in spatial.ray_hits(rd, td, levels).collect()]
        assert len(got) == len(dict(got)) and set(dict(got)) == set(want)
        assert all(abs(x - want[k]) < 1e-9 * max(1, abs(x)) for k, x in got)
    flat = td.where("tri_id >= 300")
    assert {(r.ray_id, r.tri_id) for r in spatial.ray_hits(rd, flat).collect()} == {k for k in want if k[1] >= 300}
    assert spatial.ray_hits(rd, td.limit(0)).count() == 0 and spatial.ray_hits(rd.limit(0), td).count() == 0


def test_point_formats(spark):
    pts = seeding.random_points(spark, 40, (-1.0, 0.0, 5.0), (3.0, 0.0, 6.0))
    want = sorted((r.x, r.y, r.z) for r in pts.collect())
    for kind, read in (("xyz", binary.xyz_points), ("octree", binary.cloud_points)):
        files = binary.unzipped(binary.zipped(binary.encode_points(pts, kind), "cloud_id", kind))
        got = sorted((r.x, r.y, r.z) for r in read(files).collect())
        assert np.allclose(got, want, atol=1e-12 if kind == "xyz" else 1e-4 * 5)
    with pytest.raises(ValueError):
        binary.encode_points(pts, "none")


def test_checkpoint_folder_on_a_cluster():
    from types import SimpleNamespace

    from cellforge.lineage import checkpoint_folder

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        checkpoint_folder(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def plain_tree(boxes, radius):
    """(round, left, right, area) by the definition; boxes: [(id, lo, hi)] in order."""
    live, out, turn = list(boxes), [], 0

    def area(a, b):
        x, y, z = (max(p, q) - min(r, s) for p, q, r, s in zip(a[2], b[2], a[1], b[1]))
        return 2 * (x * y + y * z + x * z)

    while len(live) > 1:
        turn += 1
        best = {}
        for i, a in enumerate(live):
            best[a[0]] = min((area(a, b), b[0]) for j, b in enumerate(live) if i != j and abs(i - j) <= radius)[1]
        by_id, left, merged = {a[0]: a for a in live}, [], set()
        for a in live:
            b = by_id[best[a[0]]]
            if a[0] in merged:
                continue
            if best[b[0]] == a[0]:
                out.append((turn, a[0], b[0], area(a, b)))
                merged.add(b[0])
                a = (a[0], tuple(map(min, a[1], b[1])), tuple(map(max, a[2], b[2])))
            left.append(a)
        live = left
    return sorted(out)


@pytest.mark.parametrize("local", [1, 6, 1000])
def test_agglomeration_follows_its_definition(spark, local):
    """On a lattice of equal boxes, so that most areas tie, however many clusters one task is given."""
    rng = np.random.default_rng(5)
    boxes = [(int(i), (x, y, 0.0), (x + 1.0, y + 1.0, 1.0)) for i, x, y in zip(rng.permutation(24), map(float, rng.integers(0, 5, 24)), map(float, rng.integers(0, 5, 24)))]
    df = spark.createDataFrame([(i, n, *lo, *hi) for n, (i, lo, hi) in enumerate(boxes)], "id long, place long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    got = sorted(tuple(r) for r in spatial.agglomerate(df, 4, local).collect())
    assert got == plain_tree(boxes, 4)
    assert len(got) == 23
    if local == 6:
        assert spatial.agglomerate(df.limit(1), 4).count() == spatial.agglomerate(df.limit(0), 4).count() == 0


def test_least_of_groups_and_places(spark):
    rows = [(g, k, float(u)) for g, n in ((1, 5000), (2, 3), (None, 40)) for k, u in enumerate(np.random.default_rng(n).integers(0, 50, n) / 50)]
    df = spark.createDataFrame(rows, "g int, k int, u double")
    for n in (1, 10, 1500):
        got = sorted((r.g or 0, r.k) for r in least_of_groups(df, "g", F.col("u"), ["k"], n).collect())
        want = [(g or 0, k) for g in (1, 2, None) for _, k in sorted((u, k) for h, k, u in rows if h == g)[:n]]
        assert got == sorted(want)
    got = sorted((r.g or 0, r.place, r.k) for r in place_in_group(df, "g", ["u", "k"]).collect())
    want = [(g or 0, n, k) for g in (1, 2, None) for n, (_, k) in enumerate(sorted((u, k) for h, k, u in rows if h == g))]
    assert got == sorted(want)
    assert place_in_group(df.limit(0), "g", ["k"]).count() == least_of_groups(df.limit(0), "g", F.col("u"), ["k"], 3).count() == 0


def test_listing_takes_a_folder_as_one_model(spark, tmp_path):
    from cellforge.sources.listing import list_models

    root = tmp_path / "in.obj"  # the folder's own name must not count
    (root / "sub" / "b.obj" / "deep").mkdir(parents=True)
    sizes = {"a.obj": 1, "sub/b.obj/part-0.obj": 20, "sub/b.obj/deep/part-1.txt": 300, "sub/b.obj/_SUCCESS": 7, "sub/c.txt": 9, "sub/obj": 9}
    for name, n in sizes.items():
        (root / name).write_bytes(b"x" * n)
    got = {(r.path.split("/in.obj/")[1], r.name, r.length) for r in list_models(spark, str(root), "obj").collect()}
    assert got == {("a.obj", "a", 1), ("sub/b.obj", "b", 320)}
    assert [(r.name, r.length) for r in list_models(spark, str(root / "a.obj"), "obj").collect()] == [("a", 1)]
    with pytest.raises(FileNotFoundError):
        list_models(spark, str(root), "ply")


def test_checkpoints_in_a_loop_of_joins_keep_a_plain_size(spark):
    from cellforge.lineage import cut

    rows = spark.range(8)
    for _ in range(9):
        rows = cut(rows.join(rows.select(F.col("id").alias("other")), F.col("id") == F.col("other")).select("id"), 8)
    assert sorted(r.id for r in rows.collect()) == list(range(8))
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63


def met_pairs(spark, monkeypatch, find):
    """Pairs of rays and triangles that `find` brings together, of 400 rays and 1200 triangles as large as their scene."""
    rng = np.random.default_rng(7)
    tri = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(rng.normal(size=(1200, 9)))], "tri_id long, " + ", ".join(f"{v}{k} double" for v in "abc" for k in "xyz"))
    rays = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(rng.normal(size=(400, 6)))], "ray_id long, " + ", ".join(f"{v}{k} double" for v in "od" for k in "xyz"))
    met, tested = [], spatial._tested
    monkeypatch.setattr(spatial, "_tested", lambda pairs, *a: met.append(pairs.count()) or tested(pairs, *a))
    return {(r.ray_id, r.tri_id): (r.t, r) for r in find(rays, tri).collect()}, sum(met)


def test_rays_meet_large_triangles_in_few_cells(spark, monkeypatch):
    hits, met = met_pairs(spark, monkeypatch, spatial.ray_hits)
    assert len(hits) < met < 400 * 1200


def test_nearest_hits_follow_rays_no_further_than_needed(spark, monkeypatch):
    hits, _ = met_pairs(spark, monkeypatch, spatial.ray_hits)
    monkeypatch.undo()
    near, met = met_pairs(spark, monkeypatch, spatial.nearest_hit)
    first = {}
    for (ray, tri), (t, _) in hits.items():
        first[ray] = min(first.get(ray, (t, tri)), (t, tri))
    assert {ray: (t, tri) for (ray, tri), (t, _) in near.items()} == first
    assert met < 400 * 1200 // 2


def test_hits_carry_columns_of_triangles(spark):
    tri = spark.createDataFrame([(5, 0.0, 0.0, 1.0, 4.0, 0.0, 1.0, 0.0, 4.0, 1.0, 1.0, 2.0, 3.0)], "tri_id long, " + ", ".join(f"{v}{k} double" for v in "abc" for k in "xyz") + ", q0 double, q1 double, q2 double")
    rays = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "ray_id int, ox double, oy double, oz double, dx double, dy double, dz double")
    hits = spatial.ray_hits(rays, tri, carry=("q0", "q1", "q2"))
    assert [tuple(r) for r in spatial.blended(hits, ["ray_id", "tri_id"], ["q"]).collect()] == [(1, 5, 1.75)]
    plain = spatial.interpolate(spatial.ray_hits(rays, tri), tri.select("tri_id", "q0", "q1", "q2"), ["q"])
    assert [r.q for r in plain.collect()] == [1.75]
    assert spatial.ray_hits(rays, tri.limit(0), carry=("q0",)).columns == ["ray_id", "tri_id", "t", "u", "v", "q0"]


def test_nearest_hits_meet_no_more_hits_among_more_triangles(spark, monkeypatch):
    """Rounds over more and more triangles: of 8000, whose hits before were some 8000 / FIRST for each ray in one round."""
    monkeypatch.setattr(spatial, "FIRST", 16)
    rng = np.random.default_rng(5)
    tri = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(rng.normal(size=(8000, 9)))], "tri_id long, " + ", ".join(f"{v}{k} double" for v in "abc" for k in "xyz"))
    rays = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(rng.normal(size=(60, 6)))], "ray_id long, " + ", ".join(f"{v}{k} double" for v in "od" for k in "xyz"))
    found, plain = [], spatial.ray_hits
    all_hits = {}
    for r in plain(rays, tri).collect():
        all_hits[r.ray_id] = min(all_hits.get(r.ray_id, (r.t, r.tri_id)), (r.t, r.tri_id))
    monkeypatch.setattr(spatial, "ray_hits", lambda *a, **k: found.append(plain(*a, **k)) or found[-1])
    got = {r.ray_id: (r.t, r.tri_id) for r in spatial.nearest_hit(rays, tri).collect()}
    assert got == all_hits
    assert max(f.count() for f in found) < 60 * 4 * 16


def test_large_triangles_are_tested_in_blocks(spark, monkeypatch):
    """Few and many large triangles, none of them cut up, beside small ones, with rays that lack a number: the hits of all pairs."""
    rng = np.random.default_rng(11)
    tri = [(i, *map(float, c)) for i, c in enumerate(rng.normal(size=(300, 9)))]
    tri += [(300 + i, *map(float, np.tile(rng.normal(size=3), 3) + rng.normal(size=9) * 1e-3)) for i in range(40)]
    tri.append((900, None, *tri[0][2:]))
    rays = [(i, *map(float, c)) for i, c in enumerate(rng.normal(size=(90, 6)))]
    for i in range(40):  # at small ones, from the corner of the scene
        at = np.reshape(tri[300 + i][1:], (3, 3)).mean(0)
        rays.append((100 + i, 9.0, 9.0, 9.0, *map(float, at - 9.0)))
    rays += [(990, None, *rays[0][2:]), (991, *rays[0][1:4], 0.0, 0.0, 0.0)]
    td = spark.createDataFrame(tri, "tri_id long, " + ", ".join(f"{v}{k} double" for v in "abc" for k in "xyz"))
    rd = spark.createDataFrame(rays, "ray_id long, " + ", ".join(f"{v}{k} double" for v in "od" for k in "xyz"))
    t = spatial.ray_triangle(spatial.O, spatial.D, spatial.A, spatial.B, spatial.C)[0]
    want = {(r.ray_id, r.tri_id): r.t for r in rd.crossJoin(td).withColumn("t", t).where("t is not null").collect()}
    assert len(want) > 1500 and sum(k[1] >= 300 for k in want) >= 40
    cuts, cut_up = [], spatial.cut_up
    monkeypatch.setattr(spatial, "cut_up", lambda *a: cuts.append(a) or cut_up(*a))
    for sent in (spatial.SENT_PIECES, 0):
        monkeypatch.setattr(spatial, "SENT_PIECES", sent)
        monkeypatch.setattr(spatial, "BLOCK", 64)
        hits = spatial.ray_hits(rd, td)
        got = [((r.ray_id, r.tri_id), r.t) for r in hits.collect()]
        assert len(got) == len(want) and set(dict(got)) == set(want)
        assert all(abs(x - want[k]) < 1e-9 * max(1, abs(x)) for k, x in got)
    assert not cuts


def test_level_of_large_triangles():
    assert 1 <= spatial._wide({0: 3, 6: 5000}, 4) <= 6  # the three, but not the many small ones
    assert spatial._wide({1: 900, 2: 300, 4: 20}, 4) == 5  # nearly all large: the few small ones beside them
    assert spatial._wide({5: 900}, 3) == 0 and spatial._wide({0: 1}, 0) == 0


def test_quick_rounding_is_that_of_spark(spark):
    from cellforge.plans.queries_mesh import R, quick

    rng = np.random.default_rng(3)
    x = [*(rng.normal(size=3000) * 10.0 ** rng.integers(-8, 13, 3000)), *((rng.integers(-10**7, 10**7, 2000) + 0.5) / 1e6), *((rng.integers(-10**6, 10**6, 500) + 0.4995) / 1e6)]
    rows = [(float(v),) for v in x] + [(v,) for v in (None, 0.0, -0.0, -1e-9, float("nan"), float("inf"), -1e300, 5e-7, -5e-7)]
    df = spark.createDataFrame(rows, "x double").select(*R(("a", F.col("x"))), *quick(("b", F.col("x"))))
    assert [r for r in df.collect() if repr(r.a) != repr(r.b)] == []


def test_hits_in_blocks_carry_columns(spark, sf, monkeypatch):
    """The query's hits in blocks that are shuffled, and none by way of cut pieces."""
    from cellforge.plans.catalog import QUERIES

    rows = lambda: sorted(map(tuple, QUERIES["interpolated_hits"](spark, sf).collect()))
    want = rows()
    assert len(want) > 5000
    monkeypatch.setattr(spatial, "SENT_PIECES", 0)
    monkeypatch.setattr(spatial, "BLOCK", 32)
    monkeypatch.setattr(spatial, "cut_up", None)
    assert rows() == want


def test_close_points_of_a_crowded_cell_are_shared_by_tasks(spark, monkeypatch):
    """All in one cell, beside a few around it, with unknown numbers: the pairs of all pairs, from several tasks."""
    monkeypatch.setattr(spatial, "BLOCK", 16)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rng = np.random.default_rng(2)
    pts = [(i, i % 3, *map(float, rng.random(3) * 0.29 + 0.305)) for i in range(150)] + [(i, i % 3, *map(float, rng.normal(size=3) * 0.5)) for i in range(150, 200)]
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and a[1] != b[1] and sum((x - y) * (x - y) for x, y in zip(a[2:], b[2:])) ** 0.5 < 0.3}
    pts += [(300, None, 0.4, 0.4, 0.4), (301, 0, None, 0.4, 0.4), (None, 1, 0.4, 0.4, 0.4)]
    df = spark.createDataFrame(pts, "point_id long, g int, x double, y double, z double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [tuple(r) for r in spatial.close_vertices(df, 0.3, "g").select("a", "b", F.spark_partition_id()).collect()]
        every = spatial.close_vertices(df, 0.3).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(got) == len(want) and {r[:2] for r in got} == want
    shares = [sum(r[2] == k for r in got) for k in {r[2] for r in got}]
    assert len(shares) >= 3 and max(shares) < 0.8 * len(got)
    assert every == sum(a[0] < b[0] and sum((x - y) * (x - y) for x, y in zip(a[2:], b[2:])) ** 0.5 < 0.3 for a in pts[:200] + [pts[200]] for b in pts[:200] + [pts[200]])
