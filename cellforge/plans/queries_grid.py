"""Queries over voxel grids: cells, filters, labelling, stencils, encodings, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellforge.functions import cells as K
from cellforge.functions.geometry import hsv_to_rgb, hue
from cellforge.functions.vec import Vec
from cellforge.operators import encode, fracture, grid, metadata, morphology, seeding

from .fixtures import DIMS, LO, N, POINTS_SQL, SEEDS, SIZE, grid as cells_of, grid_sql, labelled, labelled_sql, points, seed_sql, seed_table, shell, shell_sql, table
from .registry import query

D = (N, N, N)
AT = Vec.cols("x", "y", "z")
N26 = "o AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i))"
N6 = "o(dx, dy, dz) AS (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1))"


@query(f"WITH {labelled_sql()} SELECT value AS fragment, row_number() OVER (ORDER BY value) - 1 AS fragment_id, count(*) AS voxels, sum(count(*)) OVER ()::BIGINT AS occupied, count(*) / sum(count(*)) OVER () AS percentage FROM lab GROUP BY value")
def nearest_seed_fragments(spark, sf):
    """Fragments by nearest seed with voxels and share: JN1, AGG1, AGG3."""
    return metadata.fragment_shares(labelled(spark, sf)).select(F.col("value").alias("fragment"), F.col("fragment_id").cast("long").alias("fragment_id"), "voxels", "occupied", "percentage")


for _metric in ("manhattan", "chebyshev"):

    @query(f"WITH {labelled_sql(metric=_metric)} SELECT * FROM lab", name=f"nearest_seed_{_metric}")
    def nearest_metric(spark, sf, metric=_metric):
        """JN2."""
        return fracture.nearest_seed(cells_of(spark, sf), SEEDS, fracture.FractureParams(metric=metric)).drop("grid_id")


@query(
    "WITH g AS (SELECT DISTINCT l_linenumber::BIGINT AS grid_id, (l_orderkey % 32)::INT AS x, (l_partkey % 32)::INT AS y, (l_suppkey % 32)::INT AS z FROM lineitem), "
    "s AS (SELECT grid_id, (row_number() OVER (PARTITION BY grid_id ORDER BY x, y, z) + 1)::INT AS seed_id, x AS sx, y AS sy, z AS sz FROM (SELECT * FROM g WHERE x % 16 = 3 AND y % 16 = 5 AND z % 4 = 1)) "
    "SELECT g.grid_id, x, y, z, (min(((x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz))::BIGINT * 65536 + seed_id) % 65536)::INT AS value FROM g JOIN s USING (grid_id) GROUP BY 1, 2, 3, 4"
)
def nearest_seed_many_grids(spark, sf):
    """JN1 for a table of seeds: one run per line number."""
    from pyspark.sql import Window

    g = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("grid_id"), *[(F.col(c) % 32).cast("int").alias(a) for c, a in (("l_orderkey", "x"), ("l_partkey", "y"), ("l_suppkey", "z"))]).distinct().withColumn("value", F.lit(1))
    s = g.where("x % 16 = 3 and y % 16 = 5 and z % 4 = 1").select("grid_id", (F.row_number().over(Window.partitionBy("grid_id").orderBy("x", "y", "z")) + 1).alias("seed_id"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"))
    return fracture.nearest_seed(g, s)


@query(
    f"WITH {labelled_sql(16)}, {seed_sql()}, e(seed_id, sx, sy, sz) AS (SELECT 100 + x * 256 + y * 16 + z, x, y, z FROM g WHERE x % 5 = 0 AND y % 5 = 1 AND z % 5 = 2), "
    "n AS (SELECT e.*, (min(((e.sx - s.sx) * (e.sx - s.sx) + (e.sy - s.sy) * (e.sy - s.sy) + (e.sz - s.sz) * (e.sz - s.sz))::BIGINT * 65536 + s.seed_id) % 65536)::INT AS fragment FROM e, s GROUP BY ALL) "
    "SELECT fragment AS seed_id, row_number() OVER (PARTITION BY fragment ORDER BY seed_id) AS sub_seed, sx, sy, sz FROM n"
)
def merge_seeds(spark, sf):
    """JN3, WIN7."""
    extra = cells_of(spark, sf, 16).where("x % 5 = 0 and y % 5 = 1 and z % 5 = 2").select("grid_id", (F.lit(100) + F.col("x") * 256 + F.col("y") * 16 + F.col("z")).alias("seed_id"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"))
    return seeding.merge_seeds(seed_table(spark), extra).drop("grid_id").withColumn("sub_seed", F.col("sub_seed").cast("long"))


REACH = 21.0


@query(
    f"WITH {grid_sql()}, {seed_sql()}, n AS (SELECT x, y, z, min(((2*x-2*sx-1)*(2*x-2*sx-1) + (2*y-2*sy-1)*(2*y-2*sy-1) + (2*z-2*sz-1)*(2*z-2*sz-1))::BIGINT * 65536 + seed_id) AS p FROM g, s GROUP BY 1, 2, 3) "
    f"SELECT x, y, z, CASE WHEN p // 65536 < {4 * REACH * REACH} THEN (p % 65536)::INT ELSE 1 END AS value FROM n"
)
def voronoi_fragments(spark, sf):
    """JN4."""
    return fracture.voronoi(cells_of(spark, sf), SEEDS, REACH).drop("grid_id")


@query(f"WITH {labelled_sql()}, {N26} SELECT a.x, a.y, a.z, a.value, bool_or(b.value <> a.value) AS is_boundary FROM lab a, o LEFT JOIN lab b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3, 4")
def fragment_boundaries(spark, sf):
    """JN5."""
    return morphology.boundary_flags(labelled(spark, sf)).drop("grid_id")


@query(
    f"WITH {labelled_sql()}, {POINTS_SQL}, c AS (SELECT *, "
    + ", ".join(f"least(greatest(floor(({k} + 4) / 0.25), 0), 31)::INT AS c{k}" for k in "xyz")
    + " FROM p) SELECT point_id, cx, cy, cz, coalesce(lab.value, 0) AS label FROM c LEFT JOIN lab ON lab.x = cx AND lab.y = cy AND lab.z = cz"
)
def point_labels(spark, sf):
    """PRJ1, JN6, JN7."""
    from cellforge.operators.spatial import label_points

    p = points(spark, sf).drop("cloud_id")
    return label_points(p, labelled(spark, sf), LO, SIZE, DIMS).select("point_id", "cx", "cy", "cz", "label")


@query(f"WITH {grid_sql()} SELECT x, y, z, x::BIGINT * 1024 + y * 32 + z AS i, x AS rx, y AS ry, z AS rz FROM g")
def cell_indices(spark, sf):
    """PRJ2, PRJ3."""
    g = cells_of(spark, sf).withColumn("i", K.cell_index(AT, D))
    return g.select("x", "y", "z", "i", *K.index_cell(F.col("i"), D).named("r"))


@query(f"WITH {grid_sql()} SELECT x, y, z, x / 4 - 4 AS min_x, y / 4 - 4 AS min_y, z / 4 - 4 AS min_z, (x + 1) / 4 - 4 AS max_x, (y + 1) / 4 - 4 AS max_y, (z + 1) / 4 - 4 AS max_z FROM g")
def cell_boxes(spark, sf):
    """PRJ4, FLT1."""
    lo, hi = K.cell_box(AT, Vec.of(*LO), Vec.of(*SIZE))
    return grid.occupied(cells_of(spark, sf)).select("x", "y", "z", *lo.named("min_"), *hi.named("max_"))


@query(
    f"WITH {labelled_sql()}, w AS (SELECT x, y, z, value, (x + y + z) % 100 AS sub_seed, (x + y) % 2 = 0 AS is_boundary, value | (((x + y + z) % 100) << 8) | (CASE WHEN (x + y) % 2 = 0 THEN 32768 ELSE 0 END) AS word FROM lab) "
    "SELECT x, y, z, word::INT AS word, value AS fragment, sub_seed::INT AS sub_seed, is_boundary, (word & 32767)::INT AS unmasked, (word & 255)::INT AS id_only, 1 AS homogenized, least(value, 2) AS reset FROM w"
)
def cell_words(spark, sf):
    """PRJ10, PRJ11, PRJ12, FN10, EXT5."""
    w = labelled(spark, sf).withColumn("word", K.pack(F.col("value"), ((F.col("x") + F.col("y") + F.col("z")) % 100).cast("int"), (F.col("x") + F.col("y")) % 2 == 0)).withColumn("u", K.unpack(F.col("word")))
    return w.select("x", "y", "z", "word", "u.fragment", "u.sub_seed", "u.is_boundary", K.without_boundary(F.col("word")).alias("unmasked"), K.without_sub_seed(F.col("word")).alias("id_only"), K.homogenize(F.col("value")).alias("homogenized"), K.reset_filling(F.col("value")).alias("reset"))


@query(f"WITH {labelled_sql(16)} SELECT x, y, z, value FROM lab")
def nested_round_trip(spark, sf):
    """PRJ14: cells to nested arrays and back."""
    return grid.from_nested(grid.to_nested(labelled(spark, sf, 16), (16, 16, 16))).drop("grid_id")


@query(
    f"WITH {labelled_sql(16)} SELECT i AS x, j AS y, k AS z, coalesce(lab.value, 1) AS value FROM range(16) a(i), range(16) b(j), range(16) c(k) LEFT JOIN lab ON lab.x = i AND lab.y = j AND lab.z = k".replace("i AS x, j AS y, k AS z", "i::INT AS x, j::INT AS y, k::INT AS z")
)
def dense_cells(spark, sf):
    """PRJ13, SNK4: every cell, empty ones filled."""
    return grid.densify(labelled(spark, sf, 16), (16, 16, 16), 1).drop("grid_id")


@query(
    f"WITH {shell_sql(16)} SELECT i::INT AS x, j::INT AS y, k::INT AS z, 1 AS value FROM range(18) a(i), range(18) b(j), range(18) c(k) LEFT JOIN g ON g.x = i - 1 AND g.y = j - 1 AND g.z = k - 1"
)
def padded_grid(spark, sf):
    """MSH6."""
    from cellforge.operators.surface import pad_free

    return pad_free(shell(spark, sf, 16), (16, 16, 16)).drop("grid_id")


@query("SELECT n_nationkey, round(h, 6) AS hue, round(v - v * s * greatest(0, least(k5, 4 - k5, 1)), 6) AS r, round(v - v * s * greatest(0, least(k3, 4 - k3, 1)), 6) AS g, round(v - v * s * greatest(0, least(k1, 4 - k1, 1)), 6) AS b FROM (SELECT *, 0.8 AS s, 0.9 AS v, (h / 60 + 5) - 6 * floor((h / 60 + 5) / 6) AS k5, (h / 60 + 3) - 6 * floor((h / 60 + 3) / 6) AS k3, (h / 60 + 1) - 6 * floor((h / 60 + 1) / 6) AS k1 FROM (SELECT n_nationkey, (n_nationkey * 0.618033988749895::DOUBLE - floor(n_nationkey * 0.618033988749895::DOUBLE)) * 360 AS h FROM nation))")
def fragment_colors(spark, sf):
    """PRJ15."""
    h = hue(F.col("n_nationkey"))
    return table(spark, sf, "nation").select("n_nationkey", F.round(h, 6).alias("hue"), *[F.round(c, 6).alias(n) for c, n in zip(hsv_to_rgb(h, F.lit(0.8), F.lit(0.9)), "rgb")])


@query("WITH e AS (SELECT p_partkey, p_size * 0.5 AS x, p_size * 0.25 + 1 AS y, p_retailprice / 100 AS z FROM part), m AS (SELECT *, greatest(x, y, z) AS l, greatest(ceil(x * 8), ceil(y * 8), ceil(z * 8)) > 128 AS over FROM e) SELECT p_partkey, (ceil((CASE WHEN over THEN floor(x * 128 / l) ELSE ceil(x * 8) END) / 4) * 4)::INT AS dx, (CASE WHEN over THEN floor(y * 128 / l) ELSE ceil(y * 8) END)::INT AS dy, (ceil((CASE WHEN over THEN floor(z * 128 / l) ELSE ceil(z * 8) END) / 4) * 4)::INT AS dz, least(ceil(floor(x * 128 / l) / 4) * 4, 128)::INT AS ix, least(ceil(floor(y * 128 / l) / 4) * 4, 128)::INT AS iy, least(ceil(floor(z * 128 / l) / 4) * 4, 128)::INT AS iz FROM m")
def grid_sizes(spark, sf):
    """PRJ8, PRJ9."""
    e = Vec(F.col("p_size") * 0.5, F.col("p_size") * 0.25 + 1, F.col("p_retailprice") / 100)
    return table(spark, sf, "part").select("p_partkey", *K.grid_size(e, 8, 128).named("d"), *K.grid_size_interactive(e, 128).named("i"))


@query(f"WITH {shell_sql()}, o AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)) SELECT g.x, g.y, g.z, bool_or(h.x IS NULL) AS is_surface FROM g JOIN o ON g.x + dx BETWEEN 0 AND 23 AND g.y + dy BETWEEN 0 AND 23 AND g.z + dz BETWEEN 0 AND 23 LEFT JOIN g h ON h.x = g.x + dx AND h.y = g.y + dy AND h.z = g.z + dz GROUP BY 1, 2, 3")
def surface_flags(spark, sf):
    """FLT2."""
    return grid.surface_flags(shell(spark, sf), (24, 24, 24)).drop("grid_id", "value")


@query(f"WITH {shell_sql()}, o AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)), f AS (SELECT g.x, g.y, g.z, bool_or(h.x IS NULL) AS s FROM g JOIN o ON g.x + dx BETWEEN 0 AND 23 AND g.y + dy BETWEEN 0 AND 23 AND g.z + dz BETWEEN 0 AND 23 LEFT JOIN g h ON h.x = g.x + dx AND h.y = g.y + dy AND h.z = g.z + dz GROUP BY 1, 2, 3) SELECT 'outer' AS location, count(*) FILTER (WHERE s) AS n FROM f UNION ALL SELECT 'inner', count(*) FILTER (WHERE NOT s) FROM f UNION ALL SELECT 'both', count(*) FROM f")
def seed_locations(spark, sf):
    """FLT4."""
    out = None
    for where in ("outer", "inner", "both"):
        part = seeding.candidates(shell(spark, sf), (24, 24, 24), where).agg(F.count("*").alias("n")).select(F.lit(where).alias("location"), "n")
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {grid_sql()} SELECT count(*) > 0 AS found FROM g")
def any_occupied(spark, sf):
    """FLT3."""
    return spark.createDataFrame([(grid.any_occupied(cells_of(spark, sf)),)], "found boolean")


# iteration

#: Seeds on a lattice of the grid, which has gaps; those on empty cells take no part.
FLOOD_SEEDS = [(2 + n, x, y, z) for n, (x, y, z) in enumerate((x, y, z) for x in (4, 22) for y in (4, 22) for z in (4, 22))]
_FLOOD = (
    f"WITH RECURSIVE {{cells}}, sd(lab, x, y, z) AS (VALUES {', '.join(str(s) for s in FLOOD_SEEDS)}), {{o}}, "
    "r(x, y, z, lab, lvl) USING KEY (x, y, z) AS (SELECT sd.x, sd.y, sd.z, lab, 0 FROM sd JOIN g USING (x, y, z) UNION "
    "SELECT g.x, g.y, g.z, min(r.lab), min(r.lvl) + 1 FROM r, o, g WHERE g.x = r.x + dx AND g.y = r.y + dy AND g.z = r.z + dz AND NOT EXISTS (SELECT 1 FROM recurring.r q WHERE q.x = g.x AND q.y = g.y AND q.z = g.z) GROUP BY 1, 2, 3) "
    "SELECT x, y, z, lab AS value, lvl AS level FROM r"
)


@query(_FLOOD.format(cells=grid_sql(), o=N6))
def flood_fragments(spark, sf):
    """ITR1 over the six-neighbourhood."""
    return fracture.flood(cells_of(spark, sf), seed_table(spark, FLOOD_SEEDS), 6, block=16).drop("grid_id")


@query(_FLOOD.format(cells=grid_sql(), o=N26))
def flood_fragments_26(spark, sf):
    """ITR1 over the 26-neighbourhood."""
    return fracture.flood(cells_of(spark, sf), seed_table(spark, FLOOD_SEEDS), 26, block=16).drop("grid_id")


@query(_FLOOD.format(cells=grid_sql(), o=N6))
def flood_by_frontier(spark, sf):
    """ITR1 as joins, for grids beyond one task."""
    return fracture.flood_frontier(cells_of(spark, sf), seed_table(spark, FLOOD_SEEDS), 6).drop("grid_id")


def _sub_seeds(spark):
    rows = [(0, 2, 1, 1, 1, 1), (0, 2, 2, 14, 14, 14), (0, 2, 3, 1, 14, 2), (0, 3, 1, 14, 2, 3), (0, 3, 2, 8, 8, 1), (0, 4, 1, 2, 9, 14)]
    return spark.createDataFrame(rows, "grid_id long, seed_id int, sub_seed int, sx int, sy int, sz int")


@query(None)
def flood_repaired(spark, sf):
    """ITR1 to ITR4, without SQL: an iteration within an iteration; tests check connectedness and against a plain version."""
    return fracture.flood_repaired(cells_of(spark, sf, 16), _sub_seeds(spark), 6, block=8).drop("grid_id")


@query(f"WITH {labelled_sql(16)} SELECT value, min((x + y * 3 + z * 7) % 5 + 1) AS sub_seed FROM lab GROUP BY value")
def least_sub_seeds(spark, sf):
    """ITR3."""
    return fracture.least_sub_seed(labelled(spark, sf, 16).withColumn("sub_seed", (F.col("x") + F.col("y") * 3 + F.col("z") * 7) % 5 + 1)).drop("grid_id")


_PARTS = "CASE WHEN (x // 4 + y // 4) % 2 = 0 THEN 2 ELSE 3 END"
_PART_SEEDS = [(2 + (x // 4 + y // 4) % 2, x, y, z) for x, y, z in ((1, 1, 1), (5, 1, 1), (9, 2, 20), (17, 21, 7), (14, 30, 30), (26, 9, 13), (22, 13, 4))]


@query(
    f"WITH RECURSIVE {grid_sql()}, lab AS (SELECT x, y, z, {_PARTS} AS value FROM g), sd(v, x, y, z) AS (VALUES {', '.join(map(str, _PART_SEEDS))}), {N6}, "
    "r(x, y, z) USING KEY (x, y, z) AS (SELECT lab.x, lab.y, lab.z FROM sd JOIN lab USING (x, y, z) WHERE sd.v = lab.value UNION "
    "SELECT b.x, b.y, b.z FROM r JOIN lab a USING (x, y, z), o, lab b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND b.value = a.value AND NOT EXISTS (SELECT 1 FROM recurring.r q WHERE q.x = b.x AND q.y = b.y AND q.z = b.z) GROUP BY 1, 2, 3) "
    "SELECT lab.x, lab.y, lab.z, lab.value FROM r JOIN lab USING (x, y, z)"
)
def connected_fragments(spark, sf):
    """ITR5, ITR6."""
    lab = cells_of(spark, sf).withColumn("value", F.when((F.floor(F.col("x") / 4) + F.floor(F.col("y") / 4)) % 2 == 0, 2).otherwise(3))
    return fracture.keep_connected(lab, seed_table(spark, _PART_SEEDS), block=8).drop("grid_id")


def _erosion_sql(kind: str, size: int, probability: float, threshold: float) -> str:
    offsets, share = morphology.structuring_element(kind, size)
    r = size // 2
    rows = ", ".join(f"({x}, {y}, {z})" for x, y, z in offsets)
    window = " * ".join(f"(least({c} + {r}, {N - 1}) - greatest({c} - {r}, 0) + 1)" for c in "xyz")
    return (
        f"WITH {labelled_sql()}, {N26}, m(dx, dy, dz) AS (VALUES {rows}), "
        "near AS (SELECT a.x, a.y, a.z, bool_or(b.value <> a.value) AS edge FROM lab a, o JOIN lab b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3), "
        "same AS (SELECT a.x, a.y, a.z, count(*) AS n FROM lab a, m JOIN lab b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND b.value = a.value GROUP BY 1, 2, 3), "
        f"kept AS (SELECT lab.* FROM lab JOIN near USING (x, y, z) JOIN same USING (x, y, z) WHERE NOT (edge AND {K.noise_sql('x', 'y', 'z', 0)} < {probability} AND n / ({window}) < {share * threshold}::DOUBLE)) "
        "SELECT a.x, a.y, a.z, a.value FROM kept a, o JOIN kept b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND b.value = a.value GROUP BY ALL HAVING count(*) > 6"
    )


for _kind, _size in (("square", 3), ("cross", 3), ("ellipse", 5)):

    @query(_erosion_sql(_kind, _size, 0.6, 0.9), name=f"erode_{_kind}")
    def erode(spark, sf, kind=_kind, size=_size):
        """ITR7, ITR8, ITR9."""
        return morphology.erode(labelled(spark, sf), D, kind, size, 0.6, 0.9).drop("grid_id")


@query(f"WITH {labelled_sql()}, {N26} SELECT a.x, a.y, a.z, a.value FROM lab a, o JOIN lab b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND b.value = a.value GROUP BY ALL HAVING count(*) > 6")
def despeckle(spark, sf):
    """ITR9."""
    return morphology.despeckle(labelled(spark, sf)).drop("grid_id")


@query(
    f"WITH {shell_sql(16)}, d AS (SELECT i::INT AS x, j::INT AS y, k::INT AS z, g.x IS NOT NULL AS f FROM range(16) a(i), range(16) b(j), range(16) c(k) LEFT JOIN g ON g.x = i AND g.y = j AND g.z = k), "
    "s AS (SELECT *, f AND NOT coalesce(lag(f) OVER (PARTITION BY y, z ORDER BY x), false) AS sx, f AND NOT coalesce(lag(f) OVER (PARTITION BY x, z ORDER BY y), false) AS sy, f AND NOT coalesce(lag(f) OVER (PARTITION BY x, y ORDER BY z), false) AS sz FROM d), "
    "c AS (SELECT x, y, z, f, "
    + ", ".join(
        f"coalesce(sum(s{a}::INT) OVER (PARTITION BY {b} ORDER BY {a} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 + coalesce(sum(s{a}::INT) OVER (PARTITION BY {b} ORDER BY {a} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) % 2 AS v{a}"
        for a, b in (("x", "y, z"), ("y", "x, z"), ("z", "x, y"))
    )
    + " FROM s) SELECT x, y, z FROM c WHERE NOT f AND vx + vy + vz >= 4"
)
def parity_fill(spark, sf):
    """ITR16."""
    return grid.parity_fill(shell(spark, sf, 16), (16, 16, 16)).drop("grid_id")


@query(f"WITH {POINTS_SQL}, c AS (SELECT *, least(greatest(floor((x + 4) / 0.5), 0), 15)::INT AS cx, least(greatest(floor((y + 4) / 0.5), 0), 15)::INT AS cy, least(greatest(floor((z + 4) / 0.5), 0), 15)::INT AS cz FROM p) SELECT cloud_id AS grid_id, cx AS x, cy AS y, cz AS z, arg_max(point_id, point_id)::INT AS value FROM c GROUP BY ALL")
def inserted_points(spark, sf):
    """MSH5."""
    c = K.cell_of(AT, Vec.of(*LO), Vec.of(0.5, 0.5, 0.5), (16, 16, 16))
    p = points(spark, sf).select(F.col("cloud_id").alias("grid_id"), *c.named(""), F.col("point_id").alias("ord"), F.col("point_id").cast("int").alias("v"))
    return grid.insert_points(p, "ord", "v")


# encodings and aggregates


def _rle_sql(n: int) -> str:
    return (
        f"WITH {labelled_sql(n)}, d AS (SELECT i, coalesce(lab.value, 0) AS value FROM range({n**3}) t(i) LEFT JOIN lab ON lab.x::BIGINT * {n * n} + lab.y * {n} + lab.z = i), "
        "m AS (SELECT *, CASE WHEN lag(value) OVER (ORDER BY i) = value THEN 0 ELSE 1 END AS b FROM d), r AS (SELECT *, sum(b) OVER (ORDER BY i) AS run FROM m) "
        "SELECT min(i) AS start, any_value(value) AS value, count(*) AS length FROM r GROUP BY run"
    )


@query(_rle_sql(N))
def run_lengths(spark, sf):
    """SNK2."""
    return encode.run_lengths(labelled(spark, sf), D).drop("grid_id")


def _source_folder(spark) -> str:
    import uuid

    from cellforge.lineage import checkpoint_folder, passing
    from cellforge.sources.formats import register

    register(spark)
    return passing(spark, f"{checkpoint_folder(spark)}/source-{uuid.uuid4().hex}")


@query(_rle_sql(N))
def rle_source(spark, sf):
    """SNK1, SNK2, SRC6, EXT6: run lengths written and read as a data source, in parts by records; starts by a scan of the lengths."""
    from cellforge.operators.scan import global_scan

    at = _source_folder(spark)
    runs = encode.run_lengths(labelled(spark, sf), D).select("start", "value", "length")
    runs.coalesce(1).sortWithinPartitions("start").select("value", "length").write.format("cellforge_rle").option("dims", f"{N},{N},{N}").mode("append").save(at)
    back = spark.read.format("cellforge_rle").option("partBytes", 4096).load(at)
    return global_scan(back.select("record", "value", "length"), ["record"], value="length").select(F.col("before").alias("start"), "value", "length")


@query(f"WITH {POINTS_SQL} SELECT round(x::FLOAT, 5)::DOUBLE AS x, round(y::FLOAT, 5)::DOUBLE AS y, round(z::FLOAT, 5)::DOUBLE AS z FROM p")
def ply_source(spark, sf):
    """SRC9, SRC11, SNK10, SNK1: points written and read as a data source, a file from each task."""
    at = _source_folder(spark)
    points(spark, sf).repartition(3, "point_id").select("x", "y", "z").write.format("cellforge_ply").mode("append").save(at)
    back = spark.read.format("cellforge_ply").load(at)
    return back.select(*[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in "xyz"])


@query(f"WITH {labelled_sql()} SELECT * FROM lab")
def run_length_round_trip(spark, sf):
    """SNK2, SRC6: to run-length files and back."""
    from cellforge.sources.binary import encode_rle, rle_cells

    files = encode_rle(labelled(spark, sf), D).select(F.col("grid_id").cast("string").alias("name"), "content")
    return rle_cells(files, flip_y=False).drop("name")


@query(f"WITH {labelled_sql()} SELECT x, y, z, value FROM lab")
def raw_round_trip(spark, sf):
    """SNK4, SNK5."""
    from cellforge.sources.binary import encode_raw, raw_cells

    files = encode_raw(labelled(spark, sf), D).select(F.col("grid_id").cast("string").alias("name"), "content")
    return raw_cells(files, D).drop("name")


@query(f"WITH {labelled_sql()} SELECT kind, x, y, z, value FROM lab, (VALUES ('rle'), ('raw')) k(kind) UNION ALL SELECT 'vox', x, z, y, value - 1 FROM lab WHERE value > 1")
def grid_formats(spark, sf):
    """SNK1, SNK14: the grid in each format by name, zipped, unzipped and read again."""
    from cellforge.sources.binary import GRID_FORMATS, encode_grids, raw_cells, rle_cells, unzipped, vox_cells, zipped

    out = None
    for kind in GRID_FORMATS:
        files = unzipped(zipped(encode_grids(labelled(spark, sf), D, kind), "grid_id", GRID_FORMATS[kind][1]))
        cells = {"rle": lambda f: rle_cells(f, flip_y=False), "raw": lambda f: raw_cells(f, D), "vox": vox_cells}[kind](files)
        part = cells.select(F.lit(kind).alias("kind"), "x", "y", "z", "value")
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {labelled_sql()} SELECT x, z AS y, y AS z, value - 1 AS color FROM lab WHERE value > 1")
def vox_cells(spark, sf):
    """SNK6."""
    return encode.vox_records(labelled(spark, sf)).drop("grid_id")


@query(f"WITH {labelled_sql()} SELECT x, y + 4 AS y, z + 8 AS z, value FROM lab WHERE y < 24 AND z < 16")
def centred_cube(spark, sf):
    """SNK4: cells of an uneven grid centred in the cube of its longest side."""
    return encode.to_cube(labelled(spark, sf).where("y < 24 and z < 16"), (32, 24, 16)).drop("grid_id")


_COLUMNS = (
    f"{labelled_sql()}, d AS (SELECT i::INT AS x, j::INT AS y, k::INT AS z, coalesce(lab.value, 0) AS value FROM range(32) a(i), range(32) b(j), range(32) c(k) LEFT JOIN lab ON lab.x = i AND lab.y = j AND lab.z = k), "
    "m AS (SELECT *, CASE WHEN lag(value) OVER w = value THEN 0 ELSE 1 END AS b FROM d WINDOW w AS (PARTITION BY x, y ORDER BY z)), r AS (SELECT *, sum(b) OVER (PARTITION BY x, y ORDER BY z) AS run FROM m), "
    "q AS (SELECT x, y, run, any_value(value) AS value, count(*) AS n FROM r GROUP BY 1, 2, 3)"
)


@query(f"WITH {_COLUMNS} SELECT x, y, string_agg(value || ':' || n, ',' ORDER BY run) AS runs FROM q GROUP BY 1, 2")
def column_runs(spark, sf):
    """AGG11."""
    c = encode.column_runs(labelled(spark, sf), D)
    return c.select("x", "y", F.array_join(F.transform("runs", lambda s: F.concat(s["value"].cast("string"), F.lit(":"), s["length"].cast("string"))), ",").alias("runs"))


@query(
    f"WITH {_COLUMNS}, c AS (SELECT x, y, string_agg(value::VARCHAR, ',' ORDER BY run) AS seq FROM q GROUP BY 1, 2), l AS (SELECT unnest(range(0, 4))::INT AS level), "
    "b AS (SELECT level, (x >> level)::INT AS qx, (y >> level)::INT AS qy, min(seq) AS values FROM c, l GROUP BY 1, 2, 3 HAVING min(seq) = max(seq) AND count(*) = 1 << (2 * level)) "
    "SELECT b.* FROM b LEFT JOIN b p ON p.level = b.level + 1 AND p.qx = b.qx >> 1 AND p.qy = b.qy >> 1 WHERE p.level IS NULL"
)
def quad_columns(spark, sf):
    """AGG12, SNK3."""
    return encode.quad_columns(encode.column_runs(labelled(spark, sf), D), 3).drop("grid_id")


@query(f"WITH {_COLUMNS} SELECT 65536 AS plain_bytes, count(*) * 4 AS run_bytes, 65536.0::DOUBLE / (count(*) * 4) AS ratio FROM q")
def compression_ratio(spark, sf):
    """AGG13."""
    return encode.compression_ratio(encode.column_runs(labelled(spark, sf), D), D).drop("grid_id")


@query(f"WITH {labelled_sql()} SELECT value, count(*) AS voxels FROM lab GROUP BY 1")
def fragment_sizes(spark, sf):
    """AGG1, WIN10."""
    return metadata.fragment_sizes(labelled(spark, sf)).drop("grid_id").orderBy("value")


@query(f"WITH {labelled_sql()} SELECT count(*) AS voxels FROM lab WHERE value > 1")
def occupied_voxels(spark, sf):
    """AGG2."""
    return metadata.occupied_count(labelled(spark, sf)).drop("grid_id")


@query(f"WITH {grid_sql()} SELECT max(n) AS most FROM (SELECT count(*) AS n FROM g GROUP BY x // 8, y // 8, z // 8)")
def quadrant_occupancy(spark, sf):
    """AGG4."""
    return metadata.quadrant_occupancy(cells_of(spark, sf), 8).drop("grid_id")


# seeds

_NOISE = K.noise_sql("x", "y", "z", 3)
_SURFACE = "o AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)), f AS (SELECT g.x, g.y, g.z FROM g JOIN o ON g.x + dx BETWEEN 0 AND 23 AND g.y + dy BETWEEN 0 AND 23 AND g.z + dz BETWEEN 0 AND 23 LEFT JOIN g h ON h.x = g.x + dx AND h.y = g.y + dy AND h.z = g.z + dz GROUP BY 1, 2, 3 HAVING bool_or(h.x IS NULL))"


@query(f"WITH {shell_sql()}, {_SURFACE}, n AS (SELECT *, row_number() OVER (ORDER BY {_NOISE}, x, y, z) AS r FROM f) SELECT (row_number() OVER (ORDER BY x, y, z) + 1)::INT AS seed_id, x AS sx, y AS sy, z AS sz FROM n WHERE r <= 12")
def uniform_seeds(spark, sf):
    """SMP6, SMP8, SMP11, WIN12, SET4."""
    return seeding.uniform_seeds(shell(spark, sf), 12, (24, 24, 24), "outer", seed=3).drop("grid_id")


_LAWS = {
    "normal": f"least(greatest(sqrt(-2 * ln(greatest({_NOISE}, 1e-12))) * cos(6.283185307179586 * {K.noise_sql('x', 'y', 'z', 4)}) * 0.25 + 0.5, 0), 1)",
    "halton": "(SELECT sum(((i // pow(2, k)::BIGINT) % 2) / pow(2, k + 1)) FROM range(0, 32) d(k))",
}
for _law in _LAWS:

    @query(
        f"WITH {shell_sql()}, {_SURFACE}, i AS (SELECT *, x::BIGINT * 1048576 + y * 1024 + z + 3 AS i FROM f), n AS (SELECT *, row_number() OVER (ORDER BY round(u, 9), x, y, z) AS r FROM (SELECT *, {_LAWS[_law]} AS u FROM i)) "
        "SELECT (row_number() OVER (ORDER BY x, y, z) + 1)::INT AS seed_id, x AS sx, y AS sy, z AS sz FROM n WHERE r <= 12",
        name=f"{_law}_seeds",
    )
    def law_seeds(spark, sf, law=_law):
        """SMP8, EXT4."""
        return seeding.uniform_seeds(shell(spark, sf), 12, (24, 24, 24), "outer", law=law, seed=3).drop("grid_id")


@query(
    f"WITH {shell_sql()}, {_SURFACE}, s(seed_id, sx, sy, sz) AS (VALUES (2, 1, 12, 12), (3, 20, 12, 12)), h AS (SELECT * FROM s ORDER BY {K.noise_sql('sx', 'sy', 'sz', 5)}, seed_id LIMIT 1), "
    "w AS (SELECT f.*, least(abs(x - sx), 24 - abs(x - sx)) AS a, least(abs(y - sy), 24 - abs(y - sy)) AS b, least(abs(z - sz), 24 - abs(z - sz)) AS c FROM f, h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.sx = f.x AND s.sy = f.y AND s.sz = f.z)), "
    f"n AS (SELECT x, y, z, row_number() OVER (ORDER BY pow({K.noise_sql('x', 'y', 'z', 6)}, 0.5) * sqrt((a * a + b * b + c * c)::DOUBLE), x, y, z) AS r FROM w WHERE a * a + b * b + c * c <= 144) "
    "SELECT * FROM s UNION ALL SELECT (row_number() OVER (ORDER BY x, y, z) + 3)::INT, x, y, z FROM n WHERE r <= 9"
)
def near_seeds(spark, sf):
    """SMP7, SET2."""
    return seeding.near_seeds(shell(spark, sf), seed_table(spark, [(2, 1, 12, 12), (3, 20, 12, 12)]), 9, (24, 24, 24), seed=5).drop("grid_id")


@query(
    "SELECT i AS id, "
    + ", ".join("round(" + " + ".join(f"((i // {b ** k}) % {b}) / {float(b ** (k + 1))}" for k in range(20)) + f", 9) AS h{b}" for b in (2, 3, 5))
    + " FROM (SELECT vec_id AS i FROM embeddings)"
)
def halton_points(spark, sf):
    """SMP9, SMP10."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *[F.round(K.halton(F.col("vec_id"), b, 20), 9).alias(f"h{b}") for b in (2, 3, 5)])


@query(
    "WITH c AS (SELECT DISTINCT (l_orderkey % 32)::INT AS cx, (l_partkey % 27)::INT AS cy FROM lineitem), "
    f"h AS (SELECT i, {' + '.join(f'((i // {2 ** k}) % 2) * {2 ** (4 - k)}' for k in range(5))} AS cx, {' + '.join(f'((i // {3 ** k}) % 3) * {3 ** (2 - k)}' for k in range(3))} AS cy FROM range({3 * 32 * 27}) t(i)) "
    "SELECT c.cx, c.cy, (row_number() OVER (PARTITION BY c.cx, c.cy ORDER BY i) - 1)::INT AS n, i AS halton_index FROM c JOIN h ON h.cx = c.cx AND h.cy = c.cy"
)
def halton_cells(spark, sf):
    """SMP10: for each occupied cell the first three indices of the Halton sequence that fall into it."""
    c = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 32).cast("int").alias("cx"), (F.col("l_partkey") % 27).cast("int").alias("cy")).distinct()
    return c.select("cx", "cy", F.posexplode(K.halton_indices(F.col("cx"), F.col("cy"), 5, 3, 3)).alias("n", "halton_index"))


@query(f"WITH {grid_sql()} SELECT x, y, z, round({K.noise_sql('x', 'y', 'z', 9)}, 9) AS u FROM g")
def cell_noise(spark, sf):
    """SMP11, SMP13, FN18."""
    return cells_of(spark, sf).select("x", "y", "z", F.round(K.noise(AT, 9), 9).alias("u"))


_SPREAD = "(({0}) & 1) | ((({0}) & 2) << 2) | ((({0}) & 4) << 4) | ((({0}) & 8) << 6) | ((({0}) & 16) << 8)"


@query(f"WITH {grid_sql()} SELECT x, y, z, ({_SPREAD.format('x::BIGINT')}) * 4 + ({_SPREAD.format('y::BIGINT')}) * 2 + ({_SPREAD.format('z::BIGINT')}) AS code FROM g")
def morton_codes(spark, sf):
    """MSH9, FN11, WIN2, WIN3."""
    return cells_of(spark, sf).select("x", "y", "z", K.morton(AT).alias("code")).orderBy("code")


@query("SELECT m AS model_id, row_number() OVER (PARTITION BY m ORDER BY n, i) - 1 AS run_id, n AS n_fragments, i AS iteration FROM (SELECT *, sum(n) OVER (PARTITION BY m ORDER BY n, i) AS total FROM (SELECT DISTINCT p_size::BIGINT AS m FROM part), range(2, 11) a(n), range(0, 25) b(i) WHERE i < floor(25 - 10 * ((n - 2) / 8.0))) WHERE total <= 1000")
def run_schedule(spark, sf):
    """WIN14, FN12, SNK15: the schedule of a data set as rows."""
    models = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("model_id")).distinct()
    return fracture.runs(models).select("model_id", *[F.col(c).cast("long").alias(c) for c in ("run_id", "n_fragments", "iteration")])
