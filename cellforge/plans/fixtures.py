"""Grids, meshes and rays derived from the fixed tables, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.lineage import cut

#: Cells an axis of the derived grid, and its seeds (id, x, y, z).
N = 32
SEEDS = [(2, 3, 4, 5), (3, 20, 21, 7), (4, 11, 30, 29), (5, 28, 2, 16)]
#: Box and cell of the point grid.
LO, SIZE, DIMS = (-4.0, -4.0, -4.0), (0.25, 0.25, 0.25), (32, 32, 32)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grid(spark: SparkSession, sf: str, n: int = N) -> DataFrame:
    cell = [(F.col(c) % n).cast("int").alias(a) for c, a in (("l_orderkey", "x"), ("l_partkey", "y"), ("l_suppkey", "z"))]
    return table(spark, sf, "lineitem").select(*cell).distinct().select(F.lit(0).cast("long").alias("grid_id"), "x", "y", "z", F.lit(1).alias("value"))


def grid_sql(n: int = N) -> str:
    return f"g AS (SELECT DISTINCT (l_orderkey % {n})::INT AS x, (l_partkey % {n})::INT AS y, (l_suppkey % {n})::INT AS z FROM lineitem)"


def shell(spark: SparkSession, sf: str, n: int = 24) -> DataFrame:
    """The cells of the grid of n cells an axis that lie in a hollow ball, so with true empty space inside and out."""
    r2 = sum(((2 * F.col(c) - (n - 1)) * (2 * F.col(c) - (n - 1)) for c in "xyz"), F.lit(0)) * 100
    return grid(spark, sf, n).where(r2.between(9 * n * n, 81 * n * n))


def shell_sql(n: int = 24) -> str:
    r2 = " + ".join(f"(2 * {c} - {n - 1}) * (2 * {c} - {n - 1})" for c in "xyz")
    return f"{grid_sql(n).replace('g AS', 'whole AS', 1)}, g AS (SELECT * FROM whole WHERE 100 * ({r2}) BETWEEN {9 * n * n} AND {81 * n * n})"


def labelled(spark: SparkSession, sf: str, n: int = N) -> DataFrame:
    from cellforge.operators.fracture import nearest_seed

    return nearest_seed(grid(spark, sf, n), SEEDS)


def labelled_sql(n: int = N, metric: str = "euclid") -> str:
    d = {
        "euclid": lambda x, y, z: f"(x - {x}) * (x - {x}) + (y - {y}) * (y - {y}) + (z - {z}) * (z - {z})",
        "manhattan": lambda x, y, z: f"abs(x - {x}) + abs(y - {y}) + abs(z - {z})",
        "chebyshev": lambda x, y, z: f"greatest(abs(x - {x}), abs(y - {y}), abs(z - {z}))",
    }[metric]
    packed = ", ".join(f"({d(x, y, z)})::BIGINT * 65536 + {i}" for i, x, y, z in SEEDS)
    return f"{grid_sql(n)}, lab AS (SELECT x, y, z, (least({packed}) % 65536)::INT AS value FROM g)"


def seed_table(spark: SparkSession, seeds=SEEDS) -> DataFrame:
    return spark.createDataFrame([(0, *s) for s in seeds], "grid_id long, seed_id int, sx int, sy int, sz int")


def seed_sql(seeds=SEEDS) -> str:
    return "s(seed_id, sx, sy, sz) AS (VALUES " + ", ".join(str(s) for s in seeds) + ")"


def points(spark: SparkSession, sf: str) -> DataFrame:
    at = [F.element_at("embedding", k).cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))]
    return table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("cloud_id"), F.col("vec_id").alias("point_id"), *at)


POINTS_SQL = "p AS (SELECT label::BIGINT AS cloud_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def triangles(spark: SparkSession, sf: str) -> DataFrame:
    """Three points in a row, by id, are a triangle; the mesh is the label of the first modulo 4."""
    p = points(spark, sf).select(F.floor(F.col("point_id") / 3).alias("tri_id"), (F.col("point_id") % 3).alias("k"), "cloud_id", "x", "y", "z")
    one = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    t = p.groupBy("tri_id").agg(*[one(c, k).alias(f"{v}{c}") for k, v in enumerate("abc") for c in "xyz"], one("cloud_id", 0).alias("m"), F.count("*").alias("n"))
    return t.where("n = 3").select((F.col("m") % 4).alias("mesh_id"), "tri_id", *[f"{v}{c}" for v in "abc" for c in "xyz"])


TRIANGLES_SQL = POINTS_SQL + ", t AS (SELECT a.cloud_id % 4 AS mesh_id, a.point_id // 3 AS tri_id, " + ", ".join(f"{v}.{c} AS {v}{c}" for v in "abc" for c in "xyz") + " FROM p a JOIN p b ON b.point_id = a.point_id + 1 JOIN p c ON c.point_id = a.point_id + 2 WHERE a.point_id % 3 = 0)"


def rays(spark: SparkSession, sf: str) -> DataFrame:
    """A ray from each point towards the next one."""
    p = points(spark, sf)
    q = p.select((F.col("point_id") - 1).alias("point_id"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    return p.join(q, "point_id").select(F.col("point_id").alias("ray_id"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *[(F.col(f"n{c}") - F.col(c)).alias(f"d{c}") for c in "xyz"])


RAYS_SQL = "r AS (SELECT a.point_id AS ray_id, " + ", ".join(f"a.{c} AS o{c}" for c in "xyz") + ", " + ", ".join(f"b.{c} - a.{c} AS d{c}" for c in "xyz") + " FROM p a JOIN p b ON b.point_id = a.point_id + 1)"


def mesh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A height field over a grid of 24 by 24 points for each of four meshes, heights from the line items."""
    heights = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("mesh_id"), (F.col("l_orderkey") % 24).alias("i"), (F.col("l_partkey") % 24).alias("j")).agg(F.count("*").alias("n"))
    base = spark.range(4 * 576).select(F.floor(F.col("id") / 576).alias("mesh_id"), (F.floor(F.col("id") / 24) % 24).alias("i"), (F.col("id") % 24).alias("j"))
    v = base.join(heights, ["mesh_id", "i", "j"], "left").select(
        "mesh_id", (F.col("i") * 24 + F.col("j")).alias("vertex_id"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), (F.coalesce("n", F.lit(0)) % 7).cast("double").alias("z")
    )
    quad = F.col("i") * 24 + F.col("j")
    two = F.array(F.struct(quad.alias("v0"), (quad + 24).alias("v1"), (quad + 1).alias("v2")), F.struct((quad + 1).alias("v0"), (quad + 24).alias("v1"), (quad + 25).alias("v2")))
    f = base.where("i < 23 and j < 23").select("mesh_id", (F.col("i") * 23 + F.col("j")).alias("q"), F.posexplode(two).alias("k", "t")).select("mesh_id", (F.col("q") * 2 + F.col("k")).alias("face_id"), "t.v0", "t.v1", "t.v2")
    return v, f


MESH_SQL = """
h AS (SELECT l_suppkey % 4 AS mesh_id, l_orderkey % 24 AS i, l_partkey % 24 AS j, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
b AS (SELECT m AS mesh_id, i, j FROM range(4) a(m), range(24) b(i), range(24) c(j)),
v AS (SELECT b.mesh_id, b.i * 24 + b.j AS vertex_id, b.i::DOUBLE AS x, b.j::DOUBLE AS y, (coalesce(n, 0) % 7)::DOUBLE AS z FROM b LEFT JOIN h USING (mesh_id, i, j)),
f AS (SELECT mesh_id, (i * 23 + j) * 2 AS face_id, i * 24 + j AS v0, (i + 1) * 24 + j AS v1, i * 24 + j + 1 AS v2 FROM b WHERE i < 23 AND j < 23
  UNION ALL SELECT mesh_id, (i * 23 + j) * 2 + 1, i * 24 + j + 1, (i + 1) * 24 + j, (i + 1) * 24 + j + 1 FROM b WHERE i < 23 AND j < 23),
ft AS (SELECT f.mesh_id, face_id AS tri_id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
  FROM f JOIN v a ON a.mesh_id = f.mesh_id AND a.vertex_id = v0 JOIN v b ON b.mesh_id = f.mesh_id AND b.vertex_id = v1 JOIN v c ON c.mesh_id = f.mesh_id AND c.vertex_id = v2)"""

#: An octahedron |x| + |y| + |z| = r about (c, c, c), normals outwards.
OCTAHEDRON = [(sx, sy, sz) for sx in (1, -1) for sy in (1, -1) for sz in (1, -1)]


def octahedra(spark: SparkSession, sf: str, c: float = 16.25) -> DataFrame:
    """One octahedron per distinct part size, radius size / 4 + 1.3, as triangles."""
    sizes = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("mesh_id")).distinct()
    r = F.col("mesh_id") / 4 + 1.3
    corner = lambda axis, s: [r * s + c if k == axis else F.lit(c) for k in range(3)]
    faces = []
    for n, s in enumerate(OCTAHEDRON):
        order = (0, 1, 2) if s[0] * s[1] * s[2] > 0 else (0, 2, 1)
        faces.append(F.struct(F.lit(n).cast("long").alias("tri_id"), *[col.cast("double").alias(f"{v}{k}") for v, axis in zip("abc", order) for k, col in zip("xyz", corner(axis, s[axis]))]))
    return sizes.select("mesh_id", F.explode(F.array(*faces)).alias("t")).select("mesh_id", "t.*")


#: Parts of the event table that arrive one after the other, and how much later than in order an event comes at most, in seconds.
ARRIVALS, DELAY = 5, 3 * 3600
#: Events of a file on average; each part is dealt to as many files, so that a part is a batch of the stream and no file is a task of its own.
ARRIVING_ROWS = 250_000


def arriving_events(spark: SparkSession, sf: str, path: str) -> int:
    """Writes the events to files in the order in which they might arrive, which is not that of their times: each is up to DELAY
    late, by its id. A last event without a user, far in the future, moves the watermark past all others. Returns the files of a
    part, which a stream must read together, as a later one of them would be behind the watermark of the first."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    seconds = F.unix_seconds("ts")
    first, last = events.agg(F.min(seconds), F.max(seconds)).first()
    width = (last + DELAY - first) // ARRIVALS + 1
    part = F.floor((seconds - first + F.pmod(F.col("event_id") * 7919, F.lit(DELAY))) / width)
    dealt = cut(events.withColumn("part", part))
    sizes = dict(dealt.groupBy("part").count().collect())  # ARRIVALS rows
    files = max(1, min(sizes.get(n, 0) for n in range(ARRIVALS)) // ARRIVING_ROWS)
    for n in range(ARRIVALS):
        rows = dealt.where(F.col("part") == n).drop("part")
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
        rows.write.mode("append").parquet(path)
    events.limit(1).withColumn("user_id", F.lit(None).cast("long")).withColumn("ts", F.timestamp_seconds(F.lit(last + 400 * 24 * 3600))).coalesce(1).write.mode("append").parquet(path)
    return files
