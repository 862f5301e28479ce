"""Connected parts and floods by blocks against plain searches."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from cellforge.operators import blocks, components, fracture
from cellforge.operators.grid import NEIGHBOURHOODS


def table(spark, cells):
    return spark.createDataFrame([(g, x, y, z, v) for (g, x, y, z), v in cells.items()], "grid_id long, x int, y int, z int, value int")


def plain_parts(cells, offsets):
    """The least cell of each cell's part."""
    part = {}
    for start in sorted(cells):
        if start in part:
            continue
        part[start], todo = start[1:], [start]
        while todo:
            g, x, y, z = todo.pop()
            for a, b, c in offsets:
                to = (g, x + a, y + b, z + c)
                if to not in part and cells.get(to) == cells[start]:
                    part[to] = start[1:]
                    todo.append(to)
    return part


def plain_flood(cells, sources, offsets):
    best = {}
    todo = deque(sorted((0, label, at) for at, label in sources if at in cells))
    while todo:
        level, label, at = todo.popleft()
        if at in best:
            continue
        best[at] = (label, level)
        todo.extend(sorted((level + 1, label, to) for o in offsets if (to := (at[0], *(p + q for p, q in zip(at[1:], o)))) in cells and to not in best))
    return best


@pytest.fixture(scope="module")
def cells():
    random.seed(4)
    out = {}
    for g in (0, 7):
        for _ in range(700):
            out[(g, random.randrange(-5, 8), random.randrange(11), random.randrange(11))] = random.choice([2, 3])
    for x in range(40):  # a long winding line of one value
        for y in range(0, 12, 2):
            out[(9, x, y, 0)] = 5
        out[(9, 39 if x % 4 < 2 else 0, 2 * (x % 6) + 1, 0)] = 5
    return out


@pytest.mark.parametrize("n", [6, 26])
@pytest.mark.parametrize("block", [1, 4, 64])
def test_parts_equal_a_plain_search(spark, cells, n, block):
    got = {(r.grid_id, r.x, r.y, r.z): tuple(r.part) for r in blocks.grid_parts(table(spark, cells), n, block).collect()}
    assert got == plain_parts(cells, NEIGHBOURHOODS[n])


@pytest.mark.parametrize("n,block", [(6, 4), (26, 4), (6, 64)])
def test_floods_equal_a_plain_search(spark, cells, n, block):
    random.seed(n)
    sources = [(at, 2 + k) for k, at in enumerate(random.sample(sorted(cells), 12))]
    sources += [(sources[0][0], 99), (sources[1][0], 1), ((0, 500, 500, 500), 3), ((5, 0, 0, 0), 3)]
    rows = spark.createDataFrame([(*at, label) for at, label in sources], "grid_id long, x int, y int, z int, label long")
    got = {(r.grid_id, r.x, r.y, r.z): (r.label, r.level) for r in blocks.flood_blocks(table(spark, cells), rows, n, block).collect()}
    want = plain_flood(cells, sources, NEIGHBOURHOODS[n])
    assert set(got) == set(cells) and {k: v for k, v in got.items() if v[1] >= 0} == want


def test_no_cells_and_no_sources(spark, cells):
    df = table(spark, cells)
    none = df.limit(0).withColumn("label", F.lit(1).cast("long"))
    assert blocks.grid_parts(df.limit(0)).count() == 0
    assert {r.level for r in blocks.flood_blocks(df, none.select("grid_id", "x", "y", "z", "label")).collect()} == {-1}
    assert fracture.fracture(df, spark.createDataFrame([], "grid_id long, seed_id int, sx int, sy int, sz int"), fracture.FractureParams("flood")).count() == 0


def test_a_grid_of_128_goes_through_in_blocks(spark):
    """Planes that hang together at alternate ends: one part, a path through all blocks, and no group beyond one block."""
    n, block = 128, 32
    at = spark.range(n**3).select(F.lit(0).cast("long").alias("grid_id"), *[F.floor(F.col("id") / n**k).cast("int").__mod__(n).cast("int").alias(c) for k, c in enumerate("xyz")])
    grid = at.where("z % 8 = 0 or (x = 0 and y = 0 and z % 16 < 8) or (x = 127 and y = 127 and z % 16 > 8)").withColumn("value", F.lit(2)).cache()
    largest = grid.groupBy("grid_id", *blocks.block_of(block)).count().agg(F.max("count"), F.count("*")).first()
    assert largest[0] <= block**3 and largest[1] >= 32
    parts = blocks.grid_parts(grid, 6, block)
    assert parts.select("part").distinct().collect() == [((0, 0, 0),)]
    cut_off = grid.where("z <> 36")
    kept = fracture.keep_connected(cut_off, spark.createDataFrame([(0, 2, 5, 5, 0)], "grid_id long, seed_id int, sx int, sy int, sz int"), 6, block)
    assert kept.count() == cut_off.where("z < 36").count() and kept.agg(F.max("z")).first()[0] == 35


def test_components_of_struct_nodes(spark):
    rows = [((0, i), (0, i + 1)) for i in range(60) if i % 20 != 19] + [((1, 3), (1, 3)), ((1, 4), (1, 2)), ((1, 4), (1, 2))]
    links = spark.createDataFrame(rows, "a struct<g: int, n: int>, b struct<g: int, n: int>")
    got = {tuple(r.node): tuple(r.root) for r in components.connected_components(links).collect()}
    assert got == {(0, i): (0, i // 20 * 20) for i in range(60)} | {(1, 4): (1, 2), (1, 2): (1, 2)}
