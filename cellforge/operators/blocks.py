"""Connectivity and floods of grids by blocks: a task holds one block, and only what crosses its faces leaves it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellforge.lineage import cut

from .components import connected_components
from .grid import CELL, NEIGHBOURHOODS

#: Cells an axis of a block: 262,144 cells at most.
BLOCK = 64
#: A number above all levels and labels of a block.
NEVER = np.iinfo(np.int64).max // 2


def block_of(block: int) -> list[Column]:
    return [F.floor(F.col(c) / block).cast("int").alias(f"b{c}") for c in "xyz"]


KEY = ["grid_id", "bx", "by", "bz"]


def _padded(at: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int], int]:
    """Flat places of a block's cells in their padded box, the box's strides, and its size."""
    at = at - at.min(axis=0) + 1
    shape = at.max(axis=0) + 2
    strides = (int(shape[1] * shape[2]), int(shape[2]), 1)
    return at @ np.array(strides), strides, int(shape.prod())


def local_parts(at: np.ndarray, value: np.ndarray, offsets: list[tuple[int, int, int]]) -> np.ndarray:
    """Index of the first cell of each cell's part: cells of one value that touch each other; `at` is in order.

    Links of touching cells hook the larger root to the lesser, then all paths are halved until they are flat; rounds grow
    with the logarithm of the longest path.
    """
    flat, strides, size = _padded(at)
    place = np.full(size, -1)
    place[flat] = np.arange(len(at))
    pairs = []
    for o in offsets:
        if o > (0, 0, 0):
            to = place[flat + int(np.dot(o, strides))]
            ok = np.flatnonzero(to >= 0)
            ok = ok[value[ok] == value[to[ok]]]
            pairs.append((ok, to[ok]))
    i, j = (np.concatenate(p) for p in zip(*pairs))
    root = np.arange(len(at))
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not (root == (up := root[root])).all():
            root = up
    return root


def grid_parts(cells: DataFrame, neighbourhood: int = 6, block: int = BLOCK) -> DataFrame:
    """(cell, value, part): the connected parts of cells of one value; a part is named by its least cell (a struct x, y, z).

    Each block labels its own cells. Cells on the faces of blocks give links between parts of neighbouring blocks, which
    are contracted as components, and parts are renamed by a join. `cells` has (grid_id, x, y, z, value), each cell once.
    """
    offsets = NEIGHBOURHOODS[neighbourhood]

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y", "z"]).reset_index(drop=True)
        at = rows[["x", "y", "z"]].to_numpy(np.int64)
        root = local_parts(at, rows["value"].to_numpy(np.int64), offsets)
        rows[["px", "py", "pz"]] = at[root]
        return rows[[*CELL, "value", "px", "py", "pz"]]

    dealt = cells.select(*CELL, "value", *block_of(block))
    schema = "grid_id long, x int, y int, z int, value long, px int, py int, pz int"
    local = dealt.groupBy(*KEY).applyInPandas(label, schema)
    local = cut(local.select(*CELL, "value", F.struct("grid_id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z")).alias("node")))
    # only cells at a block's rim have neighbours in others; each pair is seen from one side
    near = F.array(*[F.struct(*(F.lit(v).alias(n) for v, n in zip(o, ("ox", "oy", "oz")))) for o in offsets if o > (0, 0, 0)])
    rim = " or ".join(f"pmod({c}, {block}) in (0, {block - 1})" for c in "xyz")
    faces = local.where(rim)
    out = faces.select("grid_id", "value", F.col("node").alias("a"), *CELL[1:], F.explode(near).alias("o"))
    crosses = " or ".join(f"floor({c} / {block}) <> floor(({c} + o.o{c}) / {block})" for c in "xyz")
    out = out.where(crosses).select("grid_id", "value", "a", *[(F.col(c) + F.col(f"o.o{c}")).alias(c) for c in "xyz"])
    links = out.join(faces.select(*CELL, "value", F.col("node").alias("b")), [*CELL, "value"]).select("a", "b").distinct()
    roots = connected_components(links)
    named = local.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
    return named.select(*CELL, F.col("value").cast(dict(cells.dtypes)["value"]).alias("value"), F.struct("part.x", "part.y", "part.z").alias("part"))


def _relax(rows: pd.DataFrame, seen: pd.DataFrame, offsets: list[tuple[int, int, int]]) -> pd.DataFrame:
    """One block's levels and labels after what was seen at its cells, flooded on as far as the block goes.

    A cell takes the least level, then the least label; both are held as one number, level * labels + place of the label.
    """
    rows = rows.reset_index(drop=True)
    level, label = rows["level"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
    flat, strides, size = _padded(rows[["x", "y", "z"]].to_numpy(np.int64))
    labels = np.unique(np.concatenate([label[level >= 0], seen["label"].to_numpy(np.int64)]))
    wide = max(len(labels), 1)
    now = np.full(size, -1)  # below every number, so nothing enters a place without a cell
    now[flat] = np.where(level >= 0, level * wide + np.searchsorted(labels, label), NEVER)
    before = now[flat].copy()
    at = pd.MultiIndex.from_frame(rows[["x", "y", "z"]]).get_indexer(pd.MultiIndex.from_frame(seen[["x", "y", "z"]]))
    words = seen["level"].to_numpy(np.int64) * wide + np.searchsorted(labels, seen["label"].to_numpy(np.int64))
    ok = at >= 0
    to, words = flat[at[ok]], words[ok]
    better = words < now[to]
    np.minimum.at(now, to[better], words[better])
    open_ = np.unique(to[better])
    steps = np.array([int(np.dot(o, strides)) for o in offsets])
    while len(open_):
        at_level = now[open_] // wide
        front, open_ = open_[at_level == at_level.min()], open_[at_level > at_level.min()]
        to, words = (front[:, None] + steps).ravel(), np.repeat(now[front] + wide, len(steps))
        better = words < now[to]
        np.minimum.at(now, to[better], words[better])
        open_ = np.union1d(open_, to[better])
    after = now[flat]
    reached = after < NEVER
    rows["level"] = np.where(reached, after // wide, -1)
    rows["label"] = np.where(reached, labels[np.where(reached, after % wide, 0)] if len(labels) else 0, 0)
    rows["fresh"] = after != before
    return rows


def flood_blocks(cells: DataFrame, sources: DataFrame, neighbourhood: int = 6, block: int = BLOCK, max_rounds: int = 4096) -> DataFrame:
    """(cell, label, level) of every cell; level -1 where no source reaches.

    A breadth-first flood from all sources (grid_id, x, y, z, label) at once: a cell's level is its distance from the nearest
    source, its label the least of the sources that are so near. In a round each block takes what was seen at its cells from
    outside and floods as far as it goes; the rims that changed are seen by the neighbouring blocks in the next round. So rounds grow with
    the blocks that a path crosses, not with its cells, and no task holds more than a block. `cells` has each cell once;
    sources beside the cells have no effect.
    """
    offsets = NEIGHBOURHOODS[neighbourhood]
    by = [*KEY]
    schema = "grid_id long, x int, y int, z int, bx int, by int, bz int, level int, label long, fresh boolean"

    def relax(rows: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if len(rows) and len(seen):
            return _relax(rows, seen, offsets)[names]
        return rows.assign(fresh=False)[names]

    names = [c.split()[0] for c in schema.split(", ")]
    state = cells.select(*CELL, *block_of(block), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("label"), F.lit(False).alias("fresh"))
    seen = sources.groupBy(*CELL).agg(F.min(F.col("label").cast("long")).alias("label")).select(*CELL, *block_of(block), F.lit(0).alias("level"), "label")
    near = F.array(*[F.struct(*(F.lit(v).alias(n) for v, n in zip(o, ("ox", "oy", "oz")))) for o in offsets])
    rim = " or ".join(f"pmod({c}, {block}) in (0, {block - 1})" for c in "xyz")
    for _ in range(max_rounds):
        state = cut(state.groupBy(*by).cogroup(seen.groupBy(*by)).applyInPandas(relax, schema))
        out = state.where("fresh").where(rim).select(*CELL, "level", "label", F.explode(near).alias("o"))
        crosses = " or ".join(f"floor({c} / {block}) <> floor(({c} + o.o{c}) / {block})" for c in "xyz")
        out = out.where(crosses).select("grid_id", *[(F.col(c) + F.col(f"o.o{c}")).alias(c) for c in "xyz"], F.struct((F.col("level") + 1).alias("level"), "label").alias("w"))
        out = out.groupBy(*CELL).agg(F.min("w").alias("w")).select(*CELL, *block_of(block), "w.level", "w.label")
        seen = cut(out.join(state.select(*CELL), CELL, "left_semi"))
        if seen.isEmpty():
            return state.select(*CELL, "label", "level")
    raise RuntimeError(f"the flood did not end in {max_rounds} rounds")
