"""Hard-negative mining with vantage-point trees over norm-augmented vectors (operator 11)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows that a tree of one task holds on average, rows of a leaf, and queries that meet a tree at once, on average.
TREE_ROWS, LEAF_ROWS, TREE_QUERIES = 4096, 128, 2048
#: Rows that the regions are fitted on, at most, and levels of regions, at most: 1024 regions of ten distances each.
SAMPLE_ROWS, MOST_LEVELS = 8192, 10
#: Scores below and above all others: squared norms beyond that take no part.
FAR = 1 << 62
#: The window of an anchor's negatives, in hundredths of the positive's score.
WINDOW = (30, 90)
POSITIVES, NEGATIVES = 5, 10


@dataclass(frozen=True)
class Space:
    """Vectors with one more component that brings all to the norm of the longest, `reach`.

    A query gets 0 there, so its squared distance from a row is reach^2 + |query|^2 - 2 score: the nearest row has the
    highest score, and a window of scores is an annulus. Distances are rounded, so bounds give way by `slack`; scores are
    exact (in 53-bit floats while squared norms are that small, in 64-bit integers beyond).
    """

    square: float

    @property
    def slack(self) -> float:
        return 1e-6 * np.sqrt(self.square) + 1e-9

    def numbers(self, rows: np.ndarray) -> np.ndarray:
        return rows.astype(np.float64 if self.square < 2**52 else np.int64)

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.float64)
        return np.column_stack([rows, np.sqrt(np.maximum(self.square - (rows * rows).sum(1), 0.0))])

    def between(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances of lifted rows from lifted points, one by one or all from one."""
        return np.sqrt(np.maximum(((rows - points) ** 2).sum(1), 0.0))

    def from_query(self, query: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances of lifted points from a query."""
        query = query.astype(np.float64)
        return np.sqrt(np.maximum(self.square + query @ query - 2.0 * (points[:, :-1] @ query), 0.0))

    def scores(self, query: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and highest score of a row that is `least` to `most` away from the query."""
        query = query.astype(np.float64)
        both = self.square + query @ query
        give = 1e-9 * both + 1e-3
        near, far = np.maximum(least - self.slack, 0.0), most + self.slack
        return (both - far * far) / 2 - give, (both - near * near) / 2 + give


@dataclass
class Tree:
    """Vantage-point tree of one task's rows: inner nodes hold a point and, for each child, the interval of its rows' distances."""

    space: Space
    rows: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    keys: np.ndarray
    points: list = field(default_factory=list)
    #: Per node: (place of the point, child, least, most) for both children, or the rows of a leaf.
    nodes: list = field(default_factory=list)

    def __post_init__(self):
        lifted, chance = self.space.lifted(self.rows), np.random.default_rng(len(self.rows))
        self.rows = self.space.numbers(self.rows)
        self.nodes.append(None)
        todo = [(0, np.arange(len(self.rows)))]
        while todo:
            at, held = todo.pop()
            if len(held) > LEAF_ROWS:
                some = lifted[held[chance.integers(len(held))]]
                point = lifted[held[self.space.between(lifted[held], some).argmax()]]
                away = self.space.between(lifted[held], point)
                inside = away <= np.median(away)
                if not inside.all():
                    children = []
                    for part in (inside, ~inside):
                        children.append((len(self.points), len(self.nodes), away[part].min(), away[part].max()))
                        todo.append((len(self.nodes), held[part]))
                        self.nodes.append(None)
                    self.nodes[at] = children
                    self.points.append(point)
                    continue
            self.nodes[at] = held  # a leaf, or rows all as far from each other's farthest: copies
        self.points = np.array(self.points).reshape(-1, lifted.shape[1])

    def searcher(self, query: np.ndarray):
        """A function (low, high, want, skip, k) -> [(score, row)] of this tree's nearest rows to `query`."""
        space, away = self.space, self.space.from_query(query, self.points)
        exact, known = space.numbers(query), {}

        def reach(node: int) -> list[tuple[int, float, float]]:
            point, child, least, most = zip(*self.nodes[node])
            d = away[list(point)]
            low, high = space.scores(query, np.maximum(d - most, np.subtract(least, d)), d + most)
            return list(zip(child, low.tolist(), high.tolist()))

        def search(low: int, high: int, want: np.ndarray, skip: int, k: int) -> list[tuple[int, int]]:
            found, heap = [], [(-np.inf, 0, 0, 0)]
            while heap and len(found) < k:
                best, is_row, node_or_id, key = heapq.heappop(heap)
                if is_row:
                    found.append((-best, key))
                elif isinstance(self.nodes[node_or_id], list):
                    if node_or_id not in known:
                        known[node_or_id] = reach(node_or_id)
                    for child, least, most in known[node_or_id]:
                        if most >= low and least <= high:  # the annulus
                            heapq.heappush(heap, (max(best, -most), 0, child, 0))
                else:
                    held = self.nodes[node_or_id]
                    if node_or_id not in known:
                        known[node_or_id] = (self.rows[held] @ exact).astype(np.int64)
                    scores = known[node_or_id]
                    fits = np.flatnonzero((scores >= low) & (scores <= high) & want[held] & (self.keys[held] != skip))
                    if len(fits) > k:  # more than k of one leaf are never needed
                        fits = fits[np.lexsort((self.keys[held[fits]], self.ids[held[fits]], -scores[fits]))[:k]]
                    for i in fits.tolist():
                        row = int(held[i])
                        heapq.heappush(heap, (-int(scores[i]), 1, int(self.ids[row]), row))
            return found

        return search


@dataclass
class Regions:
    """The upper levels of the tree, fitted on a sample: 2^levels regions, numbered by the turns that lead there."""

    space: Space
    levels: int
    points: np.ndarray
    radii: np.ndarray
    #: Region number to (least, most) distance of its rows from each point on the way; regions without rows are not in it.
    bounds: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, space: Space, sample: np.ndarray, levels: int) -> Regions:
        lifted = space.lifted(sample)
        points, radii = np.zeros((1 << levels, lifted.shape[1])), np.full(1 << levels, np.inf)
        todo = [(1, np.arange(len(lifted)))]
        while todo:
            at, held = todo.pop()
            if at >= 1 << levels:
                continue
            if len(held):
                points[at] = lifted[held[space.between(lifted[held], lifted[held[0]]).argmax()]]
                away = space.between(lifted[held], points[at])
                radii[at] = np.median(away)
                todo += [(2 * at, held[away <= radii[at]]), (2 * at + 1, held[away > radii[at]])]
        return cls(space, levels, points, radii)

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Region of each row and its distances from the points on the way."""
        lifted, at = self.space.lifted(rows), np.ones(len(rows), np.int64)
        away = np.zeros((len(rows), self.levels))
        for level in range(self.levels):
            away[:, level] = self.space.between(lifted, self.points[at])
            at = 2 * at + (away[:, level] > self.radii[at])
        return at - (1 << self.levels), away

    def admitted(self, query: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[list[int], list[float]]:
        """Regions that may hold a row of one of the windows, those of higher scores first, with the highest score of each."""
        away, out = self.space.from_query(query, self.points), []
        for region, (least, most) in self.bounds.items():
            way = [(region + (1 << self.levels)) >> (self.levels - i) for i in range(self.levels)]
            d = away[way]
            near, far = np.maximum(d - most, least - d).max(initial=0.0), (d + most).min(initial=np.inf)
            low, high = self.space.scores(query, near, far)
            if ((lows <= high) & (highs >= low)).any():
                out.append((-high, region))
        out.sort()
        return [r for _, r in out], [-s for s, _ in out]


@dataclass
class Index:
    rows: DataFrame
    regions: Regions
    #: Region number to the number of its parts; a part holds TREE_ROWS rows on average.
    parts: dict


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of each component."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * 256))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def index_vectors(rows: DataFrame, vector_col: str = "v") -> Index | None:
    """All rows (with vec_id, label, asks and vectors of whole numbers) dealt to regions and parts; None if there are none.

    The regions are the upper levels of a vantage-point tree, fitted on SAMPLE_ROWS rows at most, chosen by a hash; every row
    is dealt to one, and its distances count in the region's bounds. A region is cut into parts of TREE_ROWS rows on average
    by a hash of the row, so copies without end make no task large. The tree of a part is built where it is used. Shorter vectors
    count as filled up with zeros; rows whose squared norm is over 2^62, whose scores are no longs, take no part.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = rows.withColumn("v", F.col(vector_col)).withColumn("norm", norm).where(F.col("norm") < FAR)
    rows = written(rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "asks", "v", "norm"))
    n, square, least, most = rows.agg(F.count("*"), F.max("norm"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return None
    if least < most:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("v"))))
    space = Space(float(square))
    levels = min(MOST_LEVELS, max(0, (-(-n // TREE_ROWS) - 1).bit_length()))
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).select("v").toPandas()["v"] if levels else []
    regions = Regions.fit(space, np.stack([*sample]) if levels else np.zeros((1, most)), levels)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                frame["region"], away = regions.route(np.stack([*frame["v"]]))
                frame["away"] = [*away]
                yield frame

    names = "key long, vec_id long, label int, asks boolean, v array<long>"
    rows = written(rows.select("key", "vec_id", "label", "asks", "v").mapInPandas(route, f"{names}, region long, away array<double>"))
    held = rows.groupBy("region").agg(F.count("*").alias("n"), *(f(F.get("away", F.lit(i))).alias(f"{k}{i}") for i in range(levels) for k, f in (("least", F.min), ("most", F.max)))).collect()
    for r in held:  # one row for each region
        regions.bounds[r["region"]] = tuple(np.array([r[f"{k}{i}"] for i in range(levels)]) for k in ("least", "most"))
    return Index(rows.drop("away"), regions, {r["region"]: -(-r["n"] // TREE_ROWS) for r in held})


def nearest_in_windows(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(qid, w, place, score, key, vec_id): for each window of each query the first `k` rows (all, if fewer) of the same label,
    or of another one, whose score lies in the window; higher scores first, ties by smaller vec_id (none last).

    `queries` has (qid, v, label, lows, highs): qid is the key of the query's own row, which does not count; window w is lows[w] to
    highs[w]. A query first goes to the region that may hold its highest scores, then to the others in which a row may beat its
    k-th found; both rounds are exact, so the result equals that of a search of all rows.
    """
    regions = index.regions

    def admit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                found = [regions.admitted(v, lo, hi) for v, lo, hi in zip(frame["v"], frame["lows"], frame["highs"])]
                frame["regions"], frame["tops"] = [r for r, _ in found], [s for _, s in found]
                yield frame

    names = ["qid", "v", "label", "lows", "highs"]
    schema = "qid long, v array<long>, label int, lows array<long>, highs array<long>"
    asked = written(queries.select(*names).mapInPandas(admit, f"{schema}, regions array<long>, tops array<double>"))
    order = Window.partitionBy("qid", "w").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "key")
    first = lambda df: df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    one = written(_visit(index, asked.where(F.size("regions") > 0).withColumn("region", F.get("regions", F.lit(0))), k, same))
    kth = first(one).where(F.col("place") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    rest = asked.where(F.size("regions") > 1).join(kth, "qid", "left")
    rest = rest.withColumn("lows", F.expr("transform(lows, (x, w) -> greatest(x, kth[w]))"))
    rest = rest.withColumn("r", F.explode(F.slice(F.arrays_zip("regions", "tops"), 2, 1 << MOST_LEVELS)))
    rest = rest.withColumn("region", F.col("r.regions")).where("exists(arrays_zip(lows, highs), x -> x.lows <= x.highs and x.lows <= r.tops)")
    return first(one.union(_visit(index, rest, k, same))).select("qid", "w", "place", "score", "key", "vec_id")


def _visit(index: Index, tasks: DataFrame, k: int, same: bool) -> DataFrame:
    """(qid, w, score, key, vec_id) of each task's first k in its region. Each part of a region meets the tasks in blocks of bounded
    size: the part's rows go to each block, the tasks to each part."""
    spark = tasks.sparkSession
    tasks = written(tasks.select("region", "qid", "v", "label", "lows", "highs"))
    sizes = [(r["region"], index.parts[r["region"]], 1 + r["n"] // TREE_QUERIES) for r in tasks.groupBy("region").agg(F.count("*").alias("n")).collect()]
    for_rows, for_tasks = (F.broadcast(spark.createDataFrame(sizes, "region long, parts int, blocks int")) for _ in "ab")  # a row for each region
    rows = index.rows.drop("asks").join(for_rows, "region").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.join(for_tasks, "region").withColumn("block", F.pmod(F.xxhash64("qid"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    space, last = index.regions.space, (1 << 63) - 1

    def search(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            ids = np.array([last if pd.isna(i) else int(i) for i in held["vec_id"]], np.int64)
            tree = Tree(space, np.stack([*held["v"]]), held["label"].to_numpy(), ids, held["key"].to_numpy())
            for qid, v, label, lows, highs in zip(*(asked[c] for c in ("qid", "v", "label", "lows", "highs"))):
                find, want = tree.searcher(v), (tree.labels == label) == same
                for w, (low, high) in enumerate(zip(lows.tolist(), highs.tolist())):
                    if low <= high:
                        out += [(qid, w, s, int(tree.keys[row]), held["vec_id"].iat[row]) for s, row in find(low, high, want, qid, k)]
        found = pd.DataFrame(out, columns=["qid", "w", "score", "key", "vec_id"])
        return found.astype({"vec_id": "Int64"})

    by = ["region", "part", "block"]
    return rows.groupBy(*by).cogroup(tasks.groupBy(*by)).applyInPandas(search, "qid long, w int, score long, key long, vec_id long")


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first `positives`
    other rows of its label, the first `negatives` rows of other labels whose score is window[0] to window[1] hundredths of
    the positive's.

    Scores are inner products of the vectors' whole numbers (see whole_numbers); higher ones come first, ties by smaller id.
    Rows with a null label or vector, or with a null or non-finite component, take no part. Repeated rows, rows of one id or of
    none are rows of their own, anchors too; null ids come last in ties. Anchors without another row of their label, and
    windows without a row, give nothing; with fewer rows than asked for, all are given. Other columns are not read. An empty
    table gives no rows.
    """
    fit = F.col(label_col).isNotNull() & usable(F.col(vector_col))
    own = rows.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), whole_numbers(F.col(vector_col)).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    index = index_vectors(own)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index is None:
        return rows.sparkSession.createDataFrame([], schema)
    ends = F.array(F.lit(1 - FAR)), F.array(F.lit(FAR - 1))
    anchors = index.rows.where("asks").select(F.col("key").alias("qid"), F.col("vec_id").alias("anchor_id"), "v", "label")
    near = written(nearest_in_windows(index, anchors.withColumn("lows", ends[0]).withColumn("highs", ends[1]), positives, same=True))
    low, high = window
    up = F.call_function("div", F.col("score").cast("decimal(20,0)") * low + F.when(F.col("score") > 0, 99).otherwise(0), F.lit(100))
    down = F.call_function("div", F.col("score").cast("decimal(20,0)") * high - F.when(F.col("score") < 0, 99).otherwise(0), F.lit(100))
    span = F.struct("place", up.alias("low"), down.alias("high"))
    spans = near.groupBy("qid").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # `positives` at most
    queries = anchors.join(spans, "qid").select("qid", "v", "label", F.col("spans.low").alias("lows"), F.col("spans.high").alias("highs"))
    far = nearest_in_windows(index, queries, negatives, same=False)
    far = far.select("qid", (F.col("w") + 1).alias("w"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("qid", F.col("place").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = [c.split()[0] for c in schema.split(", ")]
    return far.join(near, ["qid", "w"]).join(anchors.select("qid", "anchor_id"), "qid").select(*names)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, after every seventh one's label is moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}

ORACLES = {
    "op11_hard_negatives": """
    WITH fit AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v, row_number() OVER () AS k
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    pairs AS (
      SELECT a.k AS ak, a.vec_id AS anchor_id, b.k AS bk, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM fit a JOIN fit b ON a.vec_id % 100 = 0 AND a.k <> b.k),
    pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id, bk) AS place FROM pairs WHERE same) WHERE place <= 5)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
      SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.ak, p.place ORDER BY n.score DESC, n.vec_id, n.bk)::INT AS rank
      FROM pos p JOIN pairs n ON p.ak = n.ak AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
    WHERE rank <= 10""",
}
