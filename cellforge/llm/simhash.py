"""SimHash near-duplicate detection with pigeonhole blocks (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.lineage import FILE_ROWS

from .common import cut, settled, small_batches, table, written
from .components import connected_components

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
SEED = 42
#: A block group with more distinct fingerprints than this is split by narrower blocks instead of being linked in one task.
GROUP_LIMIT = 4096


def simhash64(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a whole text, unsigned. Null, empty and word-less texts: 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    joined = b" ".join(w)
    ends = [x - 1 for x in accumulate(len(x) + 1 for x in w)]
    starts = [0, *(x + 1 for x in ends[: n - 1])]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, ends[min(shingle, len(w)) - 1 :])), np.uint64, n)
    by = h.view(np.uint8).reshape(n, 8)
    if n < 64:
        counts = np.unpackbits(by, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(by[:, k], minlength=256) @ BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a long, its 64 bits read as signed."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash64(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _masks(blocks: int, keep: int, within: int = 64) -> list[int]:
    """Signed 64-bit masks, one for each choice of `keep` of `blocks` nearly equal bit blocks."""
    edge = [round(i * within / blocks) for i in range(blocks + 1)]
    block = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    full = [sum(c) for c in combinations(block, keep)]
    return [m - (1 << 64) if m >> 63 else m for m in full]


def _near(fps: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the graph that links fingerprints at `bits` or fewer differing bits."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            close = np.bitwise_count(rest ^ at) <= bits
            if close.any():
                found = rest[close]
                rest = rest[~close]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found)
    return left, right


def _link_groups(bits: int, limit: int):
    """Over rows sorted by (c, k, f): links within each group; a group over `limit` is handed on instead, as it is.

    Bounded memory: no more than `limit` fingerprints of a group are held. The output has (c, a, b): c is null for a
    link, and names the mask for a fingerprint a that is handed on.
    """
    schema = pa.schema([("c", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def close(c: int, group: list[np.ndarray], over: bool) -> pa.RecordBatch | None:
        f = np.concatenate(group)
        if over:
            return pa.record_batch([pa.array(np.full(len(f), c, np.int32)), pa.array(f), pa.nulls(len(f), pa.int64())], schema=schema)
        x, y = _near(f, bits)
        if not x:
            return None
        x, y = np.concatenate(x), np.concatenate(y)
        return pa.record_batch([pa.nulls(len(x), pa.int32()), pa.array(x), pa.array(y)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key, size, over = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            c, k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.flatnonzero((np.diff(c) != 0) | (np.diff(k) != 0)) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(c)]])
            # groups of two that lie wholly inside the batch, all at once
            two = np.flatnonzero(ends - starts == 2)
            two = two[(two > 0) & (two < len(starts) - 1)]
            i = starts[two]
            ok = np.bitwise_count(f[i] ^ f[i + 1]) <= bits
            if ok.any():
                i = i[ok]
                yield pa.record_batch([pa.nulls(len(i), pa.int32()), pa.array(f[i]), pa.array(f[i + 1])], schema=schema)
            large = np.flatnonzero(ends - starts > 2)
            for g in sorted({0, len(starts) - 1, *large.tolist()}):
                at = (int(c[starts[g]]), int(k[starts[g]]))
                if at != key:
                    if key is not None and size > 1 and held and (out := close(key[0], held, over)):
                        yield out
                    held, key, size, over = [], at, 0, False
                part = f[starts[g] : ends[g]]
                held.append(part)
                size += len(part)
                if size > limit:
                    over = True
                if over:
                    yield close(key[0], held, True)
                    held = []
        if key is not None and size > 1 and held and (out := close(key[0], held, over)):
            yield out

    return run


def near_links(fps: DataFrame, fp: str, bits: int = 3, blocks: int = 6, limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) whose components equal those of all pairs of distinct fingerprints at `bits` or fewer bits.

    Two such fingerprints agree on `blocks - bits` blocks at least, so they meet under one of the masks. A group gives a
    spanning forest of its links, never all its pairs. A group over `limit` goes on to masks that leave 4 bits open
    for each of `bits`: 12 at 3 bits, which hold 4096 distinct fingerprints at most.
    """

    def grouped(rows: DataFrame, cap: int) -> DataFrame:
        return rows.repartition("c", "k").sortWithinPartitions("c", "k", "f").mapInArrow(_link_groups(bits, cap), "c int, a long, b long")

    masks = _masks(blocks, blocks - bits)
    first = cut(
        grouped(
            fps.select(
                F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(fp).bitwiseAND(F.lit(m)).alias("k"), F.col(fp).alias("f")) for i, m in enumerate(masks)])).alias("x")
            ).select("x.*"),
            limit,
        )
    )
    links = first.where("c is null").select("a", "b")
    handed = first.where("c is not null")
    if not handed.isEmpty():
        fine = _masks(16, 16 - bits)
        again = (
            handed.select(F.col("a").alias("f")).distinct()
            .select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("f").bitwiseAND(F.lit(m)).alias("k"), F.col("f")) for i, m in enumerate(fine)])).alias("x"))
            .select("x.*")
        )
        links = links.union(grouped(again, 1 << 4 * bits).where("c is null").select("a", "b"))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, shingle: int = 3) -> DataFrame:
    """(fp, id, text_hash, component_id, root) for each row of `docs`.

    component_id is the least id that links reach, the row's own included; root is the component's least fingerprint, which
    tells components apart whose least ids are the same because the id is repeated with another text. Texts without a word have fingerprint 0 and
    link like any other. A null id never becomes a component_id unless the component has no other id. Rows repeated
    with the same id each appear. An empty table gives no rows; other columns are not read.
    """
    rows = cut(
        small_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), fingerprint(F.col(text_col), shingle).alias("fp"))
    )
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), rows.count())
    parts = connected_components(near_links(fps, "fp", bits))
    roots = fps.join(parts, fps.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    # a second key makes the small side be dealt again, so that Spark can split a component with very many fingerprints
    named = roots.withColumn("root2", F.xxhash64("root")).join(ids.withColumn("root2", F.xxhash64("root")), ["root", "root2"]).select("fp", "component_id", "root")
    return rows.join(named, "fp")


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, shingle: int = 3) -> DataFrame:
    """`docs` with one document of each near-duplicate group: that of the least id (ties: the least text hash).

    All columns stay. Rows equal in id and text are one document and stay or go together. A null id loses to any
    other id of its group. An empty table gives no rows.
    """
    found = near_duplicates(docs, id_col, text_col, bits, shingle)
    best = (
        found.groupBy("root")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("best"))
        .select(F.col("best.id").alias("__id"), F.col("best.text_hash").alias("__hash"))
    )
    return docs.join(
        best,
        docs[id_col].eqNullSafe(best["__id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == best["__hash"]),
        "left_semi",
    )


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's runs of `shingle` words (of all its words, if there are fewer), sorted."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(w) - shingle + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)) if w else np.zeros(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


#: MinHash bands and values in each: pairs at similarity 0.8 share a band with probability 1 - (1 - 0.8^8)^40 = 0.9994, at
#: 0.5 with 0.14, so texts that share a passage but are not near copies seldom become candidates.
BANDS, BAND_ROWS = 40, 8
_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)


def bands(text: str | None, shingle: int = 5) -> np.ndarray | None:
    """Signed hashes of the MinHash bands of a text; None if it has no word."""
    h = shingles(text, shingle)
    if not len(h):
        return None
    least = np.min([(h[i : i + 256, None] * _TIMES + _PLUS).min(axis=0) for i in range(0, len(h), 256)], axis=0).reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED + n) for n, x in enumerate(least)], np.uint64).view(np.int64)


#: Rounds in which each text is checked against one of each group at most, before the pairs that are left are checked one by one.
STAR_ROUNDS = 8


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, shingle: int = 5) -> DataFrame:
    """Links (a, b) between documents, each named by xxhash64 of its id and text hash, at Jaccard similarity `least` or more.

    Candidates share a MinHash band; each is checked on its whole set of shingles, which is made once for each text. The components of the links are those
    of all candidate pairs that pass, but no group is expanded into its pairs: in each round a group of texts that share a
    band has one centre, each text is checked against the first centre of its groups, and texts that links have led to
    one text need no check with each other. When a round links less than a tenth of its pairs, or few pairs are open, the
    pairs between texts of a group that are still apart are checked one by one, so no link is lost. What is left then are
    texts that share a band but are no near copies; their pairs are few by the choice of the bands.
    """

    @F.pandas_udf("array<long>")
    def banded(texts: pd.Series) -> pd.Series:
        return pd.Series([bands(t, shingle) for t in texts], dtype=object)

    @F.pandas_udf("array<long>")
    def shingled(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, shingle).view(np.int64) for t in texts], dtype=object)

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) >= least for x, y in zip(a, b)], dtype=bool)

    docs = small_batches(docs)
    named = docs.select(node(docs, id_col, text_col).alias("node"), F.col(text_col).alias("text"))
    keys = written(named.select("node", banded("text").alias("keys"))).select("node", F.explode("keys").alias("k"))
    # a second key makes the small side be dealt again, so that Spark can split a band that very many texts share
    shared = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.xxhash64("k").alias("k2"))
    rows = written(keys.withColumn("k2", F.xxhash64("k")).join(shared, ["k", "k2"]).select("k", "k2", "node").distinct()).withColumn("root", F.col("node"))
    sets = written(named.join(rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", shingled("text").alias("set")))

    def checked(pairs: DataFrame, most: int | None = None) -> DataFrame:
        """The pairs that pass. Where there are `most` pairs at most, they are dealt anew to the files that so many rows need; the
        checks themselves run in all partitions."""
        of = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
        found = pairs.join(of("a"), "a").join(of("b"), "b").where(close("set_a", "set_b")).select(*pairs.columns)
        return cut(found if most is None else found.repartition(most // FILE_ROWS + 1))

    links, held, nodes = None, rows.count(), sets.count()
    for r in range(STAR_ROUNDS):
        if links is not None:
            each = rows.groupBy("k", "root").agg(F.count("*").alias("n")).groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("joined"))
            size = each.where("n * n > joined").agg(F.sum(F.expr("(n * n - joined) div 2")), F.sum("n")).first()
            if not size[1] or size[0] <= 4 * size[1] or not paid:
                break
        centre = F.struct(F.xxhash64(F.lit(r), "node").alias("rank"), F.col("node").alias("a"), F.col("root").alias("a_root"))
        star = rows.groupBy("k", "k2").agg(F.min(centre).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("k", "c", F.xxhash64("k2").alias("k3"))
        first = rows.withColumn("k3", F.xxhash64("k2")).join(star, ["k", "k3"]).where("root <> c.a_root").groupBy("node").agg(F.min(F.struct("c", "root")).alias("x"))
        first = cut(first, nodes)
        found = checked(first.select(F.col("x.c.a").alias("a"), F.col("node").alias("b"), F.col("x.c.a_root").alias("ra"), F.col("x.root").alias("rb")), nodes)
        paid = 10 * found.count() >= first.count()
        links = found.select("a", "b") if links is None else links.union(found.select("a", "b"))
        # the least root within two steps, which joins all texts that one centre has linked
        both = found.select("ra", "rb").union(found.select("rb", "ra")).union(found.select("ra", "ra")).union(found.select("rb", "rb")).distinct()
        one = both.groupBy(F.col("ra").alias("rb")).agg(F.min("rb").alias("r1"))
        two = both.join(one, "rb").groupBy(F.col("ra").alias("root")).agg(F.min("r1").alias("r2"))
        rows = cut(rows.join(two, "root", "left").select("k", "k2", "node", F.coalesce("r2", "root").alias("root")), held)
    left = rows.select("k", F.col("node").alias("a"), F.col("root").alias("ra"))
    right = rows.select("k", F.col("node").alias("b"), F.col("root").alias("rb"))
    return links.union(checked(left.join(right, "k").where("a < b and ra <> rb").select("a", "b").distinct()))


def node(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col], F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))


def dedup_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, shingle: int = 5) -> DataFrame:
    """`docs` with one document (the least id, then the least text hash; null ids last) of each group of similar_links()."""
    parts = settled(docs.sparkSession, lambda: connected_components(similar_links(docs, id_col, text_col, least, shingle)).withColumnRenamed("node", "__node"))
    found = docs.select(node(docs, id_col, text_col).alias("__node"), F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("h")).alias("rank"))
    best = found.join(parts, "__node").groupBy("root").agg(F.min(F.struct("rank", "__node")).alias("best")).select("best.__node")
    gone = parts.select("__node").join(best, "__node", "left_anti")
    return docs.join(gone, node(docs, id_col, text_col) == gone["__node"], "left_anti")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
