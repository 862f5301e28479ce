"""Benchmark decontamination with spaced seeds (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small_batches, table, written

TOKEN = re.compile(r"\w+")
#: Which tokens of a window count (1) and which are ignored (0): eight equal tokens in a row are always a hit, and so is a
#: window whose substitutions all fall on ignored places. With the last four a run of 8 to 19 tokens of which a fifth at most are
#: substituted, wherever inside it, is met by a mask in 0.96 of the cases or more for each length and number, and in all from
#: 16 on (tested); with the first four alone it would be a quarter for two among ten.
MASKS = ("11111111", "1101100110101", "1110010110111", "11010111", "1111101", "11100111", "10110111", "1100110011")
#: Tokens of the shortest run that may have substitutions. Items of fewer have one seed, all of their tokens, and match as a whole.
SHORT = 8
#: Bits for each seed of the benchmark in the filter that documents are read through, the most bits in all, and probes. A
#: larger benchmark lets more documents through to the join, which decides.
FILTER_BITS, FILTER_MOST, PROBES = 48, 1 << 30, 6
#: Equal seeds within so many tokens of each other are a repetitive run; its first and last stand for the run.
RUN = 16


def lowered(text: str) -> str:
    """Lower case that keeps every code point in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokens(text: str) -> list[str]:
    """Words of letters, digits and underscores, in lower case."""
    return TOKEN.findall(lowered(text))


class TokenHashes(dict):
    """Hashes of tokens, each computed when it is first asked for; cleared when it has grown too large."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = tokens(text or "")
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def masks_for(lengths: list[int]) -> list[tuple[int, np.ndarray, int]]:
    """(number, counted places, span) of the spaced masks and of the whole-item masks of the given short lengths."""
    spaced = [(n, np.flatnonzero([c == "1" for c in m]), len(m)) for n, m in enumerate(MASKS, 1)]
    return spaced + [(100 + n, np.arange(n), n) for n in lengths]


def seeds(h: np.ndarray, owner: np.ndarray, masks: list[tuple[int, np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask the hashes of all its windows in the token hashes `h` and their places; no window spans two owners."""
    for number, places, span in masks:
        n = len(h) - span + 1
        if n > 0:
            at = np.flatnonzero(owner[:n] == owner[span - 1 :])
            x = np.full(n, number, np.uint64)
            for k in places:
                x = (x ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
            yield x[at], at


def run_ends(owner: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the hits to keep: in a run of equal hashes of one owner, each within RUN of the next, the first and the last."""
    order = np.lexsort((at, h, owner))
    near = (np.diff(owner[order]) == 0) & (np.diff(h[order].view(np.int64)) == 0) & (np.diff(at[order]) <= RUN)
    inner = np.zeros(len(order), bool)
    inner[1:-1] = near[:-1] & near[1:]
    return np.sort(order[~inner])


def probe(h: np.ndarray, j: int, bits: int) -> np.ndarray:
    """The j-th place of each hash in a filter of `bits` bits, a power of two."""
    return (h + np.uint64(j) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def longest_run(same: np.ndarray, identity: float) -> tuple[int, int, int] | None:
    """(from, to, equal) of the longest run that begins and ends with an equal token and has `identity` equal ones at least."""
    i = np.flatnonzero(same)
    if not len(i):
        return None
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - identity, -identity))])
    least = np.minimum.accumulate(total[i])
    first = np.searchsorted(-least, -total[i + 1] - 1e-9, "left")
    length, equal = i + 1 - i[first], np.arange(len(i)) - first + 1
    k = int(np.lexsort((-i, equal, length))[-1])
    return int(i[first[k]]), int(i[k]) + 1, int(equal[k])


def benchmark_classes(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item_id, cls) of each item with a token, and (cls, n, tokens) of each different sequence of tokens."""
    kind = dict(benchmark.dtypes)[item_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([cache.of(t.as_py()).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], ["item_id", "tokens"])

    rows = small_batches(benchmark).select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, f"item_id {kind}, tokens array<long>")
    rows = written(rows.where("size(tokens) > 0").withColumn("cls", F.xxhash64("tokens")))
    return rows.select("item_id", "cls"), written(rows.groupBy("cls").agg(F.first("tokens").alias("tokens")).select("cls", F.size("tokens").alias("n"), "tokens"))


def benchmark_seeds(classes: DataFrame) -> DataFrame:
    """(h, cls, n, item_at) of each seed of the benchmark, inner seeds of repetitive runs left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, h, at, size = [], [], [], []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = t.values.to_numpy(zero_copy_only=False).view(np.uint64)
                found = list(seeds(x, np.zeros(len(x), np.int8), masks_for([]) if len(x) >= SHORT else masks_for([len(x)])[-1:]))
                fh, fa = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                keep = run_ends(np.zeros(len(fh), np.int8), fh, fa)
                h.append(fh[keep])
                at.append(fa[keep])
                cls.append(np.full(len(keep), c, np.int64))
                size.append(np.full(len(keep), len(x)))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(at).astype(np.int32))], ["h", "cls", "n", "item_at"])

    return written(classes.select("cls", "tokens").mapInArrow(run, "h long, cls long, n int, item_at int"))


def seed_filter(found: DataFrame) -> np.ndarray:
    """A Bloom filter of the seeds as 64-bit words; its size follows their number up to FILTER_MOST bits."""
    bits = 1 << min(FILTER_MOST.bit_length() - 1, max(6, (FILTER_BITS * found.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([probe(h, j, bits) for j in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

    words = found.select("h").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bit")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64).view(np.uint64)
    return out


def _seeded(docs: DataFrame, held, short: list[int], kind: str) -> DataFrame:
    """`docs` (doc_id, text_hash, text) with a seed that passes the filter, and all such seeds with their places."""
    masks = masks_for(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, words = TokenHashes(), held.value
        bits = len(words) * 64
        for batch in batches:
            found = [cache.of(t.as_py()) for t in batch.column(2)]
            size = np.array([len(x) for x in found], np.int64)
            if not size.sum():
                continue
            h, owner = np.concatenate(found), np.repeat(np.arange(len(found)), size)
            start = np.cumsum(size) - size
            hit_h, hit_at = [], []
            for x, at in seeds(h, owner, masks):
                for j in range(PROBES):  # each on the seeds that are left
                    p = probe(x, j, bits)
                    ok = words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1) == 1
                    x, at = x[ok], at[ok]
                hit_h.append(x)
                hit_at.append(at)
            x, at = np.concatenate(hit_h or [h[:0]]), np.concatenate(hit_at or [start[:0]])
            keep = run_ends(owner[at], x, at)
            x, at = x[keep], at[keep]
            order = np.argsort(owner[at], kind="stable")
            x, at = x[order], at[order]
            row, n = np.unique(owner[at], return_counts=True)
            edge = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            take = pa.array(row)
            lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(v)) for v in (x.view(np.int64), (at - start[owner[at]]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), *lists], ["doc_id", "text_hash", "text", "hs", "ats"])

    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, text string, hs array<long>, ats array<int>")


def _windows(rows: DataFrame) -> DataFrame:
    """The document's tokens that stand beside each item's, for each diagonal in `rows` (cand, text, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenHashes()
        for batch in batches:
            for cand, text, at in zip(*(batch.column(k) for k in range(3))):
                text = text.as_py()
                h = cache.of(text).view(np.int64)
                spans = np.array([m.span() for m in TOKEN.finditer(lowered(text))], np.int32).reshape(-1, 2)
                wanted = at.as_py()
                for part in range(0, len(wanted), 256):
                    cols: list[list] = [[] for _ in range(5)]
                    for d in wanted[part : part + 256]:
                        i, j = max(0, d["shift"]), min(len(h), d["shift"] + d["n"])
                        for c, v in zip(cols, (d["cls"], i - d["shift"], h[i:j], spans[i:j, 0], spans[i:j, 1])):
                            c.append(v)
                    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array([cand.as_py()] * len(cols[0]), pa.int64()), *map(pa.array, cols, kinds)], ["cand", "cls", "item_from", "own", "starts", "ends"])

    return rows.mapInArrow(run, "cand long, cls long, item_from int, own array<long>, starts array<int>, ends array<int>")


def _verified(rows: DataFrame, identity: float, share: float, least: int, long: int) -> DataFrame:
    """The longest run of each diagonal that counts."""
    names = ["cand", "cls", "start", "end", "item_start", "item_end", "equal_tokens", "item_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            ids = [batch.column(k).to_pylist() for k in range(3)]
            for r, (cand, cls, first) in enumerate(zip(*ids)):
                own, starts, ends, item = (batch.column(k)[r].values.to_numpy(zero_copy_only=False) for k in range(3, 7))
                n = len(item)
                found = longest_run(own == item[first : first + len(own)], identity)
                if not found:
                    continue
                i, j, equal = found
                if equal == n if n < SHORT else j - i >= max(least, share * n) or j - i >= long:
                    for c, v in zip(out, (cand, cls, int(starts[i]), int(ends[j - 1]), first + i, first + j, equal, n)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(out)], names)

    return rows.select("cand", "cls", "item_from", "own", "starts", "ends", "tokens").mapInArrow(run, ", ".join(f"`{n}` {'long' if k < 2 else 'int'}" for k, n in enumerate(names)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", identity: float = 0.8, share: float = 0.5, least: int = SHORT, long: int = 50) -> DataFrame:
    """One row for each document and benchmark item whose texts overlap: the longest verified overlap.

    (doc_id, text_hash, item_id, start, end, item_start, item_end, equal_tokens, item_tokens): start and end are code
    points of the document's text, item_start and item_end tokens of the item. Documents are read once, through a filter of
    the benchmark's seeds; those with a seed in it are joined with the benchmark on the seeds' hashes, and around each hit
    the texts are aligned. A run of tokens counts if it begins and ends with an equal one, has `identity` equal ones, and has
    `long` tokens, or `least` tokens and `share` of the item. Items of fewer than SHORT tokens count if they appear whole.

    Null and empty texts or items overlap nothing. Repeated rows each match, on either side; equal items are verified once.
    Of runs of one length that with more equal tokens is returned, then the earliest. Ids may have any type, and other
    columns are not read. An empty table on either side gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    members, classes = benchmark_classes(benchmark, item_col, item_text_col)
    found = benchmark_seeds(classes)
    short = sorted(r["n"] for r in classes.where(F.col("n") < SHORT).select("n").distinct().collect())  # fewer than SHORT numbers
    held = docs.sparkSession.sparkContext.broadcast(seed_filter(found))
    source = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    cand = written(_seeded(source, held, short, kind).withColumn("cand", F.monotonically_increasing_id()))
    hits = cand.select("cand", F.explode(F.arrays_zip("hs", "ats")).alias("x")).select("cand", F.col("x.hs").alias("h"), F.col("x.ats").alias("at"))
    diagonals = hits.join(found, "h").select("cand", "cls", "n", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    wanted = diagonals.groupBy("cand").agg(F.collect_list(F.struct("cls", "n", "shift")).alias("at"))
    windows = _windows(cand.select("cand", "text").join(wanted, "cand").select("cand", "text", "at"))
    best = F.max(F.struct((F.col("item_end") - F.col("item_start")).alias("length"), "equal_tokens", (-F.col("start")).alias("early"), "start", "end", "item_start", "item_end", "item_tokens")).alias("b")
    runs = _verified(windows.join(classes.select("cls", "tokens"), "cls"), identity, share, least, long).groupBy("cand", "cls").agg(best)
    return (
        runs.join(members, "cls").join(cand.select("cand", "doc_id", "text_hash"), "cand")
        .select("doc_id", "text_hash", "item_id", "b.start", "b.end", "b.item_start", "b.item_end", "b.equal_tokens", "b.item_tokens")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """`docs` without the documents that overlap a benchmark item (see contaminated()); all columns and other rows stay.

    Rows equal in id and text stay or go together; null and empty texts stay. An empty benchmark leaves all rows.
    """
    row_id, row_hash = fresh(docs.columns, "__id"), fresh(docs.columns, "__hash")
    hit = contaminated(docs, benchmark, id_col, text_col, **limits).select(F.col("doc_id").alias(row_id), F.col("text_hash").alias(row_hash)).distinct()
    return docs.join(hit, docs[id_col].eqNullSafe(hit[row_id]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == hit[row_hash]), "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
