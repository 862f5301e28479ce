"""Quality rules with compression bands (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size over raw size, by UTF-8 length, from one rule.

    Prose of n bytes compresses to about `floor` + `slope` / n ** `power` of its size: the rate falls as the compressor
    has more text to refer to. A text or chunk is repetitive below `least` of that, and incompressible above `most` of it
    if it is also over `random` (base64 gives 0.76; scripts of several bytes a letter give more than prose in ASCII).
    """

    floor: float = 0.36
    slope: float = 3.5
    power: float = 0.4
    least: float = 0.8
    most: float = 1.35
    random: float = 0.70
    chunk: int = 2048
    #: A document fails when more than this share of its full chunks is outside the limits of a chunk.
    chunk_share: float = 0.25
    level: int = 3

    def limits(self, n: int) -> tuple[float, float]:
        typical = self.floor + self.slope / n**self.power
        return self.least * typical, max(self.random, self.most * typical)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    w = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            if line in seen:
                dup_lines += 1
            seen.add(line)
    repeat = 0
    if len(w) > 5:
        windows = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if len(set(windows)) < len(windows):
            once: set = set()
            twice: set = set()
            for x in windows:
                (twice if x in once else once).add(x)
            covered = 0
            for i, x in enumerate(windows):
                if x in twice:
                    repeat += i + 5 - max(covered, i)
                    covered = i + 5
    return len(w), chars, symbols, dup_lines, repeat


def compression_verdict(raw: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of full chunks outside their limits, and whether the text is inside all bands."""
    n = len(raw)
    if not n:
        return 0.0, 0.0, False
    whole = len(press.compress(raw)) / n
    least, most = bands.limits(n)
    chunk_least, chunk_most = bands.limits(bands.chunk)
    ratios = [len(press.compress(raw[i : i + bands.chunk])) / bands.chunk for i in range(0, n - bands.chunk + 1, bands.chunk)]
    outside = sum(not chunk_least <= r <= chunk_most for r in ratios) / max(1, len(ratios))
    return whole, outside, least <= whole <= most and outside <= bands.chunk_share


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, zstd_outside double"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Base counts and the verdict of every document, one row each: id, the counts, base_failed, kept, the ratios.

    A null text has no words, so it fails like an empty one. Every text is read whole. Rows repeated with one id each
    give a row, and equal texts the same one; a ratio on a limit is inside. Other columns are not read. An empty table
    gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for text in batch.column(1):
                t = text.as_py() or ""
                n, chars, symbols, lines, repeat = base_counts(t)
                failed = n < 10 or 100 * repeat > 20 * n
                ratio, outside, inside = compression_verdict(t.encode("utf-8", "surrogatepass"), bands, press)
                for column, v in zip(out, (n, chars, symbols, lines, repeat, failed, not failed and inside, ratio, outside)):
                    column.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], ["doc_id", *names])

    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {RESULT}")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op5_quality_rules": op5_quality_rules}
