"""Substring dedup by hashing units of lines (operator 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, small_batches, table

#: Marks of scripts that put no space after a sentence end one alone; others need white space behind them.
SENTENCE_END = re.compile(r"[.!?…।॥۔؟]+[\x20\t\x0b\x0c\r]+|[。！？｡]+[\x20\t\x0b\x0c\r]*")
#: Letters of scripts written without spaces, each a word of its own.
LETTER = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
LETTERS = re.compile(f"[{LETTER}]")
WORD = re.compile(f"[{LETTER}]|[^\\x20\\x09-\\x0D{LETTER}]+")


#: Words of a span that op9 reports: the passages meant are longer, and shorter repeats stand in most clean documents.
PASSAGE_WORDS = 20


def words(text: str) -> int:
    return len(WORD.findall(text)) if LETTERS.search(text) else len(text.encode("utf-8", "surrogatepass").split())


def units(text: str, unit_words: int = 5) -> list[tuple[int, int, bytes]]:
    """(start, end, normalised) of the units of a text, in code points.

    A line is cut at a sentence end once the unit has `unit_words` words; shorter sentences stay with the next. A longer
    sentence always ends a unit, so a passage is cut alike from its first such sentence on wherever it stands.
    Normalised: lower case, white space runs as one space, trimmed. Units without a word are left out.
    """
    out = []
    at = 0
    for line in text.split("\n"):
        cuts, start = [], 0
        for m in SENTENCE_END.finditer(line):
            if words(line[start : m.end()]) >= unit_words:
                cuts.append(m.end())
                start = m.end()
        for i, j in zip([0, *cuts], [*cuts, len(line)]):
            if norm := b" ".join(line[i:j].lower().encode("utf-8", "surrogatepass").split()):
                out.append((at + i, at + j, norm))
        at += len(line) + 1
    return out


def unit_digests(docs: DataFrame, id_col: str, text_col: str, unit_words: int = 5) -> DataFrame:
    """(doc_id, text_hash, unit, start, end, n_words, d1, d2): one row per unit; digests have 128 bits."""
    kind = dict(docs.dtypes)[id_col]
    names = ["doc_id", "text_hash", "unit", "start", "end", "n_words", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, no, start, end, n_words, digest = [], [], [], [], [], []
                for r, text in enumerate(part.column(2).to_pylist()):
                    for k, (i, j, norm) in enumerate(units(text or "", unit_words)):
                        row.append(r)
                        no.append(k)
                        start.append(i)
                        end.append(j)
                        n_words.append(norm.count(b" ") + 1 if norm.isascii() else words(text[i:j]))
                        digest.append(xxhash.xxh3_128_digest(norm))
                both = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), *(pa.array(x, pa.int32()) for x in (no, start, end, n_words)), pa.array(both[:, 0]), pa.array(both[:, 1])],
                    names,
                )

    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, text_hash long, unit int, start int, end int, n_words int, d1 long, d2 long"
    )


def _runs(docs: DataFrame, id_col: str, text_col: str, unit_words: int) -> DataFrame:
    """Runs of neighbouring repeated units, of any length: (doc_id, text_hash, start, end, n_words, n_units, unit, first, last).

    first and last hold the kept places (doc_id, text_hash, start, end) of the run's first and last unit.
    """
    all_units = unit_digests(docs, id_col, text_col, unit_words)
    place = F.struct("doc_id", "text_hash", "start", "end")
    # a third key makes the small side be dealt again, so that Spark can split a passage that very many documents share
    first = all_units.groupBy("d1", "d2").agg(F.min(place).alias("kept"), F.count("*").alias("c")).where("c > 1").select("d1", "d2", F.col("d1").bitwiseXOR(F.col("d2")).alias("d3"), "kept")
    later = all_units.withColumn("d3", F.col("d1").bitwiseXOR(F.col("d2"))).join(first, ["d1", "d2", "d3"]).where(place != F.col("kept")).drop("d1", "d2", "d3").distinct()
    by_doc = Window.partitionBy("doc_id", "text_hash").orderBy("unit")
    run = later.withColumn("run", F.col("unit") - F.row_number().over(by_doc))
    at = F.struct("start", "kept")
    return (
        run.groupBy("doc_id", "text_hash", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_units"), F.min("unit").alias("unit"), F.min(at).alias("first"), F.max(at).alias("last"))
        .select("doc_id", "text_hash", "start", "end", "n_words", "n_units", "unit", F.col("first.kept").alias("first"), F.col("last.kept").alias("last"))
    )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 0, unit_words: int = 5) -> DataFrame:
    """Spans of whole units: (doc_id, text_hash, start, end, n_words, n_units, kept_doc_id, kept_start), offsets in code points.

    Units are ranked by (doc_id, text_hash, start), nulls first; the earliest of equal units stays and every later one
    counts as repeated. Neighbouring repeated units of a document form a span, returned with the place of the kept
    occurrence of its first unit. `min_words`, off by default, leaves shorter spans (greetings, headings) out.
    Null and empty texts have no units. Rows equal in id and text count as one document. An empty table gives no rows.
    """
    runs = _runs(docs, id_col, text_col, unit_words).where(F.col("n_words") >= min_words)
    return runs.select("doc_id", "text_hash", "start", "end", "n_words", "n_units", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))


def _contexts(asked: DataFrame, unit_words: int) -> DataFrame:
    """The unit before (side 0) or behind (side 1) each place that `asked` (doc_id, text_hash, text, places) names, as raw text."""
    kind = dict(asked.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                row, place, side, near = [], [], [], []
                for r, (text, places) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    found = units(text or "", unit_words)
                    starts, ends = {u[0]: k for k, u in enumerate(found)}, {u[1]: k for k, u in enumerate(found)}
                    for p in places:
                        k = ends[p["at"]] + 1 if p["side"] else starts[p["at"]] - 1
                        if 0 <= k < len(found):
                            row.append(r)
                            place.append(p["at"])
                            side.append(p["side"])
                            near.append(text[p["at"] : found[k][1]] if p["side"] else text[found[k][0] : p["at"]])
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(place, pa.int32()), pa.array(side, pa.int32()), pa.array(near, pa.string())], ["doc_id", "text_hash", "at", "side", "near"])

    return asked.mapInArrow(run, f"doc_id {kind}, text_hash long, at int, side int, near string")


def matched(own: str | None, kept: str | None, side: int) -> tuple[int, int, int, int]:
    """How far two texts agree word by word, from their ends (side 0) or starts (side 1): words, code points of both, words of `own`.

    White space between the last agreeing word and the next one goes with the words before it.
    """
    if not own:
        return 0, 0, 0, 0
    a, b = list(WORD.finditer(own)), list(WORD.finditer(kept or ""))
    n = 0
    if side:
        while n < min(len(a), len(b)) and a[n][0].lower() == b[n][0].lower():
            n += 1
        end = [x[n].start() if n < len(x) else x[n - 1].end() if n else 0 for x in (a, b)]
        return n, end[0] if n else 0, end[1] if n else 0, len(a)
    while n < min(len(a), len(b)) and a[-1 - n][0].lower() == b[-1 - n][0].lower():
        n += 1
    return (n, len(own) - a[-n].start(), len(kept) - b[-n].start(), len(a)) if n else (0, 0, 0, len(a))


def extended_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 0, unit_words: int = 5) -> DataFrame:
    """As repeated_spans(), but each run of repeated units, however short, first grows word by word into the units beside
    it as far as they agree with those beside the kept occurrence; runs that meet are one, and `min_words` holds for that.
    """
    runs = cut(_runs(small_batches(docs), id_col, text_col, unit_words))
    ends = [("doc_id", "text_hash", "start", 0), ("doc_id", "text_hash", "end", 1), ("first.doc_id", "first.text_hash", "first.start", 0), ("last.doc_id", "last.text_hash", "last.end", 1)]
    # the places of a run as rows, each once, then as one list a document
    rows = runs.select(F.explode(F.array(*[F.struct(F.col(d).alias("i"), F.col(h).alias("h"), F.col(p).alias("at"), F.lit(k).alias("side")) for d, h, p, k in ends])).alias("x")).select("x.*").distinct()
    asked = rows.groupBy("i", "h").agg(F.collect_list(F.struct("at", "side")).alias("places"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    near = _contexts(texts.join(asked, texts.doc_id.eqNullSafe(asked.i) & (texts.text_hash == asked.h)).select("doc_id", "text_hash", "text", "places"), unit_words)
    # rows equal in id and text give the same context; a third key as in _runs
    near = cut(near.groupBy("doc_id", "text_hash", "at", "side").agg(F.first("near").alias("near")))
    out = runs
    for k, (d, h, p, side) in enumerate(ends):
        part = near.where(F.col("side") == side).select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), F.col("at"), F.col("near").alias(f"near{k}"))
        out = out.join(part, F.col(d).eqNullSafe(part.i) & (F.col(h) == part.h) & (F.col(p) == part["at"]), "left").drop("i", "h", "at")

    @F.pandas_udf("l int, lc int, lk int, lw int, r int, rc int, rk int, rw int")
    def grown(own_l: pd.Series, own_r: pd.Series, kept_l: pd.Series, kept_r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*matched(a, c, 0), *matched(b, d, 1)) for a, b, c, d in zip(own_l, own_r, kept_l, kept_r)], columns=["l", "lc", "lk", "lw", "r", "rc", "rk", "rw"])

    out = out.withColumn("g", grown("near0", "near1", "near2", "near3")).select(
        "doc_id", "text_hash", (F.col("start") - F.col("g.lc")).alias("start"), (F.col("end") + F.col("g.rc")).alias("end"), "n_words", "n_units", "unit", F.col("g.l").alias("l"), F.col("g.r").alias("r"), F.col("g.rw").alias("rw"),
        F.col("first.doc_id").alias("kept_doc_id"), (F.col("first.start") - F.col("g.lk")).alias("kept_start"),
    )
    by_doc = Window.partitionBy("doc_id", "text_hash").orderBy("unit")
    # two runs with one unit between them meet if they grow over all of its words
    before = F.lag(F.struct("unit", "n_units", "r", "rw")).over(by_doc)
    out = out.withColumn("b", before).withColumn("meets", F.coalesce((F.col("unit") == F.col("b.unit") + F.col("b.n_units") + 1) & (F.col("b.r") + F.col("l") >= F.col("b.rw")), F.lit(False)))
    # what the earlier run has of the unit between them does not count twice
    out = out.withColumn("new", F.col("n_words") + F.col("r") + F.when(F.col("meets"), F.col("b.rw") - F.col("b.r")).otherwise(F.col("l")))
    out = out.withColumn("group", F.sum(F.when(F.col("meets"), 0).otherwise(1)).over(by_doc))
    return (
        out.groupBy("doc_id", "text_hash", "group")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("new").alias("n_words"), F.sum("n_units").alias("n_units"), F.min(F.struct("unit", "kept_doc_id", "kept_start")).alias("first"))
        .where(F.col("n_words") >= min_words)
        .select("doc_id", "text_hash", "start", "end", "n_words", "n_units", "first.kept_doc_id", "first.kept_start")
    )


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 0) -> DataFrame:
    """`docs` with the repeated spans cut out of the text; a column `removed` has their offsets in the original text.

    All columns and rows stay, nulls, empty texts and repeated rows among them; untouched texts stay as they are, and
    `removed` is then empty. Of equal units the earliest by (id, text hash, start) stays, null ids first. A column that is
    named as one of the result keeps its name. An empty table gives no rows.
    """
    spans = (
        extended_spans(docs, id_col, text_col, min_words)
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    )
    removed = fresh(docs.columns, "removed")
    joined = docs.join(spans, docs[id_col].eqNullSafe(spans["__id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == spans["__hash"]), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans_col = F.coalesce(spans["__spans"], none)
    text = docs[text_col]
    before = F.transform(spans_col, lambda s, i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans_col, i - 1)["end"]))
    parts = F.transform(F.arrays_zip(spans_col.alias("s"), before.alias("b")), lambda x: F.substring(text, x["b"] + 1, x["s"]["start"] - x["b"]))
    tail = F.substring(text, F.element_at(spans_col, -1)["end"] + 1, F.length(text))
    shorter = F.when(F.size(spans_col) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(text)
    return joined.select(*[shorter.alias(c) if c == text_col else docs[c] for c in docs.columns], spans_col.alias(removed))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of PASSAGE_WORDS words or more that repeats an earlier one, with original offsets and the kept place."""
    return extended_spans(table(spark, sf_dir, "documents"), min_words=PASSAGE_WORDS).drop("text_hash")


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
