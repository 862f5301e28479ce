"""Divergence of sources from each other and from their language by joint count histograms (operator 12)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table, written

#: Least number of a language's documents that hold a kept term, and the terms reported for each source.
LEAST_DOCS, TOP_TERMS = 10, 10
#: (language, source, term) counts that a task gathers before it hands them on, and bytes of text (which keep n under 2^31).
GATHERED, GATHERED_BYTES = 1 << 19, 1 << 30
#: (source, term) counts that a block of terms holds on average.
BLOCK_COUNTS = 1 << 16
#: Rows of groups, or of pairs of groups, that may go to all tasks; more of them are joined by a shuffle.
SENT_ROWS = 1 << 15
#: Bytes as terms see them: A-Z lowered, other ASCII that is no letter a space, all else as it is.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): how often each term stands in a group's documents, and in how many of them.

    Terms are runs of ASCII letters and characters beyond ASCII; only A-Z are lowered. Null texts, languages and sources are
    ''. Each group also has a row without term (null), so that groups without terms are there. Tasks sum up before they
    hand on, so a hot source costs rows in proportion to its vocabulary; a row is not unique yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a cell is n * 2^32 + docs
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = read = 0

        def result() -> pa.RecordBatch:
            of = np.repeat(np.arange(len(held)), [len(t) + 1 for t in held.values()])
            terms = [t for group in held.values() for t in (None, *group)]
            cells = np.fromiter((c for group in held.values() for c in (0, *group.values())), np.int64, len(terms))
            lang, source = (pa.array([g[i] for g in held], pa.string()).take(pa.array(of)) for i in (0, 1))
            columns = [lang, source, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(cells >> 32), pa.array(cells & (1 << 32) - 1)]
            return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for i, group in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                terms = held.get(group)
                if terms is None:
                    terms = held[group] = {}
                size -= len(terms)
                text, known = texts[i].as_py(), terms.get
                for term, n in Counter(text.translate(PLAIN).split()).items():
                    terms[term] = known(term, 0) + (n << 32) + 1
                size += len(terms)
                read += len(text)
                if size >= GATHERED or read >= GATHERED_BYTES:
                    yield result()
                    held, size, read = {}, 0, 0
        if held:
            yield result()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = small_batches(docs).select(empty(text_col).alias("text"), empty(lang_col).alias("lang"), empty(source_col).alias("source"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(n: Column | int, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact for any counts; `total` and `terms` name columns."""
    n = n if isinstance(n, Column) else F.lit(n)
    up = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    down = (F.col(total) + 2 * F.col(terms)).cast("decimal(20,0)")
    return 1 + F.call_function("div", up, down)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so the square has 60 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from its other sources (`pair`), and the
    terms that it has most above its language (`term`, ranks to `top`).

    For two sources, the terms are tallied by their two counts: a joint histogram of the counts that both have, and each
    source's own histogram of counts, from which the cells with an implied zero follow. The divergence is evaluated once for
    each combination (of a block of terms) and multiplied by its multiplicity. As it is symmetric, each pair is tallied once. Terms are
    dealt to blocks of bounded size by a hash, so a block's tallies need no shuffle; what leaves it is one sum a pair.
    A term's sources are one array: pairs of sources are rows of the result, so arrays are shorter than that.

    Every (lang, source) that occurs is a group, with or without terms. Null texts, languages and sources are ''. Repeated
    rows count as documents of their own. Languages with no kept term give pairs of value 0 and no terms. Ties go by the item's
    UTF-8 bytes. Ids and other columns are not read. An empty table gives no rows.
    """
    counts = term_counts(docs, text_col, lang_col, source_col)
    # a term's rows of all tasks are summed by source first, so that a frequent term's are not all dealt to one task
    summed = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = summed.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"), F.sum("docs").alias("docs"))
    by_term = written(by_term.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).select("lang", "term", "cells"))
    groups = by_term.where("term is null").select("lang", F.explode("cells.source").alias("source"))
    terms = by_term.where("term is not null")
    lang_n = F.expr("aggregate(cells, 0L, (s, c) -> s + c.n)")
    cells = terms.select("lang", "term", lang_n.alias("lang_n"), F.explode("cells").alias("cell")).select("lang", "term", "lang_n", "cell.source", "cell.n")

    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(lang_n).alias("lang_total"), F.sum(F.size("cells")).alias("rows"))
    totals = groups.join(sums, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "lang_total", "rows")))
    totals = cut(totals)
    n = F.count("*")
    rows, sources, couples = (x or 0 for x in totals.groupBy("lang").agg(F.max("rows").alias("rows"), n.alias("n"), (n * n).alias("n2")).agg(F.sum("rows"), F.sum("n"), F.sum("n2")).first())
    return _pairs(terms, cells, totals, 1 + rows // BLOCK_COUNTS, couples).union(_top_terms(cells, totals, top, sources))


def _beside(small: DataFrame, rows: int) -> DataFrame:
    """A side of a join with so many rows. Said here, as Spark takes the other side, counts unfolded from compressed arrays, for
    no larger than their file, and would send that through the driver."""
    return F.broadcast(small) if rows <= SENT_ROWS else small.hint("merge")


def _pairs(terms: DataFrame, cells: DataFrame, totals: DataFrame, blocks: int, couples: int) -> DataFrame:
    """The part `pair`.

    With f(0, 0) for all terms as the start, a count of one source alone adds f(c, 0) - f(0, 0), and one that both have adds
    f(c, d) - f(c, 0) - f(0, d) + f(0, 0) to that.
    """
    side = lambda x: totals.select("lang", F.col("source").alias(x), F.col("total").alias(f"{x}_total"))
    kept = totals.groupBy("lang").agg(F.max("terms").alias("terms"))
    pairs = side("a").join(side("b"), "lang").where("a < b").join(kept, "lang")
    beside = _beside(pairs, couples)
    p = lambda n, x: probability(n, f"{x}_total", "terms")
    f_none = divergence(p(0, "a"), p(0, "b"))

    dealt = terms.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks))).repartition("lang", "block")
    first = dealt.select("lang", "block", "cells", F.posexplode("cells").alias("i", "cell_a"))
    both = first.select("lang", "block", "cell_a", F.explode(F.expr("slice(cells, i + 2, size(cells))")).alias("cell_b"))
    tally = both.groupBy("lang", "block", F.col("cell_a.source").alias("a"), F.col("cell_b.source").alias("b"), F.col("cell_a.n").alias("c"), F.col("cell_b.n").alias("d")).agg(F.count("*").alias("times"))
    joint = tally.join(beside, ["lang", "a", "b"])
    extra = divergence(p(F.col("c"), "a"), p(F.col("d"), "b")) - divergence(p(F.col("c"), "a"), p(0, "b")) - divergence(p(0, "a"), p(F.col("d"), "b")) + f_none
    joint = joint.groupBy("lang", "a", "b").agg(F.sum(extra * F.col("times")).alias("part"))

    own = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    alone_a = own.withColumnRenamed("source", "a").join(beside, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum((divergence(p(F.col("n"), "a"), p(0, "b")) - f_none) * F.col("times")).alias("part"))
    alone_b = own.withColumnRenamed("source", "b").join(beside, ["lang", "b"]).groupBy("lang", "a", "b").agg(F.sum((divergence(p(0, "a"), p(F.col("n"), "b")) - f_none) * F.col("times")).alias("part"))
    start = pairs.select("lang", "a", "b", F.when(F.col("terms") == 0, F.lit(0).cast("long")).otherwise(F.when(F.col("terms") > 0, f_none) * F.col("terms")).alias("part"))
    value = start.unionByName(joint).unionByName(alone_a).unionByName(alone_b).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return _ranked(value.select("lang", "value", way.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value"))


def _top_terms(cells: DataFrame, totals: DataFrame, top: int, sources: int) -> DataFrame:
    """The part `term`; only the first `top` of a group on each side of the shuffle are ranked further."""
    rows = cells.join(_beside(totals.drop("rows"), sources), ["lang", "source"])
    rows = rows.withColumn("p", probability(F.col("n"), "total", "terms")).withColumn("q", probability(F.col("lang_n"), "lang_total", "terms")).where("p > q")
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the others and against its language."""
    return audit_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op12_source_divergence": op12_source_divergence}

ORACLES = {
    "op12_source_divergence": r"""
    WITH docs AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
    v AS (SELECT lang, (SELECT count(*) FROM kept k WHERE k.lang = l.lang) AS terms, (SELECT coalesce(sum(lang_n), 0) FROM kept k WHERE k.lang = l.lang) AS lang_total FROM (SELECT DISTINCT lang FROM docs) l),
    cells AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
    grp AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN cells c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
    p AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.terms) AS p,
        1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (v.lang_total + 2 * v.terms) AS q
      FROM grp g JOIN v ON g.lang = v.lang JOIN kept k ON k.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    tops AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
