"""Line dedup with a deletion-neighbourhood join (operator 1), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, fresh, settled, table, written

#: Lines of fewer words are only compared exactly: a line of one word is an edit away from every other one.
FUZZY_WORDS = 2
#: Words that are hashed as one when the part of a line before or after a place is named.
CHUNK = 64
#: Pieces of the places of a line that its partners may differ in.
PIECES = 4


def _row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _normal(trimmed: Column) -> Column:
    """The words of a trimmed line with single spaces; most lines are so already, and the regular expression is left to the rest."""
    odd = F.contains(trimmed, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(trimmed, F.lit(c))
    return F.when(odd, F.regexp_replace(trimmed, WORD_GAP, " ")).otherwise(trimmed)


def _outer(n: Column, lacks) -> Column:
    """Words at either end of a line of class n + lacks that its keys are made of: about half, in steps of four, so that
    a line is mostly named alike whether it is the full one of a pair or lacks a word."""
    return (F.floor((n + lacks) / 8) * 4).cast("int")


def _ends(w: Column, n: Column) -> Column:
    """Two keys, or four where n + 1 is a multiple of eight, of which two lines at word distance 1 share one; number
    2 * lacks + side.

    A line of n words meets others as the full line of class n and as the line of class n + 1 that lacks a word. Two
    such lines of class N differ at one place; with k = _outer(N), at most N div 2, they agree on the first k words if
    the place is k or later, and else on the last k.
    """
    def pair(lacks: int) -> Column:
        k = _outer(n, lacks)
        return F.array(F.xxhash64(k, F.lit(0), F.slice(w, F.lit(1), k)), F.xxhash64(k, F.lit(1), F.slice(w, n - k + 1, k)))

    return F.when(n % 8 == 7, F.concat(pair(0), pair(1))).otherwise(pair(0))


def _classes(n: Column, role: Column) -> Column:
    """The values of `lacks` that a key of _ends() stands for."""
    return F.when(n % 8 == 7, F.array(F.floor(role / 2).cast("int"))).otherwise(F.array(F.lit(0), F.lit(1)))


def _chunks(h: Column) -> Column:
    """A hash for each whole chunk of the word hashes."""
    whole = F.floor(F.size(h) / CHUNK).cast("int")
    return F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda c: F.xxhash64(F.slice(h, c * CHUNK + 1, F.lit(CHUNK))))).otherwise(F.array().cast("array<long>"))


def _prefix(h: Column, chunks: Column, length: Column) -> list[Column]:
    """What names the first `length` words: their whole chunks and the words beyond, so the cost is a chunk at most and a
    sixty-fourth of the line."""
    whole = F.floor(length / CHUNK).cast("int")
    return [F.slice(chunks, F.lit(1), whole), F.slice(h, whole * CHUNK + 1, length % CHUNK)]


def _without(n: Column, lacks: Column, start: Column, end: Column) -> list[Column]:
    """The hashed key of a line of class N without its words from place `start` to before `end`: (before, after).

    Columns h and r hold the hashes of its words from the left and from the right, hc and rc those of their chunks. For
    a line that lacks a word, `end` counts the missing word too, so lines that agree outside the places have one key.
    """
    size = n + lacks
    return [
        F.xxhash64(size, start, end, *_prefix(F.col("h"), F.col("hc"), start)).alias("before"),
        F.xxhash64(size, start, end, *_prefix(F.col("r"), F.col("rc"), size - end)).alias("after"),
    ]


def _open(n: Column, lacks: Column, side: Column) -> tuple[Column, Column]:
    """Places, from and to before, that a line's partners may differ in when they share the key of the given side."""
    k = _outer(n, lacks)
    return F.when(side == 0, k).otherwise(0), F.when(side == 0, n + lacks).otherwise(k)


def _pieces(n: Column, lacks: Column, side: Column) -> Column:
    """Keys without each piece of those places, as (piece, before, after)."""
    a, b = _open(n, lacks, side)
    at = lambda k: (a + F.floor((b - a) * k / PIECES)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.struct(k.alias("piece"), *_without(n, lacks, at(k), at(k + 1))))


def _variants(n: Column, lacks: Column, side: Column, piece: Column) -> Column:
    """The deletion variants of one line in a piece, as (place, before, after): all lines of a key are within one edit of
    each other."""
    a, b = _open(n, lacks, side)
    at = lambda k: (a + F.floor((b - a) * k / PIECES)).cast("int")
    first, end = at(piece), at(piece + 1)
    return F.transform(F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.struct(j.alias("place"), *_without(n, lacks, j, j + 1)))


def _lines(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line) of every line with a word, normalised."""
    return (
        rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select("doc_id", "text_hash", "line_no", _trim(F.col("line")).alias("line"))
        .where("line <> ''")
        .select("doc_id", "text_hash", "line_no", _normal(F.col("line")).alias("line"))
    )


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with one key more, made of `keys`: an aggregate by `keys` is then dealt again for a join on all of them,
    and Spark can split the rows of a hot key, such as that of a template line with one changing word."""
    return rows.withColumn("again", F.xxhash64(F.lit(2), *keys))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, text) of the documents."""
    return docs.select(F.col(id_col).alias("doc_id"), _row_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def _near(base: DataFrame, distinct: DataFrame) -> DataFrame:
    """(pos, near): each distinct line that an earlier one is a word edit away from, with the earliest such line."""
    ends = distinct.where("ends is not null").select("doc_id", "text_hash", "line_no", F.posexplode("ends").alias("role", "key"))
    shared = ends.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    wanted = (
        _dealt(ends, ["key"]).join(_dealt(shared, ["key"]).hint("shuffle_hash"), ["key", "again"], "left_semi")
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "line_no").agg(F.collect_set("role").alias("roles"))
        .groupBy("__id", "__hash").agg(F.collect_list(F.struct("line_no", "roles")).alias("wanted"))
    )
    lines = (
        base.join(wanted.hint("shuffle_hash"), base["doc_id"].eqNullSafe(wanted["__id"]) & (base["text_hash"] == wanted["__hash"]))
        .select("doc_id", "text_hash", "wanted", F.split("text", "\n").alias("lines"))
        .select("doc_id", "text_hash", F.explode(F.transform("wanted", lambda x: F.struct(x["line_no"].alias("line_no"), F.get("lines", x["line_no"]).alias("line"), x["roles"].alias("roles")))).alias("x"))
        .select(F.struct("doc_id", "text_hash", "x.line_no").alias("pos"), _normal(_trim(F.col("x.line"))).alias("line"), "x.roles")
        .where("line <> ''")
        .select("pos", F.split("line", " ").alias("w"), "roles")
    )
    lines = written(lines)
    lacks, side = F.col("lacks"), (F.col("role") % 2).cast("int")

    def hashed(rows: DataFrame, *more: str) -> DataFrame:
        return (
            rows.select("pos", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), *more)
            .select("pos", "h", F.reverse("h").alias("r"), *more)
            .select("pos", "h", "r", _chunks(F.col("h")).alias("hc"), _chunks(F.col("r")).alias("rc"), *more)
        )

    # lines that agree with another outside one piece
    pieces = (
        hashed(lines, "roles").select("*", F.explode("roles").alias("role")).select("*", F.explode(_classes(F.size("h"), F.col("role"))).alias("lacks"))
        .select("pos", "role", "lacks", F.explode(_pieces(F.size("h"), lacks, side)).alias("p")).select("pos", "role", "lacks", "p.*")
    )
    cut_key = ["before", "after"]
    shared = pieces.groupBy(*cut_key).agg(F.count("*").alias("c")).where("c > 1").select(*cut_key)
    spots = _dealt(pieces, cut_key).join(_dealt(shared, cut_key).hint("shuffle_hash"), [*cut_key, "again"], "left_semi").groupBy("pos").agg(F.collect_set(F.struct("role", "lacks", "piece")).alias("spots"))
    # and their deletion variants in that piece
    variants = (
        hashed(lines.join(spots, "pos"), "spots")
        .select("*", F.explode("spots").alias("s")).select("pos", "h", "r", "hc", "rc", "s.role", "s.lacks", "s.piece")
        .select("pos", F.explode(_variants(F.size("h"), lacks, side, F.col("piece"))).alias("v"))
        .select("pos", "v.*")
    )
    earliest = variants.groupBy(*cut_key).agg(F.min("pos").alias("kept"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = _dealt(variants, cut_key).join(_dealt(earliest, cut_key).hint("shuffle_hash"), [*cut_key, "again"]).where("pos <> kept").groupBy("pos", "kept").agg(F.min("place").alias("place"))
    text = lines.select("pos", "w").dropDuplicates(["pos"])  # rows equal in id and text give the same lines
    both = pairs.join(text, "pos").join(text.select(F.col("pos").alias("kept"), F.col("w").alias("v")), "kept")
    w, v, at = F.col("w"), F.col("v"), F.col("place")
    after = lambda a, b: F.slice(a, at + F.when(F.size(a) >= F.size(b), 2).otherwise(1), F.size(a) + 1)
    same = (F.slice(w, F.lit(1), at) == F.slice(v, F.lit(1), at)) & (after(w, v) == after(v, w))
    return both.where(same).groupBy("pos").agg(F.min("kept").alias("near"))


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """(doc_id, text_hash, removed) for each document that loses a line.

    `removed` lists (line_no, kept_doc_id, kept_line_no) in order: the lines that go and the place each repeats. Lines
    are split at \\n and compared by their words. A line goes if an earlier line has the same words, or, with
    `fuzzy_words` words or more, if an earlier line has them but for one word put in, left out or replaced. Earlier: by
    (id, hash of the text, line number) of a line's first occurrence, null ids first. Lines without a word always stay.
    Rows equal in id and text count as one document.

    Lines that share neither end with another line have no neighbour, nor have lines that agree with no other outside
    one piece of what lies between; only what is left emits deletion variants, in that piece. All lines under one variant are a word edit apart at
    most, so the earliest of them stands for all: rows grow with the lines, never with pairs.
    """
    base = _base(docs, id_col, text_col)
    lines = _lines(base)
    place = F.struct("doc_id", "text_hash", "line_no")
    w = F.split("line", " ")
    ends = F.when(F.size("w") >= fuzzy_words, _ends(F.col("w"), F.size("w")))
    named = written(lines.select("doc_id", "text_hash", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), w.alias("w")).select("*", ends.alias("ends")).drop("w"))
    distinct = written(
        named.groupBy("h1", "h2").agg(F.min(place).alias("pos"), F.count("*").alias("c"), F.first("ends").alias("ends"))
        .select("h1", "h2", "pos.*", (F.col("c") > 1).alias("many"), "ends")
    )
    near = _near(base, distinct)
    going = distinct.select("h1", "h2", place.alias("pos"), "many").join(near, "pos", "left").where("many or near is not null").select("h1", "h2", F.col("pos").alias("first"), "near")
    return (
        named.select(place.alias("pos"), "h1", "h2").join(going.hint("shuffle_hash"), ["h1", "h2"])
        .where((F.col("pos") != F.col("first")) | F.col("near").isNotNull())
        .select("pos", F.coalesce("near", "first").alias("kept"))
        .groupBy(F.col("pos.doc_id").alias("doc_id"), F.col("pos.text_hash").alias("text_hash"))
        .agg(F.array_sort(F.collect_set(F.struct(F.col("pos.line_no").alias("line_no"), F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no")))).alias("removed"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fuzzy_words: int = FUZZY_WORDS, count_col: str | None = None) -> DataFrame:
    """`docs` with the removed lines cut out of the text (see line_decisions); documents left without a line go.

    A document goes only if lines were removed and none with a word is left. Other rows and all columns stay; null and
    empty texts stay as they are. `count_col` names a column for the number of removed lines. An empty table gives no
    rows.
    """
    decided = settled(docs.sparkSession, lambda: line_decisions(docs, id_col, text_col, fuzzy_words))
    names = {n: fresh(docs.columns, f"__{n}") for n in ("hash", "id", "other", "gone", "text")}
    col = {n: F.col(c) for n, c in names.items()}
    rows = docs.withColumn(names["hash"], _row_hash(F.col(text_col)))
    gone = decided.select(F.col("doc_id").alias(names["id"]), F.col("text_hash").alias(names["other"]), F.col("removed.line_no").alias(names["gone"]))
    joined = rows.join(gone.hint("shuffle_hash"), rows[id_col].eqNullSafe(gone[names["id"]]) & (rows[names["hash"]] == gone[names["other"]]), "left")
    # what stands between removed lines stays; the text is split only where lines go
    edges = F.concat(F.array(F.lit(-1)), col["gone"])
    between = lambda lines: F.flatten(F.transform(edges, lambda e, i: F.slice(lines, e + 2, F.coalesce(F.get(col["gone"], i), F.size(lines)) - e - 1)))
    kept = F.array_join(F.get(F.transform(F.array(F.split(text_col, "\n")), between), F.lit(0)), "\n")
    out = joined.withColumn(names["text"], F.when(col["gone"].isNull(), F.col(text_col)).otherwise(kept))
    out = out.where(col["gone"].isNull() | col["text"].rlike("[^\\x20\\x09-\\x0D]"))
    columns = [col["text"].alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if count_col:
        columns.append(F.coalesce(F.size(col["gone"]), F.lit(0)).alias(fresh(docs.columns, count_col)))
    return out.select(*columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that keeps a line, with its remaining text and the number of removed lines."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_removed")


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
o AS (SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM l),
d AS (SELECT w, len(w) AS n, min((doc_id, line_no)) AS pos FROM o WHERE len(w) > 0 GROUP BY w),
k AS (
  SELECT pos, md5(n || ':' || j || ':' || array_to_string(w[1:j], ' ') || '|' || array_to_string(w[j + 2:], ' ')) AS key FROM (SELECT *, unnest(range(0, n)) AS j FROM d WHERE n >= {FUZZY_WORDS})
  UNION ALL
  SELECT pos, md5((n + 1) || ':' || j || ':' || array_to_string(w[1:j], ' ') || '|' || array_to_string(w[j + 1:], ' ')) AS key FROM (SELECT *, unnest(range(0, n + 1)) AS j FROM d WHERE n >= {FUZZY_WORDS})),
m AS (SELECT key, min(pos) AS least FROM k GROUP BY key HAVING count(*) > 1),
near AS (SELECT DISTINCT pos FROM k JOIN m USING (key) WHERE least < pos),
j AS (
  SELECT o.doc_id, o.line_no, o.line, o.w, coalesce(d.pos <> (o.doc_id, o.line_no) OR near.pos IS NOT NULL, false) AS gone
  FROM o LEFT JOIN d ON o.w = d.w AND len(o.w) > 0 LEFT JOIN near ON near.pos = d.pos)
SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone) AS text, count(*) FILTER (WHERE gone)::INT AS n_removed
FROM j GROUP BY doc_id HAVING NOT bool_or(gone) OR bool_or(NOT gone AND len(w) > 0)
UNION ALL SELECT doc_id, text, 0 FROM documents WHERE text IS NULL
"""
QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": ORACLE}
