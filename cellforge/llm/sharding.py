"""Sharding by extendible hashing (operator 4)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.operators.scan import global_scan

from .common import cut, fresh, table, written

#: Bits of the hash, and the byte limit of a shard.
BITS = 60
LIMIT = 64 << 20


def _bits_of_md5(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def key_hash(key: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of id and text, so that rows of one id, or of none, part; nulls count as empty."""
    return _bits_of_md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def _parted(rows: DataFrame, limit: int) -> DataFrame:
    """`rows` (with h, n_bytes) where rows that are equal in id and text, and together over the limit, get hashes of their own.

    Such rows are numbered range by range, so no task holds all copies of a row; which copy gets which number makes no
    difference, as they are equal.
    """
    h2 = fresh(rows.columns, "h2")
    many = rows.groupBy(F.col("h").alias(h2)).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c")).where(f"b > {limit} and c > 1").select(h2)
    many = cut(many)
    if many.isEmpty():
        return rows
    number, place, least = (fresh(rows.columns, n) for n in ("__copy", "__place", "__least"))
    hot = cut(rows.join(many, F.col("h") == F.col(h2), "left_semi").withColumn(number, F.monotonically_increasing_id()))
    hot = cut(global_scan(hot, ["h", number], place=place))
    first = hot.groupBy(F.col("h").alias(h2)).agg(F.min(place).alias(least))
    own = hot.join(first, F.col("h") == F.col(h2)).withColumn("h", _bits_of_md5(F.concat_ws(":", F.col("h"), F.col(place) - F.col(least)))).select(*rows.columns)
    return rows.join(many, F.col("h") == F.col(h2), "left_anti").union(own)


def shard_directory(sizes: DataFrame, bits: int, limit: int) -> DataFrame:
    """(slot, depth, prefix, shard_bytes, shard_docs): the bucket of each slot of the leading `bits` bits.

    `sizes` has (slot, bytes, docs, low, high). A bucket is split on its next bit only while it is over the limit and
    holds more than one hash, so a bucket is a leaf when it need not be split and its parent had to be.
    """
    nodes = sizes.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("prefix", F.expr(f"shiftright(slot, {bits} - depth)"))
    sums = nodes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("low").alias("low"), F.max("high").alias("high"))
    split = (F.col("shard_bytes") > limit) & (F.col("low") < F.col("high")) & (F.col("depth") < bits)
    sums = sums.withColumn("split", split)
    parents = sums.where("split").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    leaf = (
        sums.where("not split").withColumn("up", F.expr("shiftright(prefix, 1)")).join(parents, ["depth", "up"], "left_semi").select("depth", "prefix", "shard_bytes", "shard_docs")
        .union(sums.where("depth = 0 and not split").select("depth", "prefix", "shard_bytes", "shard_docs"))
    )
    return nodes.select("slot", "depth", "prefix").join(leaf, ["depth", "prefix"])


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard_id, shard_depth, shard_bytes, shard_docs) of each document.

    shard_id is the bucket's hash prefix as bits ('' for the only bucket). Bytes are those of the UTF-8 text, none for
    null. The table is read once, for id, hash and bytes of each row; all else works on these. Sizes are summed per slot
    of the directory first, and the directory stays a distributed table; slots take more bits until no slot with more than
    one hash is over the limit. A shard over the limit holds one row: rows of one id part by their texts, and rows equal
    in both are numbered if they are over the limit together. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), key_hash(F.col(id_col), F.col(text_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    rows, slot, where = _directory(_parted(written(rows), limit), limit)
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return rows.withColumn("slot", slot).join(where, "slot").select("doc_id", "n_bytes", name.alias("shard_id"), F.col("depth").alias("shard_depth"), "shard_bytes", "shard_docs")


def _directory(rows: DataFrame, limit: int) -> tuple[DataFrame, Column, DataFrame]:
    """`rows`, the slot of a row, and the bucket of each slot."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + 3))
    while True:
        slot = F.expr(f"shiftright(h, {BITS - bits})")
        sizes = cut(rows.groupBy(slot.alias("slot")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("low"), F.max("h").alias("high")))
        if bits == BITS or sizes.where(f"bytes > {limit} and low < high").isEmpty():
            return rows, slot, shard_directory(sizes, bits, limit)
        bits = min(BITS, bits + 6)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Writes the documents below `path`, one folder shard_id=... for each shard ('' as Spark's default partition).

    All rows and columns are written, nulls, repeated rows and empty texts included; a column of `docs` that is named
    shard_id keeps its name, and the folders then have an underscore more. An empty table gives an empty folder.
    """
    names = docs.columns
    own = {n: fresh(names, f"__{n}") for n in ("text", "id")}
    held = [c for c in names]
    # columns named as those of this module step aside until the rows have their shard
    aside = {c: f"__col{i}" for i, c in enumerate(held)}
    rows = docs.select(*(F.col(f"`{c}`").alias(aside[c]) for c in held))
    rows = rows.withColumn("h", key_hash(F.col(aside[id_col]), F.col(aside[text_col]))).withColumn("n_bytes", F.coalesce(F.octet_length(aside[text_col]), F.lit(0)).cast("long"))
    rows, slot, where = _directory(_parted(rows, limit), limit)
    shard_id = fresh(names, "shard_id")
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    out = rows.withColumn("slot", slot).join(where, "slot").select(*(F.col(aside[c]).alias(c) for c in held), name.alias(shard_id))
    out.repartition(shard_id).write.partitionBy(shard_id).mode("overwrite").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shard(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
nodes AS (SELECT d.*, t.depth, CASE WHEN t.depth = 0 THEN 0 ELSE h >> ({BITS} - t.depth) END AS prefix FROM d, (SELECT unnest(range(0, {BITS + 1}))::INT AS depth) t),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs, sum(n_bytes) > {LIMIT} AND min(h) < max(h) AS split FROM nodes GROUP BY 1, 2),
leaf AS (SELECT s.* FROM sums s LEFT JOIN sums p ON p.depth = s.depth - 1 AND p.prefix = s.prefix >> 1 WHERE NOT s.split AND (s.depth = 0 OR p.split))
SELECT n.doc_id, n.n_bytes, CASE WHEN n.depth = 0 THEN '' ELSE right(lpad(bin(n.prefix), 64, '0'), n.depth) END AS shard_id, n.depth AS shard_depth, l.shard_bytes, l.shard_docs
FROM nodes n JOIN leaf l USING (depth, prefix)
"""
QUERIES = {"op4_sharding": op4_sharding}
ORACLES = {"op4_sharding": ORACLE}
