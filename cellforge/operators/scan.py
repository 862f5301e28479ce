"""Scans over a whole table in an order, without bringing it into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellforge.lineage import cut


def global_scan(rows: DataFrame, order: list[str | Column], value: str | None = None, place: str = "place", before: str = "before") -> DataFrame:
    """Rows with their place in the whole order, from 0, and with `value` the sum of the values before them.

    Two levels, as a parallel prefix sum goes: rows are dealt by ranges of the order, each range is scanned by a task of
    its own, and only one count and sum per range meet to give the ranges their offsets. Ranges are fixed by a
    checkpoint, since sampling them again could move rows. Ties are ordered arbitrarily; give a full order for a stable
    result. Nulls count as zero.
    """
    taken = set(rows.columns)
    if {place, "__range"} & taken or value and before in taken:
        raise ValueError("the columns of the scan are taken")
    dealt = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    w = Window.partitionBy("__range").orderBy(*order)
    inner = dealt.withColumn(place, F.row_number().over(w) - 1)
    sums = [F.count("*").alias("__n")]
    if value:
        inner = inner.withColumn(before, F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        sums.append(F.coalesce(F.sum(value), F.lit(0)).alias("__s"))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("__range").agg(*sums).select("__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__n0"), *([F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__s0")] if value else []))
    out = inner.join(F.broadcast(ranges), "__range")  # a row per range, so as many as partitions
    return out.select(*rows.columns, (F.col(place) + F.col("__n0")).alias(place), *([(F.col(before) + F.col("__s0")).alias(before)] if value else []))


def carried_scan(rows: DataFrame, by: str, order: list[str], sums: list[str] = [], lasts: list[str] = []) -> DataFrame:
    """Rows with each of `sums` replaced by its sum up to and with the row, and each of `lasts` by its last value that is not null,
    in the order of the rows of the same `by`.

    As global_scan: ranges of the whole order are scanned by tasks of their own, and what a range hands on, its sums and its
    last values, is one row for each range and value of `by` in it. So a single `by` may hold the whole table. Nulls count as zero in sums.
    """
    if "__range" in rows.columns:
        raise ValueError("the columns of the scan are taken")
    dealt = cut(rows.repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id()))
    w = Window.partitionBy("__range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = dealt.select(*[c for c in dealt.columns if c not in (*sums, *lasts)], *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in sums], *[F.last(c, ignorenulls=True).over(w).alias(c) for c in lasts])
    place = F.struct(*order)
    own = dealt.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__r")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__{c}") for c in sums], *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__{c}") for c in lasts])
    ahead = Window.partitionBy("__by").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    before = own.select("__by", "__r", *[F.coalesce(F.sum(f"__{c}").over(ahead), F.lit(0)).alias(f"__{c}") for c in sums], *[F.last(f"__{c}", ignorenulls=True).over(ahead).alias(f"__{c}") for c in lasts])
    out = inner.join(before, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__r")))
    changed = {**{c: F.col(c) + F.col(f"__{c}") for c in sums}, **{c: F.coalesce(c, f"__{c}") for c in lasts}}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns])


#: Parts of [0, 1) that numbers are counted in to find the n least of a group.
PARTS = 4096


def least_of_groups(rows: DataFrame, group: str, number: Column, ties: list[str], n: int) -> DataFrame:
    """The n rows of the least numbers, in [0, 1], of each group; ties go by the columns of `ties`. Exact.

    Numbers are counted by parts first, so only the rows of the parts that reach n are moved, and only rows of one part
    are ranked together, not a whole group. Even numbers (a hash) make the parts alike.
    """
    taken = set(rows.columns)
    if {"__u", "__part", "__before", "__n", "__g"} & taken:
        raise ValueError("the columns of the choice are taken")
    drawn = rows.withColumn("__u", number).withColumn("__part", F.floor(F.col("__u") * PARTS))
    counts = drawn.groupBy(F.col(group).alias("__g"), "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.select("__g", F.col("__part").alias("__p"), before.alias("__before")).where(F.col("__before") < n)
    near = drawn.join(parts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    rank = F.row_number().over(Window.partitionBy(group, "__part").orderBy("__u", *ties))
    return near.withColumn("__n", rank).where(F.col("__n") + F.col("__before") <= n).select(*rows.columns)


def place_in_group(rows: DataFrame, group: str, order: list[str], place: str = "place") -> DataFrame:
    """Rows with their place, from 0, in their group; a group may hold most of the table, as ranges of it are scanned
    (see global_scan)."""
    placed = global_scan(rows, [group, *order], place=place)
    # a second key makes the small side be dealt again, so that Spark can split the rows of one group
    first = placed.groupBy(F.col(group).alias("__g")).agg(F.min(place).alias("__first")).withColumn("__g2", F.xxhash64("__g"))
    both = placed.withColumn("__h", F.xxhash64(group)).join(first, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__h") == F.col("__g2")))
    return both.select(*rows.columns, (F.col(place) - F.col("__first")).alias(place))
