"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that some link touches; root is the least node of its component.

    Each round is two joins on node ids with partially aggregated minima, so a hub costs rows in proportion to its
    links, and no round has more rows than the one before; the second key of the joins makes the minima be dealt again, so that Spark can split the rows of a hub. Nulls and self-links are ignored; repeated links count once. Rounds grow with the logarithm of the longest
    path. An empty table gives an empty result.
    """
    e = cut(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        twice = lambda df, c: df.withColumn("key2", F.xxhash64(c))
        large = twice(both, "u").join(twice(least, "u"), ["u", "key2"]).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        e = cut(
            twice(large, "hi").join(twice(low, "hi"), ["hi", "key2"]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(low.select("hi", F.col("m").alias("lo")))
            .distinct(),
            now[0],
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
