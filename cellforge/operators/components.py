"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.lineage import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that some link touches; root is the least node of its component.

    Nodes are of any type with an order, structs too. A round is two joins on nodes with partially aggregated minima; no round
    has more links than the one before, and rounds grow with the logarithm of the longest path. Nulls and self-links are
    ignored; repeated links count once. An empty table gives an empty result.
    """
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    links = cut(links.distinct())
    before = None
    for _ in range(max_rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        # large star: larger neighbours go to the least one
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node and its smaller neighbours go to the least one
        low = large.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m"))
        small = large.join(low, F.col("hi") == F.col("n")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = cut(small.union(low.select(F.col("n").alias("hi"), F.col("m").alias("lo"))).distinct(), now[0])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return ends.union(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
