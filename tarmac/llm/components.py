"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a, b) with a > b.

    A node's smallest neighbour comes from a partial aggregate and is joined back, so the
    neighbours of a hub are never gathered in one place.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")) \
        .unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) \
        .where("a <> b").distinct()
    large = stored(large, "stars")
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    return large.join(low, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y")) \
        .unionAll(low.select(F.col("a").alias("x"), F.col("m").alias("y"))).where("x <> y") \
        .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    The table is written each round; only its count and a checksum come to the driver.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
               "stars")
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark or not now[0]:
            break
        mark, e = now, stored(_stars(e), "stars")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
