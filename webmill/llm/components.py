"""Connected components of a table of links, by alternating large and small stars. Nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webmill.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """links (u, v: long, any order, repeats and loops allowed) -> (node, root), root the least node of its component.

    Nodes without a link to another are not returned. Each round joins every node's links with the least of its
    neighbours; rounds grow with the logarithm of the longest path. Both sides of a join are exchanged, so a node
    with very many links may be split.
    """
    edges = C.table(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(1)).alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u").bitwiseXOR(F.lit(1)) == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(1)).alias("k"), "m")
        small = large.join(least, F.col("u").bitwiseXOR(F.lit(1)) == F.col("k")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges, done = C.table(small.select("e.u", "e.v").filter("u <> v").distinct()), edges
        C.drop(done)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
