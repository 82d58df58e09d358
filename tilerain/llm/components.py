"""Connected components of a graph given as links."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tilerain.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """Maps every node of links(a long, b long) to the smallest node it reaches: node, root.

    Alternating large-star and small-star steps: each round is a few joins and minima on the link table, which shrinks to
    one star per component in a number of rounds that grows with the logarithm of the longest chain. Nothing but two
    figures per round reaches the driver. Minima fold before the shuffle, and the join on a hub with very many links is
    one that adaptive execution can split. Null ends and self-links are ignored.
    """
    up, down = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(up, down).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("low").alias("y")),
                                                               F.struct(F.col("b").alias("x"), F.col("low").alias("y")))))
                 .select(F.col("col.x").alias("a"), F.col("col.y").alias("b")).where("a <> b").distinct())
        seen = Observation()
        edges = stored(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
        after = (seen.get["n"], seen.get["h"])
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = after
