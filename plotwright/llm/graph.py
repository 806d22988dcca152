"""Connected components of links, by alternating large and small stars. All steps are joins and sums; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.llm.common import cut


def stars(edges: DataFrame, small: bool) -> DataFrame:
    """One round over ``edges`` (a > b, distinct): neighbours of each node are hung on the least of them and itself."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = both.join(least, "a")
    if small:
        out = hung.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    else:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (columns a, b) and the least node of its component, roots included. Rounds go on until the edges stay what they were."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    count = edges.count()
    while count:
        after = cut(stars(stars(edges, False), True))
        n = after.count()
        same = n == count and not after.join(edges, ["a", "b"], "left_anti").limit(1).count()
        edges, count = after, n
        if same:
            break
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
