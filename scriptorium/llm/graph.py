"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in `edges` (a, b): the component is its least node.

    Large-star and small-star steps in turn: each node links its neighbours to the least of them, until nothing
    changes; rounds grow with the logarithm of a component's size. A frequent node only ever has its minimum taken
    and is joined by key, and the edges never become more. Null ends and loops are ignored.
    """
    links = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, last = cut(links), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(least.withColumnRenamed("m", "b").unionByName(small).distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    # settled: each edge leads to its component's least node
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
