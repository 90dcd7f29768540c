"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a long, b long) reaches.

    Each round links the larger neighbours of every node to its least neighbour, then every node and its
    smaller neighbours to the least of them, until each node hangs on its component's least node.  Groups
    are only reduced to their minimum, so a node with very many neighbours is no burden.  Nodes without an edge
    to another node are not in the result.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    links = written(edges.where("a <> b").select(most.alias("a"), least.alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = written(small.unionAll(low.select("a", F.col("low").alias("b"))).distinct(), "links")
        state = after.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        links = after
        if state == before or not state[0]:
            break
        before = state
    roots = links.select(F.col("b").alias("a")).distinct().withColumn("b", F.col("a"))
    return links.unionAll(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
