"""Connected components on DataFrames by rounds of contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def pointed(labels: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``column`` of ``labels`` replaced by its parent where it has one."""
    up = parents.select(F.col("high").alias(column), F.col("to").alias("_to"))
    rest = [c for c in labels.columns if c != column]
    return labels.join(up, column, "left").select(*rest, F.coalesce("_to", column).alias(column))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); the root is the least node.

    Each round, every node points to its least neighbour below, pointers are
    shortened, and the edges are redrawn between what is pointed to, until
    none is left. Neighbours are only ever aggregated, never gathered, so a
    node with any number of edges is one row of a sum.
    """
    ends = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    left = stage(ends(edges))
    labels = left.select(F.col("high").alias("node")).union(left.select("low")).distinct().withColumn("root", F.col("node"))
    while not left.isEmpty():
        parents = left.groupBy("high").agg(F.min("low").alias("to"))
        parents = stage(pointed(pointed(parents, "to", parents), "to", parents))
        labels = pointed(labels, "root", parents)
        left = stage(ends(pointed(pointed(left, "high", parents), "low", parents).select(F.col("high").alias("a"), F.col("low").alias("b"))))
    return stage(labels)
