"""Connected components of a graph whose edges Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse.session import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node (root) of each node's component, for edges (a, b) between numbers.

    In each round every node is merged into its smallest neighbour, if that is smaller, and edges
    are drawn between what was merged, until none is left. Nulls and loops are no edges; repeated
    edges count once; nodes without edges are not returned. Only counts come to the driver.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = roots.withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("parent")).where("parent < root")
        parents = stored(parents, "parents")
        roots = roots.join(parents, "root", "left")
        roots = stored(roots.select("node", F.coalesce("parent", "root").alias("root")), "roots")
        above = parents.withColumnRenamed("root", "a")
        edges = edges.join(above, "a", "left").select(F.coalesce("parent", "a").alias("a"), "b")
        above = parents.withColumnRenamed("root", "b")
        edges = edges.join(above, "b", "left").select("a", F.coalesce("parent", "b").alias("b"))
        edges = stored(edges.where("a <> b").distinct(), "edges")
    return roots
