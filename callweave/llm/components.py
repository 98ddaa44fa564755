"""Connected components of an edge table, by alternating large-star and small-star steps.

Labels stay distributed; each round joins the edges with a minimum per node (partially
aggregated, so a node with very many links is no hot key) and cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_value, cut


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that an edge touches; a component is named by its smallest node.

    Self loops and edges with a null end touch nothing; repeated edges count once; no edges give no rows.
    """
    e = cut(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # every larger neighbour now points at the smallest; a node's own link to it comes from that node's own side
        own = least.where("u <> m").select("u", F.col("m").alias("v"))
        big = cut(large.unionAll(own).distinct())
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        new = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        # stars only: no node is both a leaf and a centre, and each leaf has one centre
        leaves = new.groupBy("u").agg(F.count("*").alias("n"))
        unfinished = leaves.where("n > 1").select("u").unionAll(new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi")).limit(1).count()
        e = new
        if not unfinished:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


by_value(__name__)
