"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.session import forget, materialize


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, root): each node of an edge and the least node of its component.

    Every round hangs nodes on the least neighbour they know; the number of rounds grows with
    the logarithm of the longest path, and they end once every edge ends in a node that has none but greater
    neighbours, which the nodes' minima tell before a round's joins. What is read twice is written to the shared folder, so
    no lineage builds up and nothing is computed again; minima are aggregated within tasks before they are dealt, and the
    joins that follow have one row a node on one side. Loops and null ends are dropped."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        if not least.where("m < u AND n > 1").limit(1).count():
            forget(least)
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        met = both.join(least.select("u", F.least("u", "m").alias("m")), "u").where("v > u")
        large = materialize(met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(hung.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "stars")
        forget(e, least, large)
        e = after
