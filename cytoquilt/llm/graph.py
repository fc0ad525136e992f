"""Connected components of a link table, by joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cytoquilt.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (u, v), for every node that has one.

    Large-star and small-star steps in turn until nothing changes. A node's
    smallest neighbour is a grouped minimum, summed in the task first, so a node
    with very many links never has its neighbours gathered.
    """
    edges = materialize(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # counted while it is written: no further job
        seen = Observation()
        edges = materialize(small.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
        if seen.get == state:
            break
        state = seen.get
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
