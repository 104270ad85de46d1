"""Connected components of large graphs, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, written

#: Parts into which the neighbours of one node are dealt; beyond, adaptive execution splits skewed joins.
SALTS = 8


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest id among u and all that are paired with it; hubs are salted."""
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(smallest, ["u", "salt"]).select("u", "v", "m")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest id that each node of the edges (a, b) reaches, for all nodes but the roots themselves.

    Each round hangs the larger neighbours of a node on its smallest (large star), then a node and its smaller
    neighbours on the smallest of those (small star); a number of rounds that grows with the logarithm of the graph's
    size leaves one star for each component. Each round's edges are written to the shared folder, so lineage stays
    short; no node's neighbours are gathered anywhere. Edges with a null end, loops and repeated edges do no harm.
    """
    big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(spark, edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(big, small).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both).filter("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = _to_smallest(large)
        after = written(spark, stars.select("u", F.col("m").alias("v")).unionByName(stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        remove(spark, now)
        now = after
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
