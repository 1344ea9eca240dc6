"""Connected components of an edge table, by alternating star contractions.

Each round hangs every node's larger neighbours on its least neighbour and
then its smaller neighbours (and itself) on the least of them. Only minima
and joins on nodes are needed; no component is ever gathered. Rounds write
their edges to the shared folder, so plans stay short and lost executors cost
little. The rounds end when the edges no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import materialize


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (u, v), any direction, repeats allowed -> (node, component): the
    least node reachable, for every node that has an edge to another."""
    current = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    current = materialize(spark, current, "edges")
    before = _digest(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(spark, large.where("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        current = materialize(spark, small.where("u <> v").distinct(), "edges")
        after = _digest(current)
        if after == before:
            break
        before = after
    # Stars: every node hangs on the least of its component.
    own = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
