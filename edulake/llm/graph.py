"""Connected components of a graph given by its edges, as joins and aggregations that shrink it to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edulake.session import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node that it is joined to, for every node of an edge.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows. Both keep the components and the rounds grow with the logarithm of a component's size. A
    hub is an equality join against one row per node, whose skewed partitions Spark splits. Each round is settled, so
    its lineage stays short. Nulls are no nodes, loops add nothing, and no edges give no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND u <> v")
    edges = settle(edges.distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(larger.distinct())
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        smaller = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
