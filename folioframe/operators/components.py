"""Connected components over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.session import discard, materialize, same_table


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("hi").agg(F.min("lo").alias("lowest"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbor of a node to the smallest node next to it."""
    lowest = _lowest(edges).withColumnRenamed("hi", "lo")
    return (
        edges.join(lowest, "lo", "left")
        .select("hi", F.coalesce("lowest", "lo").alias("lo"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbors to the smallest of them."""
    lowest = _lowest(edges)
    moved = (
        edges.join(lowest, "hi")
        .filter(F.col("lo") != F.col("lowest"))
        .select(F.col("lo").alias("hi"), F.col("lowest").alias("lo"))
    )
    return moved.unionByName(lowest.withColumnRenamed("lowest", "lo")).distinct()


def _is_finished(edges: DataFrame) -> bool:
    """Every node has one parent and no parent has a parent itself."""
    children = edges.groupBy("hi").agg(F.min("lo").alias("a"), F.max("lo").alias("b"))
    forked = children.filter(F.col("a") != F.col("b")).select("hi")
    chained = edges.select(F.col("lo").alias("hi")).join(edges, "hi", "left_semi").select("hi")
    return forked.union(chained).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that is not itself the smallest of its component.

    ``edges`` has two columns of one orderable type. Each round applies the large-star and
    small-star operations; both are one aggregation with map-side combine plus one join against a
    table with one row per node, so a hub node neither gathers its neighbors in one task nor
    multiplies edges: the join only has to split the hub's rows, which AQE does. A round's result
    is written to the shared folder and the previous round is deleted.
    """
    a, b = edges.columns
    current = materialize(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .filter(F.col("hi") != F.col("lo"))
        .distinct()
    )
    while True:
        following = materialize(_small_star(_large_star(current)))
        discard(current)
        current = following
        if _is_finished(current):
            result = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            return same_table(result, current)
