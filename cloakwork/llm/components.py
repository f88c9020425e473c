"""Connected components of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component``: for every node of a link, the smallest node it can reach.

    Each round hooks every component that has a smaller neighbour below the smallest one, shortens
    the chains that arise by following two steps at once, and contracts the links. Components that
    still touch at least halve, so rounds grow with the logarithm. A link to NULL is no link.
    """
    low, high = F.least(left, right).alias("low"), F.greatest(left, right).alias("high")
    edges = links.where(f"{left} IS NOT NULL AND {right} IS NOT NULL AND {left} != {right}")
    edges = stored(edges.select(low, high).distinct(), "edges")
    nodes = edges.select(F.col("low").alias("node")).union(edges.select("high")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    while not edges.isEmpty():
        parents = stored(edges.groupBy("high").agg(F.min("low").alias("parent")), "parents")
        parents = _flattened(parents)
        labels = stored(_renamed(labels, "component", parents), "labels")
        moved = _renamed(_renamed(edges, "low", parents), "high", parents)
        moved = moved.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"))
        edges = stored(moved.where("low != high").distinct(), "edges")
    return labels


def _renamed(rows: DataFrame, name: str, parents: DataFrame) -> DataFrame:
    new = parents.select(F.col("high").alias(name), "parent")
    others = [c for c in rows.columns if c != name]
    return rows.join(new, name, "left").select(*others, F.coalesce("parent", name).alias(name))


def _flattened(parents: DataFrame) -> DataFrame:
    """Every node's parent becomes its root."""
    while True:
        above = parents.select(F.col("high").alias("parent"), F.col("parent").alias("above"))
        both = stored(parents.join(above, "parent", "left"), "parents")
        if both.where("above IS NOT NULL").isEmpty():
            return parents
        parents = both.select("high", F.coalesce("above", "parent").alias("parent"))
