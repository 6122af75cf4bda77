"""Connected components of a link table, by alternating star contraction.

Each round is two keyed minima and two joins, all linear in the links.  A hub
with very many neighbours is never a collected list nor one task's join: minima
are taken on the map side first, and those of hubs are broadcast (see
``by_class``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_class, stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(both: DataFrame) -> DataFrame:
    """(u, m, n): the least of u and its v, and how many it has."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the least node reachable.

    Links may repeat, run either way and join a node to itself; rows with a null
    end are ignored.  No links give no rows.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct(),
        "links",
    )
    before = _signature(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        total = 2 * before[0]
        large = by_class(both, _least(both), "u", "n", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "large-links")
        least = _least(large)
        small = by_class(large, least, "u", "n", total).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = stored(small.where("a != b").distinct(), "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
