"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") / 65536)).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) in any order, repeats and self links allowed; returns (node, root) for every
    node with a link to another one, where root is the smallest node of the component (nodes that are
    their component's root have no row).

    Each round contracts the links towards smaller neighbours with two aggregates and joins on the
    node; rounds grow with the logarithm of the component size. The links of a round are written to
    the shared checkpoint folder; only their count and a checksum reach the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = small.where("a <> b").distinct().checkpoint()
        last, state = state, _state(edges)
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
