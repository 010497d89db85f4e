"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.sources import stage


def _closest(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, reduced with map-side combine and joined back."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is its component's smallest node.

    Alternates large-star and small-star steps (each node hands its neighbours its smallest
    one) until nothing changes, a number of rounds that grows with the logarithm of the
    component size. Each round is staged; only two numbers per round reach the driver.
    """
    edges = stage(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _closest(both)
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        small = _closest(large)
        edges = stage(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
