"""Connected components of a table of links by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekit.llm.scratch import Scratch


def _contract(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang the neighbours of each node, the larger or the others, under the smallest of the neighbourhood."""
    if larger:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
    hung = around.join(least, "u")
    if larger:
        hung = hung.filter("v > u").select(F.col("v").alias("u"), F.col("root").alias("v"))
    else:
        hung = hung.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("root").alias("v")), F.struct("u", F.col("root").alias("v")))))
    return hung.filter("u != v").distinct()


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """``node, component`` (its smallest node) for every node of a table of links ``a, b``.

    Every round is written to the shared folder. Rounds are about the logarithm of the longest chain; only a
    count and a checksum of the edges reach the driver.
    """
    edges = work.keep(links.filter("a != b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    seen = None
    while True:
        edges = work.keep(_contract(_contract(edges, larger=True), larger=False))
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return work.keep(roots.union(own))
