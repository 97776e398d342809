"""Connected components: of links that lie in many tasks, and of those within one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.session import materialise


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component, after more links, of nodes 0 to ``len(parent) - 1``.

    ``parent`` is the result so far, at first each node itself. Roots are hooked to smaller ones and
    paths shortened until no link joins two roots; all links are looked at in one step.
    """
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while ((shorter := parent[parent]) != parent).any():
            parent = shorter
    return parent


def components(links: DataFrame) -> DataFrame:
    """``node, root`` from links ``u, v``: the smallest node that each linked node other than it can reach.

    Rounds of large and small stars: each node's larger neighbours, then its smaller ones, are tied
    to the smallest. All steps are joins and minima per node, so a hub is never gathered. A round is
    written once; rounds end when one changes nothing.
    """
    pairs = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, before = materialise(pairs.distinct(), "links", free=True), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(lowest, F.col("u") == F.col("c"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(lowest, F.col("u") == F.col("c"))
        tied = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(tied.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "stars", free=True)


def clusters(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node, the root among them."""
    tied = components(links)
    return tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
