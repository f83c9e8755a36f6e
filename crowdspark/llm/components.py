"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so a hub with a third of all links is pre-aggregated
before the shuffle and its join rows are split by adaptive execution; nothing is collected.
Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def star_links(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between places of ``nodes`` as a star per component, each other member to
    the first: as many links as nodes at most, with the same components."""
    root = np.arange(len(nodes))
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if np.array_equal(before, root):
            break
    others = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[others], nodes[root[others]]


def _shape(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the smallest node reachable.

    Links may repeat, point either way or join a node with itself; without links no rows.
    """
    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .where("u > v").distinct(), "links")
    before, shape = None, _shape(now)
    while shape != before:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .distinct())
        large = stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("low").alias("v")),
                                           F.struct(F.greatest("v", "low").alias("u"),
                                                    F.least("v", "low").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u > v").distinct())
        now = stored(small, "small-star")
        before, shape = shape, _shape(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
