"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.session import discard, written


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable number of each of ``n`` nodes, for links that fit in memory."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _towards_smallest(pairs: DataFrame, keep) -> DataFrame:
    """Link the chosen neighbours of each node to the smallest node around it."""
    low = pairs.groupBy("a").agg(F.min("b").alias("low"))
    low = low.select("a", F.least("a", "low").alias("low"))
    return pairs.join(low, "a").where(keep).select(F.col("b").alias("a"), F.col("low").alias("b"))


def roots(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of a link table ``a, b`` (long): the smallest reachable node.

    Each round writes its links to the shared folder. The number of rounds grows with the logarithm
    of the longest path; the driver sees one count and one checksum per round.
    """
    links = written(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        wide = _towards_smallest(_both_ways(links), F.col("b") > F.col("a")).distinct()
        # Small star: neighbours not above the node, and the node itself.
        low = wide.groupBy("a").agg(F.min("b").alias("low"))
        narrow = wide.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        before, links = links, written(
            narrow.unionByName(low.toDF("a", "b")).where("a <> b").distinct(), "links"
        )
        discard(before)
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == state:
            break
        state = now
    stars = links.toDF("node", "root")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
