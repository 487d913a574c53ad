"""Connected components of a graph given by its links, with links only ever moved by Spark joins.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014). A node's smallest neighbour comes from an aggregation that each task starts on
its own rows and is written out; it goes back to the links by a plain join of two exchanges, the kind
whose crowded keys adaptive execution can split: no task ever holds all neighbours of a node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_blend.llm.common import stage


def connected_components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)``; a component is its smallest node.

    Links may repeat, point either way or to the node itself. No links give no rows.
    """
    both = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = stage(links.select(*both).where("a <> b").distinct(), "links")
    before = _print(links)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        links = stage(_small_star(_large_star(links)), "links")
        after = _print(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = stage(ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "smallest")
    larger = ways.where("b > a")
    # Where no neighbour is smaller the links stay as they are, so the join keeps them.
    moved = larger.join(smallest, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    smallest = stage(links.groupBy("a").agg(F.min("b").alias("least")), "smallest")
    moved = links.join(smallest, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = smallest.select("a", F.col("least").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()


def _print(links: DataFrame) -> tuple:
    """Two sets of links with the same count, sum and exclusive or of hashes are the same set."""
    h = F.xxhash64("a", "b")
    return tuple(
        links.agg(
            F.count(F.lit(1)), F.bit_xor(h), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))
        ).first()
    )


def local_roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """The smallest index of each index's component among ``n``, by the links ``a - b``.

    ``roots`` is an earlier answer that these links extend, so links can be given in parts.
    """
    roots = np.arange(n) if roots is None else roots
    while True:
        x, y = roots[a], roots[b]
        differ = x != y
        if not differ.any():
            return roots
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(roots, further := roots[roots]):
            roots = further
