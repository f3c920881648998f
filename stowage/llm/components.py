"""Connected components: of element pairs inside a task, and of a whole table of links by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from stowage.llm.common import cut_lineage


def merge(label: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join the groups that the pairs link. ``label`` has the smallest index of each element's group and is updated.

    Returns the positions of pairs that suffice to connect what all pairs connect, and the new labels.
    """
    used = []
    at = np.arange(len(first))
    while len(at):
        a, b = label[first[at]], label[second[at]]
        apart = a != b
        at, low, high = at[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        if not len(at):
            break
        # Each higher group is hung below one lower group, so no pair that is used closes a circle.
        groups, pick = np.unique(high, return_index=True)
        used.append(at[pick])
        parent = np.arange(len(label))
        parent[groups] = low[pick]
        while not np.array_equal(above := parent[parent], parent):
            parent = above
        label = parent[label]
    return (np.concatenate(used) if used else np.empty(0, dtype=np.int64)), label


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node.

    Large and small stars by turns: each node's neighbours are hung below the smallest of them, which ends in one star
    per component after a number of rounds that grows with the logarithm of the size. Every round is written to the
    shared folder. Smallest neighbours are reduced before the shuffle and joined from a table of their own, so that a
    node with very many links is a skewed join, which Spark splits.
    """
    oriented = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(oriented.distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = cut_lineage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")))
        edges = cut_lineage(both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        lowest = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("low")))
        joined = edges.join(lowest, "a")
        hung = joined.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = cut_lineage(hung.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    summed = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(summed)
