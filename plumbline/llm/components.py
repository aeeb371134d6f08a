"""Connected components of large graphs by alternating large-star and small-star steps; no step gathers a component."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_lookup, materialize

MAX_ROUNDS = 60


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and smallest node of its component, for the nodes of the links (a, b) that aren't their own root."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) without nulls to (node, root): root is the smallest node of the component; roots themselves are left out.

    Each step replaces a node's links by links to its smallest neighbour, so all nodes of a component end up linked to its
    smallest; the number of steps grows with the logarithm of the longest path. Hot nodes are dealt over salted partitions.
    Steps are written to the shared folder.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(cur)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = group_lookup(both, ["a"], [("m", "min", "b")], spread="b")
        # large star: larger neighbours of a node move to the smallest node around it
        large = near.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = materialize(large, "large-star")
        # small star: a node and its smaller neighbours move to the smallest of them
        near = group_lookup(large, ["a"], [("m", "min", "b")], spread="b")
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(near.select("a", F.col("m").alias("b")))
        cur = materialize(moved.distinct(), "small-star")
        after = _state(cur)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
