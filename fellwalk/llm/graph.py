"""Connected components: inside a task on numpy arrays, and across the cluster by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


class Union:
    """Sets of the numbers 0..n-1; the root of a set is its least number."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def flat(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.flat()
            a, b = root[a], root[b]
            differ = a != b
            a, b = a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            self.parent[high] = low  # of several, one stays; the rest follow in the next round


class Forest:
    """Edges between ids, thinned now and then to one edge for each id that is not the least of its set."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.size, self.parts = most, 0, []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b))
            self.size += len(a)
            if self.size > self.most:
                self.parts = [self.edges()]
                self.size = len(self.parts[0][0])
                self.most = max(self.most, 2 * self.size)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, least id of its set)."""
        if not self.parts:
            none = np.zeros(0, np.int64)
            return none, none
        a, b = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        sets = Union(len(ids))
        sets.join(at[: len(a)], at[len(a) :])
        root = sets.flat()
        own = np.flatnonzero(root != np.arange(len(ids)))
        return ids[own], ids[root[own]]


#: Most nodes that are looked up by broadcast: those that more than 1 in HUBS edges point to (LEAST_HUB at least).
HUBS, LEAST_HUB = 10_000, 1000


def lowered(e: DataFrame, edges: int) -> DataFrame:
    """Edges (u, m) with m replaced by its own least smaller neighbour, where it has one.

    A node that a large share of the edges point to would bring all of them into one task of a join. There
    are at most HUBS such nodes, so they go by broadcast, and a task of the join gets few edges of a node.
    """
    low = e.groupBy(F.col("u").alias("of")).agg(F.min("m").alias("low"))
    hubs = e.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > max(LEAST_HUB, edges // HUBS)).select(F.col("m").alias("hub"))
    hubs = hubs.join(low, F.col("hub") == F.col("of"), "left").select("hub", F.coalesce("low", "hub").alias("low"))
    at_hub = e.join(F.broadcast(hubs), F.col("m") == F.col("hub")).select("u", F.col("low").alias("m"))
    others = e.join(F.broadcast(hubs.select("hub")), F.col("m") == F.col("hub"), "left_anti")
    return at_hub.union(others.join(low, F.col("m") == F.col("of"), "left").select("u", F.coalesce("low", "m").alias("m")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (least node reachable) of every node in `edges` (columns a, b: longs).

    Edges point from the larger to the smaller node. Each round moves the smaller end of every edge to that
    node's own least neighbour, then ties the smaller neighbours of a node to the least of them; both steps
    are aggregations and equi-joins, so no set of nodes is gathered in a task. Rounds grow with the
    logarithm of the longest path; each ends with a reliable checkpoint.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m"))
    e = checkpoint(e.distinct())
    marks = [F.count("*"), F.bit_xor(F.xxhash64("u", "m")), F.sum(F.xxhash64("m", "u") % 1000003)]
    seen = tuple(e.agg(*marks).first())
    for _ in range(rounds):
        large = lowered(e, seen[0]).distinct()
        down = large.groupBy("u").agg(F.min("m").alias("low"))
        small = large.join(down, "u").where("m > low").select(F.col("m").alias("u"), F.col("low").alias("m")).union(down.select("u", F.col("low").alias("m")))
        e = checkpoint(small.distinct())
        now = tuple(e.agg(*marks).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("m").alias("component")).union(e.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
