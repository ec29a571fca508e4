"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import common


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) pairs that connect exactly what the pairs (a, b) connect: at most one per node."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ri, rj = root[i], root[j]
        low = np.minimum(ri, rj)
        before = root.copy()
        np.minimum.at(root, ri, low)
        np.minimum.at(root, rj, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def tree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of pairs that connect exactly what the pairs (a, b) connect, without a circle; earlier pairs are preferred."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    at = np.arange(len(a))
    root = np.arange(len(nodes))
    kept = []
    while True:
        ri, rj = root[i[at]], root[j[at]]
        open_ = ri != rj
        at, ri, rj = at[open_], ri[open_], rj[open_]
        if not len(at):
            return np.sort(np.concatenate(kept)) if kept else at
        first = np.full(len(nodes), len(a))
        np.minimum.at(first, ri, at)
        np.minimum.at(first, rj, at)
        took = np.unique(first[first < len(a)])  # each group's first pair outwards
        kept.append(took)
        node, low = forest(root[i[took]], root[j[took]])
        to = np.arange(len(nodes))
        to[node] = low
        root = to[root]


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
    return tuple(r)


def components(links: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """node, root for every node that has a link to another; root is the least node of its component.

    Links of a node to itself and links with a null end count for nothing; repeats and either direction are the same.
    Every round's links are written to the shared folder. A hub's rows are split by adaptive skew joins; the
    minimum per node is combined before the shuffle.
    """
    e = links.select(F.least(u, v).alias("v"), F.greatest(u, v).alias("u")).filter("u is not null and v is not null and u != v").distinct()
    e = common.cut(e.select("u", "v"), "links")
    mark = _mark(e)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        nxt = common.cut(small.select("x.u", "x.v").filter("u != v").distinct(), "links")
        new = _mark(nxt)
        common.drop(e)
        e = nxt
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
