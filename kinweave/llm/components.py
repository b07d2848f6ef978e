"""Connected components of an edge table, without gathering links anywhere.

Alternating large-star and small-star steps: every step replaces each node's
neighbours by links to the smallest of them. Edge counts never grow, a star
per component is left, and each round is cut to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import cut_at, removed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node long, component long), component the smallest node reachable.

    Self-links and repeated links change nothing; nodes without a link are absent; no edges give no rows.
    """
    edges, path = cut_at(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    sign = _sign(edges)
    if sign[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a"))
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                        F.struct(F.col("a"), F.col("m").alias("b")),
                    )
                ).alias("e")
            )
            .select("e.a", "e.b")
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        before_path = path
        edges, path = cut_at(small, "edges")
        removed(edges.sparkSession, before_path)
        before, sign = sign, _sign(edges)
        if sign == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _sign(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def roots(parents: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The root above each node; only these nodes' pointers are followed and shortened."""
    up = parents[nodes]
    while True:
        over = parents[up]
        if np.array_equal(over, up):
            break
        up = over
    parents[nodes] = up
    return up


def unite(parents: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge in place the classes of i[k] and j[k]; a class's root is its smallest index.

    Work goes with the number of links given, not with the number of nodes.
    """
    while len(i):
        a, b = roots(parents, i), roots(parents, j)
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parents, np.maximum(a, b), np.minimum(a, b))


def settle(parents: np.ndarray) -> np.ndarray:
    """The root of every node."""
    return roots(parents, np.arange(len(parents)))
