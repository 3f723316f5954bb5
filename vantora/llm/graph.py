"""Connected components of a distributed edge list, labelled by their smallest node."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels after tying a[i] to b[i]: each label is the smallest index of its component."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def _turn(edges: DataFrame, large: bool) -> DataFrame:
    """One star contraction: neighbours above (or not above) a node are tied to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    mins = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = both.join(mins, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(mins.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node of its component.

    Alternating large and small stars, so the number of rounds is logarithmic; self-loops and repeated edges
    are ignored, nodes without another are absent. Each round is written to the shared folder.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    for _ in range(max_rounds):
        mark = now.agg(state.alias("s")).first().s
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark
        now = cut(_turn(_turn(now, True), False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
