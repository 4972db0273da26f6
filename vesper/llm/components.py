"""Connected components of edges that are spread over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member's index for each of n nodes with edges a-b, by minima and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new.copy())
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: list[int] | None = None) -> DataFrame:
    """node, component (its smallest node) for all nodes of the edges.

    In each round every node points at its smallest neighbour if that is smaller, and pointers are doubled until they
    reach a node that points nowhere; edges then join these ends, and those within one vanish. A node without
    pointer has taken in all its neighbours or points at a smaller one in the next round, so that two rounds halve the
    nodes, also of a chain. Labels are kept as tables, as the size that Spark expects of a checkpoint of joins is squared in each; the driver sees one count a step, which `rounds` collects.
    """
    both = stash(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    labels = both.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    live = both
    first = True
    while live.limit(1).count():
        # v is the smaller end: the least v of an edge's larger end is its smallest neighbour if that is smaller
        root = _ends(stash(live.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("was"), F.col("v").alias("to"))), rounds)
        one, two = root.select(F.col("was").alias("w1"), F.col("to").alias("t1")), root.select(F.col("was").alias("w2"), F.col("to").alias("t2"))
        moved = live.join(one, F.col("u") == F.col("w1")).join(two, F.col("v") == F.col("w2"), "left").select("t1", F.coalesce("t2", "v").alias("v"))
        live = stash(moved.select(F.greatest("t1", "v").alias("u"), F.least("t1", "v").alias("v")).where("u <> v").distinct())
        labels = labels.join(root, F.col("component") == F.col("was"), "left").select("node", F.coalesce("to", "component").alias("component"))
        labels, first = stash(labels), False
    return labels if not first else stash(labels)


def _ends(pointers: DataFrame, rounds: list[int] | None) -> DataFrame:
    """was, to: where pointers (to smaller nodes) lead in the end, by doubling."""
    while True:
        further = pointers.select(F.col("was").alias("at"), F.col("to").alias("next"))
        doubled = stash(pointers.join(further, F.col("to") == F.col("at"), "left").select("was", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        moved = doubled.where("moved").limit(1).count()
        pointers = doubled.select("was", "to")
        if rounds is not None:
            rounds.append(moved)
        if not moved:
            return pointers
