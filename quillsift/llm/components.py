"""Connected components over a table of links, by alternating star contraction.

Large-star links every larger neighbour of a node to the smallest node around
it, small-star does the same with the smaller neighbours; the two alternate
until every component is a star around its smallest node (Kiveris et al.,
"Connected Components in MapReduce and Beyond", 2014).  Once few links are left,
one task ends it, so that few links don't cost the stages of all rounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.shared import frozen, meet

#: Distinct links up to which one task finds the components (16 bytes each).
FEW = 200_000


def stars(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links ``u, v`` of all batches, held at once, as links of each node to the smallest one of its component."""
    links = np.concatenate([np.empty((0, 2), np.int64), *(batch[["u", "v"]].to_numpy(np.int64) for batch in batches)])
    nodes, at = np.unique(links, return_inverse=True)
    u, v = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while len(u):
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]
        u, v = label[u], label[v]
        apart = u != v
        u, v = u[apart], v[apart]
    other = np.flatnonzero(label != np.arange(len(label)))
    yield pd.DataFrame({"u": nodes[other], "v": nodes[label[other]]})


def _to_smallest(around: DataFrame, count: int) -> DataFrame:
    """``around`` (``count`` rows) with ``m``, the smallest ``v`` of each ``u``; the neighbours of a very large star stay where they are."""
    smallest = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    return meet(around, frozen(smallest), ["u"], "degree", count, 0)


def _star(links: DataFrame, large: bool, count: int) -> DataFrame:
    """One contraction of links with u > v, ``count`` of them at most; there aren't more afterwards."""
    if large:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved = _to_smallest(around, 2 * count).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        near = _to_smallest(links, count)
        moved = near.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u != v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``u, v``: root is the smallest node of its component.

    Nodes without links have no row; nulls and self-links are ignored.
    """
    now = frozen(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == state:
            break
        if seen[0] <= FEW:
            now = frozen(now.coalesce(1).mapInPandas(stars, "u bigint, v bigint"))
            break
        state = tuple(seen)
        now = frozen(_star(frozen(_star(now, True, seen[0])), False, seen[0]))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
