"""Connected components for near-duplicate operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationmine.scale import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) for all nodes of ``edges`` (a long, b long).

    Each round links the neighbours of every node to the least of them, first the larger
    neighbours, then the smaller ones. Both steps are grouped minima joined back to the edges, so no
    neighbour list is gathered and a hub's rows can be split. It ends when the stars stand still.
    """
    links = cut(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct()
    )
    before = (-1, None)
    while True:
        both = links.union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # larger neighbours of v go to the least node around v
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.filter("u < v").distinct()
        # smaller neighbours of v, and v itself, go to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low)
        links = cut(small.filter("u < v").distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    found = links.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return found.union(links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def forest(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Edges that connect what the links (left[a[i]], right[b[i]]) connect: one per vector at most.

    The least row number spreads along the links until it stands still; each vector is tied to the
    left vector whose number it got.
    """
    by_b = np.argsort(b, kind="stable")  # links come sorted by a
    heads = [np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) for x in (a, b[by_b])]
    seen_a, seen_b = a[heads[0]], b[by_b][heads[1]]
    name_a, name_b = np.arange(len(left)), np.zeros(len(right), np.int64)
    while True:
        name_b[seen_b] = np.minimum.reduceat(name_a[a[by_b]], heads[1])
        new = np.minimum.reduceat(name_b[b], heads[0])
        if (new == name_a[seen_a]).all():
            break
        name_a[seen_a] = new
    return np.concatenate(
        [np.c_[left[name_a[seen_a]], left[seen_a]], np.c_[left[name_b[seen_b]], right[seen_b]]]
    )
