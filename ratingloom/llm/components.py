"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.session import stage


def spanned(left: np.ndarray, right: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of 0 .. ``count``-1 that have links, and the smallest node each is connected with."""
    label = np.arange(count)
    while len(left):
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    linked = np.zeros(count, bool)
    linked[left] = linked[right] = True
    nodes = np.flatnonzero(linked)
    return nodes, label[nodes]


def _mark(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")
    ).first()
    return row["n"], row["mark"]


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``): the smallest node it can reach.

    Alternates two steps until nothing changes: every node's larger neighbours are
    linked to its smallest neighbour, then its smaller ones are.  The number of
    rounds grows with the logarithm of the graph's size; every round is written to
    the shared folder.  Links with a null end and links from a node to itself are
    ignored.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stage(pairs, "components")
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every link now points from a node to a smaller one.
        large = stage(large, "components")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("l")).select("l.a", "l.b").filter("a <> b").distinct()
        pairs = stage(small, "components")
        before, mark = mark, _mark(pairs)
        if mark == before:
            break
    stars = pairs.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots.join(stars.select("node"), "node", "left_anti"))
