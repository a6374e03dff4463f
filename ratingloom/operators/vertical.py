"""Counting itemsets on bitmaps of baskets.

Baskets are numbered and cut into ranges of consecutive numbers.  In each range an
item is a bitmap of the baskets that hold it, or their numbers where they are few.  A
candidate set is counted by intersecting the bitmaps of its items, the common
ones of many candidates once, and its counts are added up over the ranges.  Where
sets occur is never written out: a range sends one number per candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.operators.index import dense_index
from ratingloom.session import stage

#: Baskets of a range, at most (their numbers fit 16 bits), and basket cells of a range, about.
RANGE_BASKETS, RANGE_CELLS = 1 << 16, 4_000_000
#: Candidates that are sent to every range at once.
CANDIDATES = 500_000
#: Baskets of an item, as a share of the range, up to which they are kept as numbers.
SPARSE = 1 / 16


def packed(places: np.ndarray, baskets: int) -> bytes:
    """The baskets of an item, by their place in the range: numbers if they are few, else a bitmap."""
    if len(places) <= SPARSE * baskets:
        return b"n" + np.sort(places).astype("<u2").tobytes()
    bits = np.zeros(-(-baskets // 64) * 64, bool)
    bits[places] = True
    return b"b" + np.packbits(bits).tobytes()


def bitmap(blob: bytes, baskets: int) -> np.ndarray:
    """The words of an item's bitmap."""
    words = -(-baskets // 64)
    if blob[:1] == b"b":
        return np.frombuffer(blob, np.uint64, words, 1)
    bits = np.zeros(words * 64, bool)
    bits[np.frombuffer(blob, "<u2", -1, 1)] = True
    return np.packbits(bits).view(np.uint64)


def item_bitmaps(cells: DataFrame, range_baskets: int = RANGE_BASKETS, range_cells: int = RANGE_CELLS) -> DataFrame:
    """``range, baskets, item, held``: in each range of baskets the bitmap of every item.

    ``cells`` holds ``basket, item``, each pair once.  A basket counts to one range, and ranges
    are cut so that they hold about ``range_cells`` cells.
    """
    sizes = cells.groupBy("basket").agg(F.count(F.lit(1)).alias("n"))
    numbered = stage(dense_index(sizes, ["basket"], "number"), "baskets")
    whole = numbered.agg(F.count(F.lit(1)).alias("baskets"), F.coalesce(F.sum("n"), F.lit(0)).alias("cells")).first()
    each = max(64, min(range_baskets, RANGE_BASKETS, whole["baskets"] * range_cells // max(1, whole["cells"])))
    placed = cells.join(numbered.select("basket", "number"), "basket").select(
        "item", F.floor(F.col("number") / each).alias("range"), F.pmod("number", F.lit(each)).cast("int").alias("place")
    )
    # A range is one group of bounded size, so a hot item is spread over all ranges.
    def bitmaps(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("item", kind="stable")
        items, first = np.unique(block["item"].to_numpy(), return_index=True)
        parts = np.split(block["place"].to_numpy(), first[1:])
        baskets = int(block["place"].max()) + 1
        return pd.DataFrame({
            "range": block["range"].iat[0], "baskets": baskets, "item": items, "held": [packed(p, baskets) for p in parts],
        })

    return placed.groupBy("range").applyInPandas(bitmaps, "range long, baskets int, item long, held binary")


def count_sets(bitmaps: DataFrame, candidates: DataFrame, size: int, most: int = CANDIDATES) -> DataFrame:
    """``items, freq`` of the candidate sets (``items``, ascending, of ``size`` items) that occur at all.

    Candidates come to the ranges in parts of ``most``, a bounded broadcast each, in
    the order of their items, so that sets with a common front stay together.
    """
    spark = bitmaps.sparkSession
    every = stage(dense_index(candidates.select("items"), ["items"], "which"), "candidates")
    found = None
    for start in range(0, max(1, every.count()), most):
        chosen = every.filter(F.col("which").between(start, start + most - 1)).orderBy("which").toPandas()["items"]
        sets = np.array(chosen.tolist(), np.int64).reshape(-1, size)
        counting = _counting(spark.sparkContext.broadcast(sets), start)
        counts = bitmaps.groupBy("range").applyInPandas(counting, "which long, freq long")
        found = counts if found is None else found.unionByName(counts)
    return found.groupBy("which").agg(F.sum("freq").alias("freq")).join(every, "which").select("items", "freq")


def _counting(sent: Broadcast, start: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Counts the sent candidates, numbered from ``start``, in one range."""

    def counted(block: pd.DataFrame) -> pd.DataFrame:
        baskets = int(block["baskets"].iat[0])
        held = {int(i): bitmap(b, baskets) for i, b in zip(block["item"], block["held"])}
        which, counts = counted_sets(sent.value, held)
        return pd.DataFrame({"which": which + start, "freq": counts})

    return counted


def counted_sets(sets: np.ndarray, held: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which sets (sorted rows) occur in a range, and how often."""
    which: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for first, last, front in fronts(sets):
        if not all(int(x) in held for x in front):
            continue
        ends = sets[first:last, -1]
        here = np.array([int(x) in held for x in ends], bool)
        if not here.any():
            continue
        both = np.bitwise_and.reduce([held[int(x)] for x in front])
        if not both.any():
            continue
        n = np.array([np.bitwise_count(held[int(x)] & both).sum(dtype=np.int64) for x in ends[here]])
        which.append((np.flatnonzero(here) + first)[n > 0])
        counts.append(n[n > 0])
    none = np.zeros(0, np.int64)
    return np.concatenate([*which, none]), np.concatenate([*counts, none])


def fronts(sets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Where the sets with the same items but the last start and end, and these items."""
    if len(sets):
        edges = np.flatnonzero((sets[1:, :-1] != sets[:-1, :-1]).any(1)) + 1
        for a, b in zip(np.append(0, edges), np.append(edges, len(sets))):
            yield int(a), int(b), sets[a, :-1]
