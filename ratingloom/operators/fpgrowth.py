"""Parallel FP-growth: Spark's own, and one over weighted baskets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.basket import require_unique, unique_items
from ratingloom.session import shuffle_partitions, stage

#: Items of all baskets of a group that one task mines.
GROUP_CELLS = 500_000


def fp_itemsets(
    baskets: DataFrame,
    min_support: float = 0.3,
    min_count: int | None = None,
    partitions: int | None = None,
    duplicates: str = "drop",
) -> DataFrame:
    """Frequent itemsets of array baskets: ``items`` (sorted), ``size``, ``freq``.

    The threshold is ``ceil(min_support * baskets)``, or ``min_count`` baskets
    where that is given.
    """
    rule = {"drop": unique_items, "error": require_unique}[duplicates]
    ready = baskets.select(rule(F.col("items")).alias("items"))
    if min_count is not None:
        # Half a basket below the count, so that the ceiling gives exactly it.
        min_support = max(0.0, (min_count - 0.5) / max(ready.count(), 1))
    miner = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support))
    miner.setNumPartitions(partitions or shuffle_partitions(ready.sparkSession))
    found = miner.fit(ready).freqItemsets
    return found.select(
        F.array_sort("items").alias("items"),
        F.size("items").cast("long").alias("size"),
        F.col("freq").cast("long").alias("freq"),
    )


def weighted_fp(baskets: DataFrame, min_count: int, group_cells: int = GROUP_CELLS) -> DataFrame:
    """Frequent itemsets of weighted baskets: ``items`` (sorted), ``size``, ``freq``.

    ``baskets`` has ``items``, an array of each item's number in the order of falling
    frequency, ascending, and ``weight``.  Numbers are dealt to groups; a basket goes to
    each of its groups once, cut behind the group's last item, and equal ones there
    become one with their weight added up.  A group then holds all it takes to
    find the itemsets that end with one of its items, by a weighted prefix tree of
    its own.  A group with more than ``group_cells`` cells does not go to one task: Spark
    counts what its baskets end with, and each frequent ending is a smaller group of
    the baskets in front of it.
    """
    rows = baskets.select(
        F.array().cast("array<long>").alias("ending"), F.lit(None).cast("long").alias("part"),
        F.col("items").cast("array<long>").alias("front"), F.col("weight").cast("long").alias("weight"),
    )
    rows = stage(_added_up(rows.filter(F.size("front") > 0)), "fp-baskets")
    size = rows.agg(F.sum(F.size("front")).alias("cells"), F.max(F.array_max("front")).alias("last")).first()
    groups = max(1, min(-(-2 * (size["cells"] or 0) // group_cells), 1 + (size["last"] or 0)))
    rows = stage(_dealt(rows, groups), "fp-groups")
    found = []
    while True:
        sizes = stage(rows.groupBy("ending", "part").agg(F.sum(F.size("front")).alias("cells")), "fp-sizes")
        large = sizes.filter(F.col("cells") > group_cells)
        same = [rows[c].eqNullSafe(large[c]) for c in ("ending", "part")]
        small = rows.join(large, same, "left_anti")
        held = sizes.filter(F.col("cells") <= group_cells).agg(F.coalesce(F.sum("cells"), F.lit(0))).first()[0]
        found.append(stage(_mined(small, min_count, groups, max(1, held // group_cells)), "fp-found"))
        if large.isEmpty():
            break
        spread = rows.join(large, same, "left_semi").select("ending", "part", "front", "weight", F.posexplode("front"))
        spread = spread.filter(F.col("part").isNull() | (F.pmod("col", F.lit(groups)) == F.col("part")))
        grown = stage(_added_up(spread.select(
            F.concat(F.array("col"), "ending").alias("ending"), F.lit(None).cast("long").alias("part"),
            F.slice("front", F.lit(1), F.col("pos")).alias("front"), "weight",
        )), "fp-grown")
        counts = grown.groupBy("ending").agg(F.sum("weight").alias("freq")).filter(F.col("freq") >= min_count)
        counts = stage(counts, "fp-counts")
        found.append(counts.select(F.col("ending").alias("items"), "freq"))
        rows = stage(grown.filter(F.size("front") > 0).join(counts, "ending", "left_semi"), "fp-groups")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(F.array_sort("items").alias("items"), F.size("items").cast("long").alias("size"), "freq")


def _added_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ending", "part", "front").agg(F.sum("weight").alias("weight"))


def _dealt(rows: DataFrame, groups: int) -> DataFrame:
    """Each basket once for every group it has items of, up to the last of them."""
    parts = F.transform("front", lambda x: F.pmod(x, F.lit(groups)))
    dealt = rows.drop("part").withColumn("parts", parts).withColumn("part", F.explode(F.array_distinct("parts")))
    last = F.size("parts") - F.array_position(F.reverse("parts"), F.col("part")) + 1
    return _added_up(dealt.withColumn("front", F.slice("front", F.lit(1), last.cast("int"))))


def _mined(rows: DataFrame, min_count: int, groups: int, bins: int) -> DataFrame:
    """Mine each group in one task, several small groups together: ``items``, ``freq``."""

    def mine(block: pd.DataFrame) -> pd.DataFrame:
        held: dict[tuple, list] = {}
        for ending, part, front, weight in zip(block["ending"], block["part"], block["front"], block["weight"]):
            key = tuple(ending), None if pd.isna(part) else int(part)
            held.setdefault(key, []).append((front.tolist(), int(weight)))
        items, freqs = [], []
        for (ending, part), baskets in held.items():
            for found, freq in grown_patterns(baskets, min_count, None if part is None else lambda x, p=part: x % groups == p):
                items.append([*found, *ending])
                freqs.append(freq)
        return pd.DataFrame({"items": pd.Series(items, dtype=object), "freq": pd.Series(freqs, dtype="int64")})

    bin_ = F.pmod(F.xxhash64("ending", "part"), F.lit(bins)).alias("bin")
    return rows.select(bin_, "ending", "part", "front", "weight").groupBy("bin").applyInPandas(mine, "items array<long>, freq long")


def grown_patterns(
    baskets: list[tuple[list[int], int]], least: int, ends: Callable[[int], bool] | None = None
) -> Iterator[tuple[tuple[int, ...], int]]:
    """All itemsets of at least ``least`` weight, with it, from a weighted prefix tree.

    ``baskets`` are ascending; with ``ends`` only itemsets whose last item it accepts are given.
    """
    counts: Counter = Counter()
    for items, weight in baskets:
        for x in items:
            counts[x] += weight
    # The tree as rows: item, row of the parent, weight.
    item, parent, held = [-1], [-1], [0]
    child: dict[tuple[int, int], int] = {}
    nodes: dict[int, list[int]] = {}
    for items, weight in baskets:
        at = 0
        for x in items:
            if counts[x] < least:
                continue
            down = child.get((at, x))
            if down is None:
                down = child[at, x] = len(item)
                item.append(x)
                parent.append(at)
                held.append(0)
                nodes.setdefault(x, []).append(down)
            held[down] += weight
            at = down
    for x, places in nodes.items():
        if ends is not None and not ends(x):
            continue
        yield (x,), counts[x]
        fronts = []
        for at in places:
            weight, front = held[at], []
            while (at := parent[at]) > 0:
                front.append(item[at])
            if front:
                fronts.append((front[::-1], weight))
        for found, freq in grown_patterns(fronts, least):
            yield (*found, x), freq
