"""Scores for whole blocks of users and items.

For results that are as large as users times items.  Users and items are hashed
into blocks, every block of users meets every block of items under an equi-join
key, and no block holds more than a bounded number of either.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.numeric import stable_round_array
from ratingloom.operators.rank import TOP, top_items

USERS_PER_BLOCK = 8192
ITEMS_PER_BLOCK = 4096

_BEST = "user long, item long, score double"


def _block_count(table: DataFrame, size: int, floor: int = 1) -> int:
    return max(floor, -(-table.count() // size))


def _spread(table: DataFrame, key: str, blocks: int, other: int, mine: str, theirs: str) -> DataFrame:
    """Copy each row to the grid squares of its block."""
    return table.withColumn(
        mine, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    ).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))


def _grid_shape(
    users: DataFrame, items: DataFrame, users_per_block: int, items_per_block: int
) -> tuple[int, int]:
    item_blocks = _block_count(items, items_per_block)
    cores = users.sparkSession.sparkContext.defaultParallelism
    return _block_count(users, users_per_block, floor=max(1, cores // item_blocks)), item_blocks


def grid_pairs(
    users: DataFrame,
    items: DataFrame,
    users_per_block: int = USERS_PER_BLOCK,
    items_per_block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """Every row of ``users`` with every row of ``items``."""
    ub, ib = _grid_shape(users, items, users_per_block, items_per_block)
    left = _spread(users, "user", ub, ib, "_ub", "_ib")
    right = _spread(items, "item", ib, ub, "_ib", "_ub")
    return left.join(right, ["_ub", "_ib"]).drop("_ub", "_ib")


def best_unrated(
    users: DataFrame,
    items: DataFrame,
    known: DataFrame,
    n: int = TOP,
    users_per_block: int = USERS_PER_BLOCK,
    items_per_block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """The ``n`` best items that a user does not know: ``user, rank, item, score``.

    ``users`` has ``user, above, above_f, below, below_f`` and ``items`` has
    ``item, f``; the score is ``(above + above_f . f) / (below + below_f . f)``.
    A null ``below_f`` means a constant denominator.  Each block of scores is one
    matrix product and keeps only its best ``n`` per user, so what is shuffled
    afterwards is ``n`` rows per user and block of items.  The known items of a
    user are cut into the same blocks.
    """
    ub, ib = _grid_shape(users, items, users_per_block, items_per_block)
    right = _spread(items, "item", ib, ub, "_ib", "_ub").select("_ub", "_ib", "item", "f")
    taken = (
        known.withColumn("_ib", F.pmod(F.xxhash64("item"), F.lit(ib)).cast("int"))
        .groupBy("user", "_ib")
        .agg(F.collect_set("item").alias("known"))
    )
    left = _spread(users, "user", ub, ib, "_ub", "_ib").join(taken, ["user", "_ib"], "left").select(
        "_ub", "_ib", "user", "above", "above_f", "below", "below_f", "known"
    )

    def score(people: pd.DataFrame, things: pd.DataFrame) -> pd.DataFrame:
        return _score_block(people, things, n)

    best = (
        left.groupBy("_ub", "_ib")
        .cogroup(right.groupBy("_ub", "_ib"))
        .applyInPandas(score, _BEST)
    )
    return top_items(best, n)


def _score_block(people: pd.DataFrame, things: pd.DataFrame, n: int) -> pd.DataFrame:
    if people.empty or things.empty:
        return pd.DataFrame({"user": [], "item": [], "score": []}).astype(
            {"user": "int64", "item": "int64", "score": "float64"}
        )
    things = things.sort_values("item")
    item_ids = things["item"].to_numpy(dtype=np.int64)
    factors = np.vstack(things["f"].to_numpy()).astype(float).T
    parts = []
    for start in range(0, len(people), 512):
        some = people.iloc[start:start + 512]
        scores = some["above"].to_numpy(dtype=float)[:, None] + np.vstack(some["above_f"].to_numpy()) @ factors
        below = some["below"].to_numpy(dtype=float)[:, None]
        if some["below_f"].iat[0] is not None:
            below = below + np.vstack(some["below_f"].to_numpy()) @ factors
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = np.where(below == 0.0, np.nan, scores / below)
        lists = [np.asarray(known if known is not None else [], dtype=np.int64) for known in some["known"]]
        known = np.concatenate(lists)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at = np.minimum(np.searchsorted(item_ids, known), len(item_ids) - 1)
        met = item_ids[at] == known
        scores[owner[met], at[met]] = np.nan
        # Items ascend within the block, so a stable sort breaks ties by item.
        order = np.argsort(-stable_round_array(scores), axis=1, kind="stable")[:, :n]
        best = np.take_along_axis(scores, order, axis=1)
        kept = ~np.isnan(best)
        parts.append(pd.DataFrame({
            "user": np.repeat(some["user"].to_numpy(dtype=np.int64), kept.sum(axis=1)),
            "item": item_ids[order][kept],
            "score": best[kept],
        }))
    return pd.concat(parts, ignore_index=True)
