"""Best lists of a factor model without scoring every pair.

Items are ordered by the length of their vectors and cut into blocks.  By
Cauchy-Schwarz a block's best score for a user is at most the user's length times
the block's greatest, and at most the score of the block's middle plus the
user's length times the block's radius.  A user goes down the blocks, longest
first, and a block that cannot reach the user's n-th score so far is not multiplied.

Users stay where they are and items come to them, in chunks of a bounded size with the
longest items first.  Between chunks a user carries the list it has; one whose
n-th score no later item can reach is done and not read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.numeric import dot, stable_round_array
from ratingloom.operators.grid import best_unrated
from ratingloom.operators.index import dense_index
from ratingloom.operators.rank import TOP
from ratingloom.session import stage

#: Items of one block, and bytes of the item vectors that are sent to every worker at once.
BLOCK_ITEMS, CHUNK_BYTES = 256, 32 << 20
USERS_AT_ONCE = 512
# Scores this much lower can still round to the same digits and come first by item.
_TIES = 2e-6
_LISTS = "user long, above double, above_f array<double>, below double, below_f array<double>, known array<long>, items array<long>, scores array<double>, met long, open boolean"


@dataclass
class Blocks:
    """A chunk of items in blocks: ids, vectors, and what bounds a block's scores."""

    ids: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray
    longest: np.ndarray
    middles: np.ndarray
    radii: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, vectors: np.ndarray, size: int) -> Blocks:
        """Blocks of items that come longest first; within a few blocks of like length they are put by direction."""
        group = np.arange(len(ids)) // (16 * size)
        leading = np.zeros(len(ids))
        for g in range(int(group.max(initial=-1)) + 1):
            own = group == g
            centred = vectors[own] - vectors[own].mean(0)
            _, _, axes = np.linalg.svd(centred.T @ centred)
            leading[own] = centred @ axes[0] if len(axes) else 0.0
        order = np.lexsort((ids, leading, group))
        ids, vectors = ids[order], vectors[order]
        starts = np.arange(0, len(ids), size)
        sizes = np.diff(np.append(starts, len(ids)))
        middles = np.add.reduceat(vectors, starts, axis=0) / sizes[:, None]
        off = np.linalg.norm(vectors - np.repeat(middles, sizes, axis=0), axis=1)
        lengths = np.linalg.norm(vectors, axis=1)
        room = 1 + 1e-9
        return Blocks(ids, vectors, starts, np.maximum.reduceat(lengths, starts) * room, middles, np.maximum.reduceat(off, starts) * room)

    def span(self, block: int) -> slice:
        """Where a block's items stand."""
        return slice(self.starts[block], self.starts[block + 1] if block + 1 < len(self.starts) else len(self.ids))


def highest(users: np.ndarray, longest: np.ndarray, middles: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """At most so much is the product of each user's vector with an item of each block."""
    lengths = np.linalg.norm(users, axis=1)[:, None]
    return np.minimum(lengths * longest, users @ middles.T + lengths * radii)


def ratio_bound(above: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest quotient of a numerator up to ``above`` and a denominator from ``low`` to ``high``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(low <= 0, np.inf, np.where(above >= 0, above / low, above / high))


class Lists:
    """The best items of some users so far: rounded score first, smaller item on ties."""

    def __init__(self, items: list[np.ndarray], scores: list[np.ndarray], n: int) -> None:
        self.n = n
        self.items = np.full((len(items), n), np.iinfo(np.int64).max)
        self.scores = np.full((len(items), n), -np.inf)
        for k, (i, s) in enumerate(zip(items, scores)):
            self.items[k, : len(i)], self.scores[k, : len(s)] = i, s

    def floor(self) -> np.ndarray:
        """What a score must reach to be listed."""
        return self.scores[:, -1] - _TIES

    def add(self, users: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        """Offer every one of ``items`` to each of the users; scores that are no number are not offered."""
        scores = np.where(np.isnan(scores), -np.inf, scores)
        every = np.concatenate((self.scores[users], scores), axis=1)
        names = np.concatenate((self.items[users], np.broadcast_to(items, scores.shape)), axis=1)
        names = np.where(np.isneginf(every), np.iinfo(np.int64).max, names)
        order = np.lexsort((names, -stable_round_array(every)), axis=1)[:, : self.n]
        self.items[users] = np.take_along_axis(names, order, axis=1)
        self.scores[users] = np.take_along_axis(every, order, axis=1)


def search(people: pd.DataFrame, blocks: Blocks, n: int, later: float) -> pd.DataFrame:
    """Take a chunk of items into the lists of some users; ``later`` is the greatest length of any later item."""
    above_f = np.vstack(people["above_f"].to_numpy()).astype(float)
    above, below = (people[c].to_numpy(float)[:, None] for c in ("above", "below"))
    both = people["below_f"].iat[0] is not None
    below_f = np.vstack(people["below_f"].to_numpy()).astype(float) if both else None
    lists = Lists(list(people["items"]), list(people["scores"]), n)
    shape = blocks.longest, blocks.middles, blocks.radii
    bound = above + highest(above_f, *shape)
    low, high = (below - highest(-below_f, *shape), below + highest(below_f, *shape)) if both else (below, below)
    bound = ratio_bound(bound, np.broadcast_to(low, bound.shape), np.broadcast_to(high, bound.shape))
    # Where each user's known items stand in the chunk.
    by_id = np.argsort(blocks.ids)
    known = np.concatenate([np.asarray(k, np.int64) for k in people["known"]])
    owner = np.repeat(np.arange(len(people)), [len(k) for k in people["known"]])
    at = by_id[np.minimum(np.searchsorted(blocks.ids[by_id], known), len(by_id) - 1)]
    here = blocks.ids[at] == known
    owner, at = owner[here], at[here]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    met = people["met"].to_numpy(np.int64).copy()
    for block in range(len(blocks.starts)):
        some = np.flatnonzero(bound[:, block] >= lists.floor())
        if not len(some):
            continue
        span = blocks.span(block)
        scores = above[some] + above_f[some] @ blocks.vectors[span].T
        under = below[some] + (below_f[some] @ blocks.vectors[span].T if both else 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = np.where(under == 0.0, np.nan, scores / under)
        first, last = np.searchsorted(at, (span.start, span.stop))
        row = np.full(len(people), -1)
        row[some] = np.arange(len(some))
        r, c = row[owner[first:last]], at[first:last] - span.start
        scores[r[r >= 0], c[r >= 0]] = np.nan
        lists.add(some, blocks.ids[span], scores)
        met[some] += span.stop - span.start
    rest = above[:, 0] + np.linalg.norm(above_f, axis=1) * later
    under = np.linalg.norm(below_f, axis=1) * later if both else 0.0
    open_ = ratio_bound(rest, below[:, 0] - under, below[:, 0] + under) >= lists.floor()
    found = [~np.isneginf(s) for s in lists.scores]
    return people.assign(
        items=[i[f] for i, f in zip(lists.items, found)], scores=[s[f] for s, f in zip(lists.scores, found)],
        met=met, open=open_ if later > 0 else False,
    )


def best_lists(
    users: DataFrame, items: DataFrame, known: DataFrame, n: int = TOP,
    block_items: int = BLOCK_ITEMS, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``user, items, scores, met``: every user's list, and with how many items it was scored.

    The arguments are those of :func:`ratingloom.operators.grid.best_unrated`.
    """
    length = F.sqrt(dot(F.col("f"), F.col("f")))
    things = stage(items.select("item", "f", length.alias("length")), "items")
    size = things.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("f")), F.lit(1)).alias("width")).first()
    each = max(block_items, chunk_bytes // (8 * max(1, size["width"]) + 8))
    chunks = max(1, -(-size["n"] // each))
    things = stage(dense_index(things, [F.col("length").desc(), "item"], "place"), "items") if chunks > 1 else things.withColumn("place", F.lit(0))
    lengths = {r["chunk"]: r["most"] for r in things.groupBy(F.floor(F.col("place") / each).alias("chunk")).agg(F.max("length").alias("most")).collect()}
    taken = known.groupBy("user").agg(F.collect_set(F.col("item").cast("long")).alias("known"))
    none = F.array()
    state = users.join(taken, "user", "left").select(
        "user", "above", "above_f", "below", "below_f", F.coalesce("known", none.cast("array<long>")).alias("known"),
        none.cast("array<long>").alias("items"), none.cast("array<double>").alias("scores"), F.lit(0).cast("long").alias("met"),
        F.lit(True).alias("open"),
    )
    done = None
    for chunk in range(chunks):
        # At most ``chunk_bytes`` of numbers.
        held = things.filter(F.col("place").between(chunk * each, (chunk + 1) * each - 1)).orderBy(F.col("length").desc(), "item").toPandas()
        if held.empty:
            break
        blocks = Blocks.of(held["item"].to_numpy(np.int64), np.vstack(held["f"].to_numpy()).astype(float), block_items)
        sent = users.sparkSession.sparkContext.broadcast(blocks)
        later = max((m for c, m in lengths.items() if c > chunk), default=0.0)

        def searched(frames: Iterator[pd.DataFrame], sent=sent, later=later) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for start in range(0, len(frame), USERS_AT_ONCE):
                    yield search(frame.iloc[start : start + USERS_AT_ONCE], sent.value, n, later)

        state = state.mapInPandas(searched, _LISTS)
        if chunks > 1:
            state = stage(state, "lists")
            ended = state.filter("not open")
            done = ended if done is None else done.unionByName(ended)
            state = state.filter("open")
    found = state if done is None else done.unionByName(state)
    return found.select("user", "items", "scores", "met")


def best_items(users: DataFrame, items: DataFrame, known: DataFrame, n: int = TOP) -> DataFrame:
    """The ``n`` best items that a user does not know, by whichever way is cheaper; both give the same rows.

    With one block of items there is nothing to skip.
    """
    if items.count() <= BLOCK_ITEMS:
        return best_unrated(users, items, known, n)
    return best_by_bound(users, items, known, n)


def best_by_bound(users: DataFrame, items: DataFrame, known: DataFrame, n: int = TOP, **sizes) -> DataFrame:
    """The ``n`` best items that a user does not know: ``user, rank, item, score``.

    The rows of :func:`ratingloom.operators.grid.best_unrated`, blocks that cannot win left out.
    """
    lists = best_lists(users, items, known, n, **sizes)
    each = lists.select("user", F.posexplode(F.arrays_zip("items", "scores")).alias("pos", "one"))
    return each.select(
        "user", (F.col("pos") + 1).cast("long").alias("rank"), F.col("one.items").alias("item"), F.col("one.scores").alias("score")
    )
