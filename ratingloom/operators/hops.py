"""Item-based lists straight from the ratings, without a table of cosines.

The cosine of items i and j is the sum over users v of ``x(v,i) x(v,j)``, with x the rating
divided by its item's norm.  So what a user's rated items i add to the score of j is

    sum over i of r(u,i) c(i,j) = sum over v of p(u,v) x(v,j),  p(u,v) = sum over i of r(u,i) x(v,i)

and the same without r for the denominator.  These are the products that the cosines are
made of, in another order: two hops, from a user over the items to those who rated them, and
from these to their items.  Where rows and columns are short the hops are as many as the
products with the table would be, but ratings are far fewer than pairs of items.

Users stay in blocks and the ratings pass by in pieces of whole items, read by each block
from where they are stored: once for the first hop and once for the second, or once where
there is a single piece.  So neither cosines nor copies of the ratings are stored or
shuffled, a task holds one block's first hops and one piece, and only lists leave it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.numeric import stable_round_array
from ratingloom.operators.gram import squared_norms
from ratingloom.operators.index import dense_index
from ratingloom.operators.passing import (
    FRAMES, HELD, Coded, Frames, coded, frames, held_row, numbers, past_held, squeezed, tidied,
)
from ratingloom.operators.rank import TOP
from ratingloom.session import stage

#: Ratings of one piece, and first hops (20 bytes each) of one block of users: a task's arrays stay below
#: 300 MB, counting a second copy of the hops, and 60 bytes a rating while it is unpacked and looked up.
CELLS_PER_PIECE, HOPS_PER_BLOCK = 1_500_000, 4_000_000
_PRODUCTS_AT_ONCE = 1_000_000
#: Scores this much lower can still round to the same digits and come first by item.
_TIES = 2e-6
_BOTH, _FIRST, _SECOND = 0, 1, 2

_LISTS = "user long, rank long, item long, score double"


@dataclass(frozen=True)
class Hops:
    """How much work both ways are: ``joined`` products with the table, at most, and ``products`` by two hops."""

    cells: int
    users: int
    first: float
    products: float
    joined: float


def measure_hops(cells: DataFrame) -> Hops:
    """Count the hops of stored ``user, item`` cells."""
    own = cells.groupBy("user").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    items = cells.join(own, "user").filter("item is not null").groupBy("item").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_n").alias("hops")
    )
    width = items.agg(F.count(F.lit(1)).cast("double").alias("width"))
    size = items.crossJoin(F.broadcast(width)).agg(
        F.sum("n").cast("long").alias("cells"), F.sum(F.col("n") * F.col("n")).alias("first"),
        F.sum(F.col("n") * F.col("hops")).alias("products"), F.sum(F.col("n") * F.least("hops", "width")).alias("joined"),
    ).first()
    return Hops(size["cells"] or 0, own.filter("user is not null").count(), *(size[c] or 0.0 for c in ("first", "products", "joined")))


def best_by_hops(
    cells: DataFrame, hops: Hops, n: int = TOP,
    cells_per_piece: int = CELLS_PER_PIECE, hops_per_block: int = HOPS_PER_BLOCK,
) -> DataFrame:
    """The ``n`` best unrated items of every user: ``user, rank, item, score``.

    ``cells``: user, item, rating, stored, each pair once.  As in blocks, a user with an item
    whose rating is missing gets no list.
    """
    pieces = max(1, -(-hops.cells // cells_per_piece))
    stored = _pieces(cells, pieces)
    turns = [_BOTH] if pieces == 1 else [_FIRST, _SECOND]
    passing = None
    for turn in turns:
        one = stored.withColumn("turn", F.lit(turn))
        passing = one if passing is None else passing.union(one)
    cores = cells.sparkSession.sparkContext.defaultParallelism
    blocks = cores * max(1, int(-(-hops.first // (hops_per_block * cores))))
    # A task reads piece after piece; each block of users is a task and keeps what it holds.
    met = past_held(passing, _user_blocks(cells, blocks))
    width = hops.users

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        people: People | None = None
        early: list[tuple[int, list[bytes]]] = []
        held, slices = Frames("h_"), {turn: Frames() for turn in turns}
        for batch in batches:
            own, turn = (batch.column(name).fill_null(-1).to_numpy() for name in ("own", "turn"))
            kind = np.where(own == 1, -1, turn)
            for begin, end in itertools.pairwise([0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]):
                some = batch.slice(begin, end - begin)
                if end > begin and kind[begin] == -1:
                    for blobs in held.whole(some):
                        people = People.of(blobs, n)
                    continue
                for blobs in slices[int(kind[begin])].whole(some) if end > begin else ():
                    if people is None:
                        early.append((int(kind[begin]), [bytes(blob) for blob in blobs]))
                        continue
                    while early:
                        people.pass_by(early[0][0], Piece.of(early.pop(0)[1], width))
                    people.pass_by(int(kind[begin]), Piece.of(blobs, width))
        if people is not None:
            for turn, blobs in early:
                people.pass_by(turn, Piece.of(blobs, width))
            yield from people.lists()

    return met.mapInArrow(tidied(listed), _LISTS)


def _pieces(cells: DataFrame, pieces: int) -> DataFrame:
    """Whole items with their ratings, by number of user."""
    known = cells.filter("user is not null and item is not null")
    number = dense_index(known.select("user").distinct(), ["user"], "v")
    norms = squared_norms(cells, "item", "rating").select(F.col("i").alias("item"), F.sqrt("dot").alias("norm"))
    placed = (
        known.join(number, "user").join(norms, "item")
        .select(
            F.pmod(F.xxhash64(F.col("item").cast("long")), F.lit(pieces)).cast("int").alias("piece"), F.col("item").cast("long").alias("item"),
            "v", F.coalesce(F.col("rating").cast("double"), F.lit(0.0)).alias("x"), F.coalesce("norm", F.lit(0.0)).alias("norm"),
        )
        .repartitionById(pieces, "piece").sortWithinPartitions("v", "item")
    )
    return stage(placed.mapInArrow(_packed_piece, FRAMES), "pieces")


def _packed_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b.drop_columns(["piece"]) for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    item, v, x, norm = (table.column(c).to_numpy() for c in ("item", "v", "x", "norm"))
    items, first, col = np.unique(item, return_index=True, return_inverse=True)
    bits = np.ascontiguousarray(x).view("<i8")
    yield from frames([(
        squeezed(items), squeezed(norm[first]), squeezed(col.astype("<i4")), squeezed(v.astype("<i4")), *coded(bits),
    )])


def _user_blocks(cells: DataFrame, blocks: int) -> DataFrame:
    """Users with their ratings and own terms, a row and a partition for each block."""
    placed = (
        cells.filter("user is not null")
        .select(
            F.pmod(F.xxhash64(F.col("user").cast("long")), F.lit(blocks)).cast("int").alias("block"),
            F.col("user").cast("long").alias("user"), F.coalesce(F.col("item").cast("long"), F.lit(0)).alias("item"),
            F.col("item").isNotNull().alias("named"), F.coalesce(F.col("rating").cast("double"), F.lit(0.0)).alias("r"),
            F.col("rating").isNotNull().alias("known"),
        )
        .repartitionById(blocks, "block").sortWithinPartitions("user", "item")
    )
    return placed.mapInArrow(_packed_users, HELD)


def _packed_users(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    user, item, r = (table.column(c).to_numpy() for c in ("user", "item", "r"))
    named, known = (table.column(c).to_numpy().astype(float) for c in ("named", "known"))
    users, at, below = np.unique(user, return_inverse=True, return_counts=True)
    # Nobody without a rating has a mean, and an item without one leaves a user's sums unknown.
    unknown = (np.bincount(at, known) == 0) | (np.bincount(at, named * (1 - known)) > 0)
    above = np.where(unknown, np.nan, np.bincount(at, r))
    kept = named > 0
    columns = (users, above, below.astype(float), np.bincount(at, named).astype("<i8"), item[kept], r[kept])
    block = table.column("block")[0].as_py()
    yield held_row(block, 0, map(squeezed, columns))
    yield held_row(block)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def _runs(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ...``, ``length[k]`` of them, one run after the other."""
    return np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length), length)


@dataclass
class Piece:
    """Ratings of some items over their norms, ordered by the number of the user."""

    items: np.ndarray
    col: np.ndarray
    v: np.ndarray
    x: np.ndarray
    width: int

    @staticmethod
    def of(blobs: list, width: int) -> Piece:
        items, norms = numbers(blobs[0], "<i8"), numbers(blobs[1], "<f8")
        col, v = numbers(blobs[2], "<i4"), numbers(blobs[3], "<i4")
        x = Coded(*blobs[4:6])[:].view("<f8")
        norm = norms[col]
        return Piece(items, col, v, np.divide(x, norm, out=np.zeros(len(x)), where=norm != 0.0), width)

    def by_user(self) -> np.ndarray:
        """Where each user's ratings start."""
        return _starts(np.bincount(self.v, minlength=self.width))

    def by_item(self) -> tuple[np.ndarray, np.ndarray]:
        """The ratings in order of items, and where each item's start."""
        return np.argsort(self.col, kind="stable"), _starts(np.bincount(self.col, minlength=len(self.items)))


@dataclass
class People:
    """A block of users: their ratings and own terms, first hops, and the lists so far."""

    n: int
    users: np.ndarray
    above: np.ndarray
    below: np.ndarray
    starts: np.ndarray
    rated: np.ndarray
    r: np.ndarray
    found: list[tuple[np.ndarray, np.ndarray]]
    parts: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    hops: tuple[np.ndarray, ...] | None = None

    @staticmethod
    def of(blobs: list, n: int) -> People:
        users, counts, rated = (numbers(blobs[k], "<i8") for k in (0, 3, 4))
        above, below, r = (numbers(blobs[k], "<f8") for k in (1, 2, 5))
        none = np.empty(0, np.int64), np.empty(0)
        return People(n, users, above, below, _starts(counts), rated, r, [none] * len(users))

    def pass_by(self, turn: int, piece: Piece) -> None:
        if turn != _SECOND:
            self.hop(piece)
        if turn != _FIRST:
            self.score(piece)

    def hop(self, piece: Piece) -> None:
        """From the rated items of a piece to all who rated them."""
        if self.hops is not None:
            raise RuntimeError("a piece came again before all had come once")
        order, start = piece.by_item()
        at = np.minimum(np.searchsorted(piece.items, self.rated), len(piece.items) - 1)
        cell = np.flatnonzero(piece.items[at] == self.rated)
        at = at[cell]
        count = start[at + 1] - start[at]
        upto = _starts(count)
        v, above, below = np.empty(upto[-1], np.int32), np.empty(upto[-1]), np.empty(upto[-1])
        first = 0
        while first < len(cell):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + _PRODUCTS_AT_ONCE, "right")) - 1)
            here, to = order[_runs(start[at[first:last]], count[first:last])], slice(upto[first], upto[last])
            v[to], below[to] = piece.v[here], piece.x[here]
            above[to] = below[to] * np.repeat(self.r[cell[first:last]], count[first:last])
            first = last
        # How many hops each user has in this piece: cells ascend by user.
        self.parts.append((np.diff(upto[np.searchsorted(cell, self.starts)]), v, above, below))

    def joined_hops(self) -> tuple[np.ndarray, ...]:
        """All first hops, in order of users."""
        if self.hops is None:
            place = _starts(sum(counts for counts, *_ in self.parts))
            if len(self.parts) == 1:
                self.hops = place, *self.parts.pop()[1:]
            else:
                whole = np.empty(place[-1], np.int32), np.empty(place[-1]), np.empty(place[-1])
                free = place[:-1].copy()
                while self.parts:
                    counts, *some = self.parts.pop()
                    to = _runs(free, counts)
                    for target, values in zip(whole, some, strict=True):
                        target[to] = values
                    free += counts
                self.hops = place, *whole
        return self.hops

    def score(self, piece: Piece) -> None:
        """From those who share an item to the items of a piece; the best go into the lists."""
        place, v, above, below = self.joined_hops()
        start, width = piece.by_user(), len(piece.items)
        at = np.minimum(np.searchsorted(piece.items, self.rated), width - 1)
        known = piece.items[at] == self.rated
        seen, number = np.zeros(width, bool), np.empty(width, np.int64)
        for u in range(len(self.users)):
            own = slice(self.starts[u], self.starts[u + 1])
            taken = at[own][known[own]]
            some = slice(place[u], place[u + 1])
            first = start[v[some]]
            length = start[v[some] + 1] - first
            sparse = int(length.sum()) < 2 * width
            if sparse:
                col, over, under = self._products(piece, first, length, above[some], below[some])
                seen[col] = seen[taken] = True
                touched = np.flatnonzero(seen)
                number[touched] = np.arange(len(touched))
                free = self._first_free(seen)
                seen[touched] = False
                # Rated items are taken out below; those that nothing adds to follow.
                sums = [np.bincount(number[col], w, len(touched)) for w in (over, under)]
                gone = number[taken]
                cols = np.concatenate((touched, free))
                sums = [np.concatenate((s, np.zeros(len(free)))) for s in sums]
            else:
                sums = [np.zeros(width), np.zeros(width)]
                upto = _starts(length)
                begin = 0
                while begin < len(length):
                    end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + _PRODUCTS_AT_ONCE, "right")) - 1)
                    cut = slice(some.start + begin, some.start + end)
                    col, over, under = self._products(piece, first[begin:end], length[begin:end], above[cut], below[cut])
                    sums = [s + np.bincount(col, w, width) for s, w in zip(sums, (over, under), strict=True)]
                    begin = end
                gone, cols = taken, None
            under = self.below[u] + sums[1]
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = np.where(under == 0.0, np.nan, (self.above[u] + sums[0]) / under)
            scores[gone] = np.nan
            self._add(u, piece.items, cols, scores)

    def _first_free(self, seen: np.ndarray) -> np.ndarray:
        """The first ``n`` items that nothing adds to: they tie at the user's mean, so others cannot be listed."""
        reach = 4 * self.n
        while True:
            free = np.flatnonzero(~seen[:reach])[: self.n]
            if len(free) == self.n or reach >= len(seen):
                return free
            reach *= 4

    @staticmethod
    def _products(piece: Piece, first, length, above, below) -> tuple[np.ndarray, ...]:
        here = _runs(first, length)
        x = piece.x[here]
        return piece.col[here], np.repeat(above, length) * x, np.repeat(below, length) * x

    def _add(self, u: int, items: np.ndarray, cols: np.ndarray | None, scores: np.ndarray) -> None:
        """Offer a user the items at ``cols``, or all; rounded score first, smaller item on ties."""
        old_items, old_scores = self.found[u]
        # Most items tie at the mean: what is above it is looked at first, which alone fills most lists.
        floor = self.above[u] / self.below[u] + _TIES
        if len(old_items) == self.n:
            floor = max(floor, old_scores[-1] - _TIES)
        some = np.flatnonzero(scores > floor)
        least = self._least(old_scores, scores[some])
        if not least - _TIES > floor:
            some = np.flatnonzero(~np.isnan(scores))
            least = self._least(old_scores, scores[some])
        some = some[scores[some] >= least - _TIES]
        names = np.concatenate((old_items, items[some if cols is None else cols[some]]))
        values = np.concatenate((old_scores, scores[some]))
        order = np.lexsort((names, -stable_round_array(values)))[: self.n]
        self.found[u] = names[order], values[order]

    def _least(self, old: np.ndarray, new: np.ndarray) -> float:
        """The ``n``-th score of both, none lower need be looked at."""
        if len(old) + len(new) < self.n:
            return -np.inf
        both = np.concatenate((old, new))
        return np.partition(both, len(both) - self.n)[len(both) - self.n]

    def lists(self) -> Iterator[pa.RecordBatch]:
        """The lists, some users at once."""
        for at in range(0, len(self.users), 512):
            found = self.found[at : at + 512]
            length = np.array([len(items) for items, _ in found])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(self.users[at : at + 512], length)), pa.array(_runs(np.ones(len(found), np.int64), length)),
                pa.array(np.concatenate([items for items, _ in found])), pa.array(np.concatenate([scores for _, scores in found])),
            ], names=["user", "rank", "item", "score"])
