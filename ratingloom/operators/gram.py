"""Sums of products over pairs of columns that meet in a row.

One kernel serves item cosine, user cosine, pair support and the Gram matrix of
the SVD.  A row with ``n`` cells meets ``n * n / 2`` pairs, so long rows decide
the cost.  Two exact ways are used and added up:

* rows of at most ``long_row`` cells make at most ``long_row / 2`` pairs per cell,
  hence work that is linear in the data.  With few columns they are joined with
  themselves in the JVM and their sums fold before they move.  With many columns
  hardly two pairs of a task are alike: then the rows are packed and stored once.  Every column
  belongs to a block; a block reads all rows past it and makes and adds up the pairs that its
  columns begin, so neither pairs nor copies of rows are shuffled or stored;
* longer rows are cut into blocks of columns.  Blocks of many rows are multiplied
  together in numpy, so a pair leaves a block once however many of its rows
  contain it, and neither a hot row nor a hot column ever sits in one group.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.operators.passing import (
    FRAMES, HELD, NULL, Coded, Frames, bits_of, blocks_of, coded, ended, frames, numbered, numbers, past, past_held, runs,
    squeezed, tidied, whole_rows,
)
from ratingloom.session import stage

LONG_ROW = 512
BLOCK_COLS = 2048
BLOCK_ROWS = 128
_CELLS_PER_BLOCK = 64
_DENSE_SHARE = 0.02
PAIRS_PER_TASK = 1_000_000
#: Columns up to which the pairs of a task are mostly alike, so that a join's partial sums are fewer.
FEW_COLS = 1024
_PAIRS_PER_BLOCK = 4_000_000
_PAIRS_AT_ONCE = 1_000_000
_CELLS_AT_ONCE = 50_000

_PAIR_SCHEMA = "i long, j long, dot double"
#: Cells of one chunk, about.
_CELLS_PER_CHUNK = 500_000


def pair_products(
    cells: DataFrame,
    row: str,
    col: str,
    value: str,
    weight: str | None = None,
    keys: DataFrame | None = None,
    long_row: int = LONG_ROW,
    block_cols: int = BLOCK_COLS,
    block_rows: int = BLOCK_ROWS,
    few_cols: int = FEW_COLS,
) -> DataFrame:
    """``i < j`` and ``dot``, the sum over rows of ``value_i * value_j * weight``.

    ``cells`` must hold each (row, col) once.  Row lengths are measured before
    the plan is chosen, on ``keys`` where given: a stored table with the same
    (row, col) pairs.  ``weight`` names a column that is constant within a row.
    """
    stored = (cells if keys is None else keys).select(
        F.col(row).cast("long").alias("r"), F.col(col).cast("long").alias("c")
    )
    left = F.col(value).cast("double")
    right = left * F.col(weight).cast("double") if weight else left
    cells = cells.select(
        F.col(row).cast("long").alias("r"), F.col(col).cast("long").alias("c"),
        left.alias("a"), right.alias("b"),
    )
    lengths = stored.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    is_long = F.col("n") > long_row
    met = F.sum(F.when(~is_long, F.col("n").cast("double") * F.col("n") / 2))
    size = lengths.agg(
        F.count_if(is_long).alias("long_rows"), met.alias("pairs"), F.sum(F.when(~is_long, F.col("n"))).alias("cells"),
        F.min(F.when(is_long, F.col("n"))).alias("least_long"), F.max("n").alias("longest"),
    ).first()
    long_rows, met_pairs = size["long_rows"], size["pairs"] or 0
    width = stored.agg(
        F.approx_count_distinct("c").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")
    ).first()
    wide = width["n"] > 0 and not -(2**31) <= width["least"] <= width["most"] < 2**31

    def short_pairs(short: DataFrame) -> DataFrame:
        """Pairs of short rows, and whether each stands in one row already."""
        if width["n"] <= few_cols:
            return _short_pairs(short, max(1, math.ceil(met_pairs / PAIRS_PER_TASK)))
        blocks = max(1, math.ceil(met_pairs / _PAIRS_PER_BLOCK))
        cores = stored.sparkSession.sparkContext.defaultParallelism
        parts = max(min(cores, blocks), math.ceil((size["cells"] or 0) / _CELLS_PER_CHUNK))
        return _read_pairs(short, parts, blocks, weight is not None, wide)

    if not long_rows:
        return short_pairs(cells) if width["n"] > few_cols else _summed(short_pairs(cells))

    long_only = lengths.filter(is_long)
    short = cells.join(long_only.select("r"), "r", "left_anti")
    long = cells.join(long_only, "r")
    max_blocks, row_blocks = -(-width["n"] // block_cols), -(-long_rows // block_rows)
    alike = _col_blocks(size["least_long"], max_blocks) == _col_blocks(size["longest"], max_blocks)
    if not met_pairs and row_blocks == 1 and alike:
        # One cut of columns and rows: a pair leaves one strip, once.
        return _strip_pairs(cells, _col_blocks(size["longest"], max_blocks))
    return _summed(short_pairs(short).union(_block_pairs(long, max_blocks, row_blocks)))


def squared_norms(cells: DataFrame, col: str, value: str) -> DataFrame:
    """The diagonal: ``i`` and ``dot``, the sum of squares of each column."""
    return cells.groupBy(F.col(col).cast("long").alias("i")).agg(
        F.sum(F.col(value).cast("double") * F.col(value).cast("double")).alias("dot")
    )


def symmetric(pairs: DataFrame, value: str) -> DataFrame:
    """Both (i, j) and (j, i) for an upper triangle, from one pass over it."""
    return pairs.select(
        F.explode(F.array(
            F.struct("i", "j", value),
            F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col(value)),
        )).alias("p")
    ).select("p.*")


def _summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("i", "j").agg(F.sum("dot").alias("dot"))


def _short_pairs(cells: DataFrame, parts: int) -> DataFrame:
    """Pairs of short rows, with tasks sized by the pairs they make, not by bytes read.

    Both sides are the same shuffle, which is run once.
    """
    cells = cells.repartition(parts, "r")
    first = cells.select("r", F.col("c").alias("i"), "a")
    second = cells.select("r", F.col("c").alias("j"), "b")
    return (
        first.join(second, "r")
        .filter(F.col("i") < F.col("j"))
        .select("i", "j", (F.col("a") * F.col("b")).alias("dot"))
    )


def _read_pairs(cells: DataFrame, parts: int, blocks: int, weighted: bool, wide: bool) -> DataFrame:
    """Pairs of short rows, each with its whole sum; rows are packed and stored once, and every block reads them."""
    kind = np.dtype("<i8" if wide else "<i4")
    if not weighted:
        cells = cells.drop("a")  # both sides of a product are the same numbers
    rows = (
        cells.filter("r is not null and c is not null")
        .repartition(parts, "r").sortWithinPartitions("r", "c")
    )
    stored = stage(rows.mapInArrow(whole_rows("r", _CELLS_PER_CHUNK, _packer(kind, weighted)), FRAMES), "pair-rows")
    met = past(stored, numbered(cells.sparkSession, blocks))
    return met.mapInArrow(tidied(_adder(kind, blocks)), _PAIR_SCHEMA)


def _packer(kind: np.dtype, weighted: bool) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        r = table.column("r").to_numpy()
        starts = np.flatnonzero(np.r_[True, np.diff(r) != 0, True])
        second = coded(bits_of(table.column("b")))
        first = coded(bits_of(table.column("a"))) if weighted else (b"", b"")
        columns = (squeezed(table.column("c").to_numpy().astype(kind)), squeezed(np.diff(starts).astype("<i4")), *first, *second)
        yield from frames([columns])

    return packed


def _adder(kind: np.dtype, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the pairs that the columns of a block begin.

    Sums are merged as soon as twice what is merged already has come, so memory follows the
    distinct pairs of a block.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: list[tuple[np.ndarray, ...]] = []
        fresh: list[tuple[np.ndarray, ...]] = []
        chunks = Frames()
        for batch in batches:
            for chunk in chunks.whole(batch):
                for part in _products_of(chunk, kind, batch.column("block")[0].as_py(), blocks):
                    fresh.append(_folded(*part))
                    if sum(len(f[0]) for f in fresh) > _PAIRS_PER_BLOCK + sum(len(m[0]) for m in merged):
                        merged, fresh = [_folded(*map(np.concatenate, zip(*merged, *fresh, strict=True)))], []
        if not merged and not fresh:
            return
        merged, fresh = [tuple(map(np.concatenate, zip(*merged, *fresh, strict=True)))], []
        i, j, dot, known = _folded(*merged.pop())
        for at in range(0, len(i), _CELLS_AT_ONCE):
            some = slice(at, at + _CELLS_AT_ONCE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[some].astype(np.int64)), pa.array(j[some].astype(np.int64)), pa.array(dot[some], mask=~known[some])],
                names=["i", "j", "dot"],
            )

    return add


def _products_of(chunk: list[memoryview], kind: np.dtype, block: int, blocks: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``i, j, product, known`` of the pairs that a block begins in a chunk of rows, so many at once; a null makes a product unknown."""
    cols, ends = numbers(chunk[0], kind), np.cumsum(numbers(chunk[1], "<i4"))
    left = np.flatnonzero(blocks_of(cols, blocks) == block)
    count = ends[np.searchsorted(ends, left, "right")] - left - 1
    left, count = left[count > 0], count[count > 0]
    seconds = Coded(*chunk[4:6])
    firsts = Coded(*chunk[2:4]) if len(chunk[3]) else seconds
    upto = np.r_[0, np.cumsum(count)]
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + _PAIRS_AT_ONCE, "right")) - 1)
        i, a = (np.repeat(x[left[at:to]], count[at:to]) for x in (cols, firsts))
        theirs = runs(left[at:to] + 1, count[at:to])
        j, b = cols[theirs], seconds[theirs]
        apart = i < j
        if not apart.all():
            i, a, j, b = (x[apart] for x in (i, a, j, b))
        known = (a != NULL) & (b != NULL)
        product = np.where(known, a.view("<f8") * b.view("<f8"), 0.0)
        yield i, j, product, known
        at = to


def _folded(i: np.ndarray, j: np.ndarray, dot: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row per pair: the sum of what is known."""
    if not len(i):
        return i, j, dot, known
    if i.dtype == np.int32:
        key = i.astype(np.int64)
        key <<= 32
        key += j
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order]) != 0
        del key
    else:
        order = np.lexsort((j, i))
        new = (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
    first = np.flatnonzero(np.r_[True, new])
    at = order[first]
    return i[at], j[at], np.add.reduceat(dot[order], first), np.logical_or.reduceat(known[order], first)


def _col_blocks(length: int, max_blocks: int) -> int:
    """Into how many column blocks a row is cut."""
    return min(max(2 ** (length.bit_length() - 1) // _CELLS_PER_BLOCK, 1), max_blocks)


def _block_pairs(cells: DataFrame, max_blocks: int, row_blocks: int) -> DataFrame:
    """Pairs of long rows.

    A row of length n is cut into about ``n / 64`` column blocks, never more than
    the whole matrix has; rows of similar length share the number of blocks.
    Each cell is sent to the block pairs it takes part in.
    """
    wanted = F.pow(F.lit(2.0), F.floor(F.log2("n"))) / _CELLS_PER_BLOCK
    placed = (
        cells.withColumn("nb", F.least(F.greatest(wanted.cast("int"), F.lit(1)), F.lit(max_blocks)))
        .withColumn("rb", F.pmod(F.xxhash64("r"), F.lit(row_blocks)).cast("int"))
        .withColumn("cb", F.pmod(F.xxhash64("c"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select(
            "nb", "rb",
            F.least("cb", "other").alias("lo"), F.greatest("cb", "other").alias("hi"),
            "cb", "r", "c", "a", "b",
        )
    )
    return placed.groupBy("nb", "rb", "lo", "hi").applyInPandas(_multiply_block, _PAIR_SCHEMA)


def _strip_pairs(cells: DataFrame, strips: int) -> DataFrame:
    """Pairs of a few long rows cut alike: each strip of columns reads all strips from where they are stored."""
    placed = (
        cells.filter("r is not null and c is not null")
        .withColumn("strip", F.pmod(F.xxhash64("c"), F.lit(strips)).cast("int"))
        .repartitionById(strips, "strip").sortWithinPartitions("strip", "r", "c")
    )
    stored = stage(placed.mapInArrow(whole_rows("strip", _CELLS_PER_CHUNK, _packed_strips), f"strip int, {FRAMES}"), "strips")
    own = stored.withColumnRenamed("strip", "block").repartitionById(strips, "block").mapInArrow(ended, HELD)
    return past_held(stored, own).mapInArrow(tidied(_strip_products), _PAIR_SCHEMA)


def _packed_strips(table: pa.Table) -> Iterator[pa.RecordBatch]:
    strip = table.column("strip").to_numpy()
    edges = np.flatnonzero(np.r_[True, np.diff(strip) != 0, True])
    for begin, end in itertools.pairwise(edges.tolist()):
        some = table.slice(begin, end - begin)
        r, c = (some.column(name).to_numpy() for name in ("r", "c"))
        values = (*coded(bits_of(some.column("a"))), *coded(bits_of(some.column("b"))))
        for one in frames([(squeezed(strip[begin:begin + 1].astype("<i8")), squeezed(r), squeezed(c), *values)]):
            of = pa.array(np.full(one.num_rows, strip[begin], np.int32))
            yield pa.RecordBatch.from_arrays([of, *one.columns], names=["strip", *one.schema.names])


def _strip_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a strip with itself and with those of greater number."""
    held, passing = Frames("h_"), Frames()
    own: list[pd.DataFrame] = []
    early: list[list[bytes]] = []
    for batch in batches:
        mine = batch.column("own").to_numpy()
        for begin, end in itertools.pairwise([0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), len(mine)]):
            some = batch.slice(begin, end - begin)
            if end > begin and mine[begin]:
                for blobs in held.whole(some):
                    own.extend(_strip(blobs[k:k + 7]) for k in range(0, len(blobs), 7))
                continue
            for blobs in passing.whole(some):
                if own:
                    yield from _strips_met(own, _strip(blobs))
                else:
                    early.append([bytes(blob) for blob in blobs])
    for blobs in early if own else ():
        yield from _strips_met(own, _strip(blobs))


def _strip(blobs: list[memoryview]) -> pd.DataFrame:
    a, b = (Coded(*blobs[k:k + 2])[:].view("<f8") for k in (3, 5))
    return pd.DataFrame({"r": numbers(blobs[1], "<i8"), "c": numbers(blobs[2], "<i8"), "a": a, "b": b}).assign(
        cb=int(numbers(blobs[0], "<i8")[0])
    )


def _strips_met(own: list[pd.DataFrame], other: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    lo, hi = own[0]["cb"].iat[0], other["cb"].iat[0]
    if hi < lo:
        return
    both = pd.concat(own if lo == hi else [*own, other]).assign(lo=lo, hi=hi)
    found = _multiply_block(both)
    for at in range(0, len(found), _CELLS_AT_ONCE):
        i, j, dot = (found[name].to_numpy()[at:at + _CELLS_AT_ONCE] for name in ("i", "j", "dot"))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(dot, mask=np.isnan(dot))], names=["i", "j", "dot"])


def _multiply_block(block: pd.DataFrame) -> pd.DataFrame:
    """Pair sums of one bounded block of rows and two blocks of columns."""
    lo, hi = block["lo"].iat[0], block["hi"].iat[0]
    in_lo = (block["cb"] == lo).to_numpy()
    in_hi = in_lo if lo == hi else (block["cb"] == hi).to_numpy()
    rows, r = np.unique(block["r"].to_numpy(), return_inverse=True)
    c, a, b = (block[k].to_numpy() for k in ("c", "a", "b"))
    left_cols, left = np.unique(c[in_lo], return_inverse=True)
    right_cols, right = np.unique(c[in_hi], return_inverse=True)
    if not len(left_cols) or not len(right_cols):
        return pd.DataFrame({"i": [], "j": [], "dot": []}).astype({"i": "int64", "j": "int64"})

    share = in_lo.sum() / (len(rows) * len(left_cols))
    if share >= _DENSE_SHARE:
        x = np.zeros((len(rows), len(left_cols)))
        y = np.zeros((len(rows), len(right_cols)))
        x[r[in_lo], left] = a[in_lo]
        y[r[in_hi], right] = b[in_hi]
        # Presence is kept apart from the value: a stored zero meets like any other.
        here, there = np.zeros(x.shape, np.float32), np.zeros(y.shape, np.float32)
        here[r[in_lo], left] = 1
        there[r[in_hi], right] = 1
        product = x.T @ y
        met = here.T @ there > 0
        p, q = np.nonzero(met)
        dot = product[p, q]
    else:
        p, q, dot = _sparse_products(
            r[in_lo], left, a[in_lo], r[in_hi], right, b[in_hi], len(right_cols)
        )
    i, j = left_cols[p], right_cols[q]
    if lo == hi:
        keep = i < j
        i, j, dot = i[keep], j[keep], dot[keep]
    return pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "dot": dot})


def _sparse_products(r1, c1, v1, r2, c2, v2, width) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of the cells that share a row, summed by column pair."""
    order = np.argsort(r2, kind="stable")
    r2, c2, v2 = r2[order], c2[order], v2[order]
    begin = np.searchsorted(r2, r1, "left")
    count = np.searchsorted(r2, r1, "right") - begin
    mine = np.repeat(np.arange(len(r1)), count)
    theirs = np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    keys, where = np.unique(c1[mine].astype(np.int64) * width + c2[theirs], return_inverse=True)
    dot = np.bincount(where, weights=v1[mine] * v2[theirs], minlength=len(keys))
    return keys // width, keys % width, dot
