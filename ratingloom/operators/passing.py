"""Stored tables that stream past blocks, and numbers packed for that.

Where every block of a job needs all rows of a table, sending them to each block costs disk for as many
copies as there are blocks.  Here the table is packed and stored once, and every task reads it from there.
"""

from __future__ import annotations

import ctypes
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks a value that is null among packed doubles: a NaN that no arithmetic makes.
NULL = np.int64(0x7FF8_DEAD_BEEF_0001)
_CODES = 1 << 16
#: Rows of a packed table: slices of frames, so small that a batch of ten thousand is 16 MB, wherever they go.
FRAMES = "frame long, at int, of int, data binary"
_SLICE = 1600
#: Bytes of a block's frames that make a row.
_TOGETHER = 1 << 24


def tidied(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``function`` over batches, giving freed memory back to the system at its end: workers outlive their tasks."""

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # not the GNU library

    return run


def numbered(spark: SparkSession, count: int) -> DataFrame:
    """``block``: a row and a partition for each block."""
    return spark.range(0, count, 1, count).select(F.col("id").cast("int").alias("block"))


def past(stored: DataFrame, blocks: DataFrame) -> DataFrame:
    """All rows of ``stored`` beside each row of ``blocks``, which keep their partitions.

    A task has one partition of ``blocks`` and reads the stored rows itself: nothing is shuffled.
    """
    return stored.coalesce(1).join(blocks.hint("shuffle_replicate_nl"))


def past_held(stored: DataFrame, blocks: DataFrame) -> DataFrame:
    """``mine``, a frame's slices, ``own`` and a block's slices: all of a block's once, then all of ``stored``.

    ``blocks`` is what :func:`ended` makes: stored rows come beside the last row of a partition only, so
    what a block holds is not repeated for each of them.  In a store that tells
    where its files lie some stored rows can come first.
    """
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema.fields]
    mark = stored.sparkSession.range(0, 1, 1, 1).select(F.lit(1).alias("mine"), *none)
    rows = mark.union(stored.select(F.lit(0).alias("mine"), "*")).coalesce(1)
    alike = (F.col("mine") <= F.col("own")) & (F.col("mine") >= F.col("own"))
    return rows.join(blocks.hint("shuffle_replicate_nl"), alike)


def frames(blobs: Iterator[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
    """The slices of frames, each of some blobs."""
    for some in blobs:
        data = _joined(some)
        cuts = range(0, max(1, len(data)), _SLICE)
        number = uuid.uuid4().int >> 65
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(cuts), number)), pa.array(np.arange(len(cuts), dtype=np.int32)),
            pa.array(np.full(len(cuts), len(cuts), np.int32)), pa.array([data[k:k + _SLICE] for k in cuts], pa.binary()),
        ], names=["frame", "at", "of", "data"])


class Frames:
    """Puts frames together again from their slices, in whatever order they come."""

    def __init__(self, prefix: str = "") -> None:
        self._names = [prefix + name for name in ("frame", "at", "of", "data")]
        self._open: dict[int, dict[int, bytes]] = {}

    def whole(self, batch: pa.RecordBatch) -> Iterator[list[memoryview]]:
        """The blobs of each frame that a batch completes."""
        if not batch.num_rows:
            return
        frame, at, of = (batch.column(name).to_numpy() for name in self._names[:3])
        data = batch.column(self._names[3])
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + len(data) + 1]
        held = memoryview(data.buffers()[2])
        # Runs of a frame's slices in their order are one piece of memory.
        starts = np.flatnonzero(np.r_[True, (np.diff(frame) != 0) | (np.diff(at) != 1)])
        for begin, end in itertools.pairwise([*starts.tolist(), len(frame)]):
            piece = held[ends[begin]:ends[end]]
            if end - begin < of[begin]:
                parts = self._open.setdefault(int(frame[begin]), {})
                parts[int(at[begin])] = (end - begin, bytes(piece))
                if sum(n for n, _ in parts.values()) < of[begin]:
                    continue
                piece = memoryview(b"".join(parts[k][1] for k in sorted(parts)))
                del self._open[int(frame[begin])], parts
            yield _blobs(piece)


def _joined(blobs: Iterable[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in blobs)


def _blobs(data: memoryview) -> list[memoryview]:
    found, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at:at + 8], "little")
        found.append(data[at + 8:at + 8 + size])
        at += 8 + size
    return found


def held_row(block: int, number: int = 0, blobs: Iterable[bytes] | None = None) -> pa.RecordBatch:
    """A frame that a block holds, or its last row."""
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    values = (0, block, 0, 0, 0, b"") if blobs is None else (1, block, number, 0, 1, _joined(blobs))
    return pa.RecordBatch.from_arrays(
        [pa.array([x], kind) for x, kind in zip(values, kinds, strict=True)],
        names=["own", "block", "h_frame", "h_at", "h_of", "h_data"],
    )


def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's frames, many in one row, as ``own`` 1, ``block`` and ``h_`` columns, and a last row of ``own`` 0.

    Every stored row is tried with every row of a block, so these are few.
    """
    block, slices, number, size = None, Frames(), 0, 0
    held: list[bytes] = []
    for batch in batches:
        for blobs in slices.whole(batch):
            block = batch.column("block")[0].as_py()
            held += map(bytes, blobs)
            size += sum(map(len, blobs))
            if size >= _TOGETHER:
                yield held_row(block, number, held)
                held, size, number = [], 0, number + 1
    if held:
        yield held_row(block, number, held)
    if block is not None:
        yield held_row(block)


HELD = "own int, block int, h_frame long, h_at int, h_of int, h_data binary"


def whole_rows(column: str, at_once: int, packed: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """For ``mapInArrow``: ``packed`` of tables of about ``at_once`` rows, which arrive sorted by ``column`` and are not cut inside a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, enough = 0, at_once
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= enough:
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table.column(column).to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))  # the last one may go on
                if whole:
                    yield from packed(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                size = table.num_rows - whole
                enough = max(at_once, 2 * size)  # a long one is not looked through again and again
        if size:
            yield from packed(pa.Table.from_batches(held).combine_chunks())

    return tidied(run)


def bits_of(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles as their bits, nulls as the mark."""
    bits = column.fill_null(0.0).to_numpy().astype("<f8").view("<i8")
    return np.where(column.is_null().to_numpy(), NULL, bits) if column.null_count else bits


def squeezed(values: np.ndarray) -> bytes:
    """An array, compressed; read by :func:`numbers`."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def numbers(blob: memoryview | bytes, kind: str | np.dtype) -> np.ndarray:
    """The array of a compressed blob."""
    view = memoryview(blob)
    size = int.from_bytes(view[:8], "little")
    return np.frombuffer(pa.decompress(view[8:], size, codec="zstd") if size else b"", kind)


def coded(bits: np.ndarray) -> tuple[bytes, bytes]:
    """Values that come back often as codes into a list of them; others stay as they are, with an empty list."""
    kinds, codes = np.unique(bits, return_inverse=True)
    if len(kinds) > _CODES or 2 * len(kinds) > len(bits):
        return squeezed(bits[:0]), squeezed(bits)
    return squeezed(kinds), squeezed(codes.astype("<u1" if len(kinds) <= 256 else "<u2"))


class Coded:
    """Values packed by :func:`coded`, looked up by place."""

    def __init__(self, kinds: memoryview, codes: memoryview) -> None:
        self.kinds = numbers(kinds, "<i8")
        self.codes = numbers(codes, "<i8" if not len(self.kinds) else "<u1" if len(self.kinds) <= 256 else "<u2")

    def __getitem__(self, at) -> np.ndarray:
        return self.kinds[self.codes[at]] if len(self.kinds) else self.codes[at]


def runs(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ...``, ``length[k]`` of them, one run after the other."""
    return np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length), length)


def blocks_of(keys: np.ndarray, count: int) -> np.ndarray:
    """The block, 0 .. count-1, of each number."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int32)
