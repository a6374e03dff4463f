"""Vectors of whole numbers asked by a stated set of queries, and the best answers kept on the way.

The vectors stay where they are: every Arrow batch of them is one shard.  The
queries come to the shards, in passes of a bounded size; a task keeps the best
answers it has met so far, so that its later shards are searched with the bound
that its earlier ones have set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of queries that one pass sends to every worker, about.
QUERY_BYTES = 32 << 20
#: Queries that are multiplied with a shard at once.
QUERY_BLOCK = 1024


def usable(vector: Column) -> Column:
    """Whether a vector is there and has no null or non-finite component."""
    return vector.isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def scaled(vector: Column, scale: int, most: int | None = None) -> Column:
    """Components as floor(scale * x), held within ``most`` either way if it is given."""

    def whole(v: Column) -> Column:
        x = v.cast("double") * scale
        if most is not None:
            x = F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), x))
        return F.floor(x)

    return F.transform(vector, whole)


def matrix_of(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of whole numbers as rows of ``width``, the longest by default; shorter ones end in zeros."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    widest = int(sizes.max(initial=0))
    if len(sizes) and (sizes == widest).all():
        out = flat.reshape(len(sizes), widest)
    else:
        out = np.zeros((len(sizes), widest), np.int64)
        out[np.arange(widest) < sizes[:, None]] = flat
    if width is None or width == widest:
        return out
    return out[:, :width] if width < widest else np.pad(out, ((0, 0), (0, width - widest)))


def norms(matrix: np.ndarray) -> float:
    """The greatest length of a row; no sum of products of two rows exceeds the product of their lengths."""
    return float(np.sqrt((matrix.astype(float) ** 2).sum(1).max(initial=0))) * (1 + 1e-9)


def exact_kind(bound: float) -> type:
    """The fastest number type in which sums of products up to ``bound`` are exact."""
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


class Best:
    """The ``k`` best of each of many groups: highest score first, smaller id on ties."""

    def __init__(self, groups: int, k: int) -> None:
        self.k = k
        self.group = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros(0, np.int64)
        #: The k-th score of each group so far; anything lower is out.
        self.floor = np.full(groups, np.iinfo(np.int64).min)

    def add(self, group: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in answers; those below their group's k-th score are passed over."""
        kept = np.flatnonzero(scores >= self.floor[group])
        if not len(kept):
            return
        group = np.concatenate((self.group, group[kept]))
        ids = np.concatenate((self.ids, ids[kept]))
        scores = np.concatenate((self.scores, scores[kept]))
        order = np.lexsort((ids, -scores, group))
        group = group[order]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        stay = place < self.k
        self.group, self.ids, self.scores = group[stay], ids[order][stay], scores[order][stay]
        full = place[stay] == self.k - 1
        self.floor[self.group[full]] = self.scores[full]


def in_passes(
    queries: DataFrame, key: str, numbers: str, run: Callable[[pa.Table], DataFrame], most: int = QUERY_BYTES
) -> list[DataFrame]:
    """What ``run`` makes of each part of the queries, a table of about ``most`` bytes of ``numbers`` at a time."""
    size = queries.agg(F.coalesce(F.sum(F.size(numbers) * 8 + 64), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(size) // most))
    turn = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(parts))
    return [run(queries.filter(turn == p).orderBy(key).toArrow()) for p in range(parts)]


def blocks(count: int, size: int = QUERY_BLOCK) -> Iterator[slice]:
    """Slices of about ``size`` of ``count`` rows."""
    return (slice(a, min(a + size, count)) for a in range(0, count, size))
