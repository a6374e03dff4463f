"""Centroid clustering over vectors in the order of a Hilbert curve.

Vectors are sorted once along a Hilbert curve through all their dimensions and cut
into blocks of neighbours; the first row of a block holds the block's box, the
least and greatest value of every component.  In each round a box tells which
centroids can be nearest to any of its vectors: a centroid goes if another one is
nearer to every point of the box, which a bound over the box's corners decides
exactly.  What is left is compared with the block's vectors in one product.  A
round reads the blocks once; sums per centroid and component are all that leaves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.asking import exact_kind, matrix_of, norms, scaled, usable
from ratingloom.session import stage

WIDTH = 64
BLOCK = 250
#: Bits of every dimension that the curve follows.
CURVE_BITS = 4
#: Components are held within this bound, so that squared distances fit 64 bits.
MOST = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cells on the Hilbert curve, as bytes that sort like it.

    Cells are whole numbers of ``bits`` bits, one column a dimension.  Turns every
    level's cube the way the curve enters it, then takes the Gray code.
    """
    x = cells.T.astype(np.int64).copy()
    if not len(x):
        return np.zeros((len(cells), 0), np.uint8)
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for axis in x:
            turned = (axis & level) != 0
            swap = np.where(turned, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where(turned, below, swap)
            axis ^= swap
        level >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip, level = np.zeros(len(cells), np.int64), 1 << (bits - 1)
    while level > 1:
        flip ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= flip
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each box, whether each centroid can be nearest to one of its points.

    One centroid, the nearest to the box's middle, is held against all others:
    |x-a|² - |x-b|² is linear in x, so its greatest value over a box is found per
    component; if that is below zero, ``b`` is nearest to no point of the box.
    """
    twice = low + high  # the middle, doubled
    gap = twice[:, None, :].astype(float) - 2 * centroids[None]
    a = centroids[np.argmin((gap**2).sum(2), axis=1)]
    slope = 2 * (centroids[None] - a[:, None])
    reach = np.maximum(slope * low[:, None], slope * high[:, None]).sum(2)
    return reach + (a**2).sum(1)[:, None] - (centroids**2).sum(1) >= 0


def nearest(matrix: np.ndarray, starts: np.ndarray, could: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, the smaller number on ties, and its squared distance."""
    kind = exact_kind((norms(matrix) + norms(centroids)) ** 2)
    x, c = matrix.astype(kind), centroids.astype(kind)
    own, square = (x * x).sum(1), (c * c).sum(1)
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for k, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(x)))):
        which = np.flatnonzero(could[k])
        far = own[a:b, None] - 2 * (x[a:b] @ c[which].T) + square[which]
        at = np.argmin(far, axis=1)
        cluster[a:b] = which[at]
        distance[a:b] = far[np.arange(b - a), at].astype(np.int64)
    return cluster, distance


def _ordered(rows: DataFrame, bits: int, block: int) -> DataFrame:
    """``block, vec_id, parts, low, high`` along the curve; the first row of a block has its box."""
    edge = rows.agg(F.min(F.array_min("parts")), F.max(F.array_max("parts"))).first()
    least, span = (edge[0], edge[1] - edge[0] + 1) if edge[0] is not None else (0, 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (matrix_of(batch.column("parts")) - least) * (1 << bits) // span
            keys = pa.array([k.tobytes() for k in hilbert_keys(cells, bits)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["vec_id", "parts", "place"])

    # Equal vectors are one place on the curve: the ids spread them over partitions.
    order = ["place", F.xxhash64("vec_id")]
    placed = rows.mapInArrow(keyed, "vec_id long, parts array<int>, place binary")
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("place")

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            matrix = matrix_of(batch.column("parts"))
            starts = np.arange(0, len(matrix), block)
            boxes = []
            for edges in (np.minimum, np.maximum):
                found: list[np.ndarray | None] = [None] * len(matrix)
                for at, row in zip(starts, edges.reduceat(matrix, starts) if len(matrix) else ()):
                    found[at] = row
                boxes.append(pa.array(found, pa.list_(pa.int32())))
            number = pa.array(done + np.arange(len(matrix)) // block)
            done += len(starts)
            yield pa.RecordBatch.from_arrays([number, *batch.columns, *boxes], names=["block", "vec_id", "parts", "low", "high"])

    return placed.mapInArrow(boxed, "block long, vec_id long, parts array<int>, low array<int>, high array<int>")


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A batch's vectors, their clusters and distances, and how many distances were computed."""
    matrix = matrix_of(batch.column("parts"))
    number, low = batch.column("block").to_numpy(), batch.column("low")
    heads = low.is_valid().to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | heads[1:]))
    lows, highs = np.minimum.reduceat(matrix, starts), np.maximum.reduceat(matrix, starts)
    known = heads[starts]  # a block whose head lies in another batch is boxed by the rows that are here
    lows[known] = matrix_of(low.filter(batch.column("low").is_valid()))
    highs[known] = matrix_of(batch.column("high").filter(batch.column("low").is_valid()))
    could = candidates(lows, highs, centroids)
    cluster, distance = nearest(matrix, starts, could, centroids)
    return matrix, cluster, distance, int(could.sum(1) @ np.diff(np.append(starts, len(matrix))))


def _means(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of every centroid's vectors; one without vectors stays."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                matrix, cluster, _, _ = _assigned(batch, centroids)
                order = np.argsort(cluster, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(cluster[order]) != 0))
                sums[cluster[order][first]] += np.add.reduceat(matrix[order], first)
                counts += np.bincount(cluster, minlength=len(centroids))
        met = np.flatnonzero(counts)
        # The place after the last component counts the vectors.
        every = np.concatenate((sums, counts[:, None]), axis=1)[met]
        place = np.tile(np.arange(every.shape[1]), len(met))
        columns = [np.repeat(met, every.shape[1]), place, every.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "place", "total"])

    found = blocks.mapInArrow(summed, "cluster long, place long, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total"))
    every = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
    for row in found.collect():  # one number per centroid and component
        every[row["cluster"], row["place"]] = row["total"]
    sums, counts = every[:, :-1], every[:, -1:]
    return np.where(counts > 0, sums // np.maximum(counts, 1), centroids)


def cluster(
    vectors: DataFrame, count: int = 40, rounds: int = 5, scale: int = 256, width: int = WIDTH, bits: int = CURVE_BITS,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared`` of every vector of ``width`` components.

    ``compared`` is how many centroids the vectors of its batch were compared with on average.
    Vectors of another length, null ones and ones with null or non-finite components
    are left out.  Components are floor(scale * x); beyond 2**27 they count as that.
    The first centroids are the vectors with the smallest SHA-256 of ``2:<vec_id>``; of
    rows with one id the smaller vector comes first, rows without id last, and equal
    rows are as many vectors.  With fewer vectors than ``count`` there are as many centroids as
    vectors.  Ties go to the smaller number, a centroid without vectors stays where
    it is.  An inertia too large for 64 bits is null.  An empty table gives no rows.
    Other columns are ignored.
    """
    x = F.col("embedding")
    rows = vectors.filter(usable(x) & (F.size(x) == width)).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled(x, scale, MOST).cast("array<int>").alias("parts")
    )
    blocks = stage(_ordered(stage(rows, "curve-parts"), bits, block), "curve-blocks")
    seed = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = blocks.select(seed.alias("seed"), "parts").orderBy(F.col("seed").asc_nulls_last(), "parts").limit(count)
    centroids = np.array([r["parts"] for r in first.collect()], np.int64).reshape(-1, width)
    for _ in range(rounds):
        centroids = _means(blocks, centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, number, distance, compared = _assigned(batch, centroids)
                share = np.full(len(number), compared / len(number))
                columns = [batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "compared"])

    found = stage(blocks.mapInArrow(assigned, "vec_id long, cluster int, distance long, compared double"), "curve-assigned")
    sums = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    whole = found.agg(F.try_sum("distance")).first()[0]
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    named = vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # One row per centroid, so it can be sent everywhere.
    sums = sums.join(named, "cluster").withColumn("inertia", F.lit(whole).cast("long"))
    return found.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"
    )
