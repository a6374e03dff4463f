"""Exact top-k inner products by the threshold algorithm.

Every Arrow batch of vectors is a shard with, for every dimension, the order of its
vectors by that component.  A query goes down all lists at once, from the large
end where its own component is positive and from the small end where it is
negative, and stops when the best score that an unseen vector could have is below
its k-th result.  The k-th result is carried from a task's shards to its next
ones.  The bound of a depth needs no scores, only the components at that depth, so
the bounds of all depths are known before a vector is scored: a query whose lists
cannot close before half of the shard is met takes the rest of it at once, in
one product with the other queries of that kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.asking import Best, blocks, exact_kind, in_passes, matrix_of, norms, scaled, usable
from ratingloom.session import stage

#: How deep the lists are read first; every further round goes three times as deep.
FIRST_DEPTH = 2


def whole_components(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, parts``: components as floor(scale * x); vectors with null or non-finite ones are left out."""
    chosen = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return chosen.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("parts"))


class Shard:
    """Sorted lists of a shard's components."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.matrix = ids, matrix
        self.orders = np.argsort(matrix, axis=0, kind="stable")
        self.sorted = np.take_along_axis(matrix, self.orders, axis=0)
        self.long = norms(matrix)

    def depths(self) -> list[int]:
        """Depths of the rounds after which a part of the shard can be unseen."""
        out, depth = [], FIRST_DEPTH
        while depth * max(1, self.matrix.shape[1]) * 2 < len(self.ids):
            out.append(depth)
            depth *= 3
        return out

    def met(self, query: np.ndarray, low: int, high: int) -> np.ndarray:
        """Vectors between two depths of a query's lists."""
        n = len(self.ids)
        falling, rising = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        return np.unique(np.concatenate((self.orders[n - high : n - low, falling].ravel(), self.orders[low:high, rising].ravel())))

    def search(self, queries: np.ndarray, own: np.ndarray, best: Best, first: int = 0) -> int:
        """Add the shard's answers to ``best``, where the queries are the groups from ``first`` on.

        Returns how many vectors were scored in all.
        """
        n, names = len(self.ids), np.arange(first, first + len(queries))
        kind = exact_kind(self.long * norms(queries))
        matrix, asked = self.matrix.astype(kind), queries.astype(kind)

        floor = best.floor[names]

        def score(rows: np.ndarray, at: np.ndarray) -> None:
            values = asked[rows] @ matrix[at].T
            r, c = np.nonzero((values >= floor[rows][:, None]) & (self.ids[at] != own[rows][:, None]))
            best.add(names[rows][r], self.ids[at][c], values[r, c].astype(np.int64))

        open_, scored = np.arange(len(queries)), 0
        depths = self.depths()
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        bounds = [plus @ self.sorted[n - d] + minus @ self.sorted[d - 1] for d in depths]
        if depths:
            # Both ends of every list are read by all queries; they set the first bound.
            d = depths[0]
            head = np.unique(np.concatenate((self.orders[:d].ravel(), self.orders[n - d :].ravel())))
            trial = Best(len(queries), best.k)
            values = asked @ matrix[head].T
            r, c = np.nonzero(self.ids[head] != own[:, None])
            trial.add(r, self.ids[head][c], values[r, c].astype(np.int64))
            floor = np.maximum(floor, trial.floor)
            close = np.min([np.where(b < floor, d, n) for b, d in zip(bounds, depths)], axis=0)
            walking = np.flatnonzero(close < n)
            for q in walking.tolist():
                low = 0
                for bound, depth in zip(bounds, depths):
                    at = self.met(queries[q], low, depth)
                    if low:  # vectors of an earlier round are known
                        at = np.setdiff1d(at, self.met(queries[q], 0, low), assume_unique=True)
                    score(np.array([q]), at)
                    scored += len(at)
                    if bound[q] < max(best.floor[names[q]], floor[q]):
                        break
                    low = depth
            scored += len(head) * len(queries)
            open_ = np.flatnonzero(close == n)
        if len(open_):
            score(open_, np.arange(n))
            scored += n * len(open_)
        return scored


def top_k(vectors: DataFrame, modulus: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best for every query.

    Queries are the vectors whose ``vec_id`` ``modulus`` divides; candidates are all rows but those
    with the query's own id.  Scores are integers, ties go to the smaller id.
    Vectors that are null or have null or non-finite components take no part, nor do
    rows without id; of vectors of different lengths the common components count.
    Of several rows with a query's id the smallest vector asks; repeated
    candidates are listed each.  An empty table gives no rows.  Other columns are
    ignored.
    """
    rows = stage(whole_components(vectors, scale), "topk-parts")
    asking = rows.filter(F.col("vec_id") % modulus == 0).groupBy("vec_id").agg(F.min("parts").alias("parts"))
    asking = stage(asking, "topk-queries")
    columns = "query_id long, vec_id long, score long"

    def searched(part: pa.Table) -> DataFrame:
        names = part.column("vec_id").to_numpy()
        queries = matrix_of(part.column("parts").combine_chunks())
        sent = rows.sparkSession.sparkContext.broadcast((names, queries))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, queries = sent.value
            best = Best(len(names), k)
            for batch in batches:
                shard = Shard(batch.column("vec_id").to_numpy(), matrix_of(batch.column("parts"), queries.shape[1]))
                for own in blocks(len(names)):
                    shard.search(queries[own], names[own], best, own.start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[best.group]), pa.array(best.ids), pa.array(best.scores)], names=["query_id", "vec_id", "score"]
            )

        return rows.mapInArrow(search, columns)

    parts = in_passes(asking, "vec_id", "parts", searched)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
