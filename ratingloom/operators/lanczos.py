"""Leading singular vectors by block Golub-Kahan-Lanczos bidiagonalisation.

Both sides of the matrix get an orthonormal basis that grows by a block a step: the
matrix times the newest block of items gives a block of users, its transpose times
that gives the next block of items.  Each block is made orthogonal to all before it,
twice, so the small matrix between the two bases is the matrix itself seen from
there, and its singular values are wanted ones as soon as the residuals say so.
No product of the matrix with itself is formed, so a singular value is exact to
rounding relative to the leading one, not to the root of that.

Bases are distributed tables of one row per user or item.  Blocks are made orthonormal
by QR factors of their partitions, which are combined; only matrices over the
bases' few columns reach the driver.  A basis that has become too wide is turned to
its best vectors, and the iteration goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.numeric import hash_percent
from ratingloom.session import stage

#: Columns of a block at least; fewer would need more steps, each of which reads the ratings twice.
BLOCK = 32
#: Columns of a basis after which it is turned to its best vectors: at least so many, and a multiple of the rank.
BASIS, BASIS_RANKS = 400, 3
#: Steps after which an iteration that does not converge is given up with an error.
STEPS = 400
#: Residual of a singular vector, relative to the leading singular value.
TOLERANCE = 1e-10
#: Directions shorter than this, relative to the leading singular value, are rounding noise.
NOISE = 1e-13


@dataclass(frozen=True)
class Matrix:
    """``cells`` (user, item, rating), plus, where ``shifted``, the item's ``m`` less the user's ``m`` in every place.

    ``users`` and ``items`` name all rows and columns: ``user, m`` and ``item, m``.
    """

    cells: DataFrame
    users: DataFrame
    items: DataFrame
    shifted: bool = False

    def times(self, block: DataFrame, p: int) -> DataFrame:
        """The matrix times a block of items: ``user, f``."""
        if not self.shifted:
            return self._summed(block, "item", "user", self.users, p)
        sums, weighted = self._sums(self.items, block, "item", p)
        return self._summed(block, "item", "user", self.users, p, weighted, -sums)

    def transposed(self, block: DataFrame, p: int) -> DataFrame:
        """The transpose times a block of users: ``item, f``."""
        if not self.shifted:
            return self._summed(block, "user", "item", self.items, p)
        sums, weighted = self._sums(self.users, block, "user", p)
        return self._summed(block, "user", "item", self.items, p, -weighted, sums)

    def rounding(self, block: DataFrame, p: int) -> float:
        """What rounding alone can make of a product with a block, where the shift may cancel it."""
        if not self.shifted:
            return 0.0
        sums, weighted = self._sums(self.items, block, "item", p)
        most = self.users.agg(F.max(F.abs("m"))).first()[0] or 0.0
        return 1e-12 * float(np.linalg.norm(np.abs(weighted) + most * np.abs(sums))) * self.users.count() ** 0.5

    def _summed(self, block, inner, outer, every, p, fixed=None, by_mean=None) -> DataFrame:
        sums = [F.sum(F.col("rating") * F.col("f")[c]).alias(f"f{c}") for c in range(p)]
        found = self.cells.select("user", "item", "rating").join(block, inner).groupBy(outer).agg(*sums)
        parts = []
        for c in range(p):
            part = F.coalesce(f"f{c}", F.lit(0.0))
            if fixed is not None:
                part = part + F.lit(float(fixed[c])) + F.col("m") * F.lit(float(by_mean[c]))
            parts.append(part)
        return every.join(found, outer, "left").select(outer, F.array(*parts).alias("f"))

    def _sums(self, every, block, key, p) -> tuple[np.ndarray, np.ndarray]:
        """The block's column sums, plain and weighted by ``m``."""
        terms = [F.sum(F.col("f")[c]) for c in range(p)] + [F.sum(F.col("m") * F.col("f")[c]) for c in range(p)]
        found = np.array(every.join(block, key).agg(*terms).first(), float)
        return found[:p], found[p:]


def cross(pairs: DataFrame, p: int, q: int) -> np.ndarray:
    """Sum over rows of the outer product of ``f`` and ``g``: a (p x q) matrix."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, q))
        for batch in batches:
            if len(batch):
                total += np.vstack(batch["f"].to_numpy()).T @ np.vstack(batch["g"].to_numpy())
        yield pd.DataFrame({"at": np.arange(p * q), "x": total.ravel()})

    rows = (
        pairs.select("f", "g").mapInPandas(partial, "at int, x double")
        .groupBy("at").agg(F.sum("x").alias("x")).collect()
    )
    out = np.zeros(p * q)
    for row in rows:
        out[row["at"]] = row["x"]
    return out.reshape(p, q)


def times(block: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Every row's vector times a small matrix."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "f": list(np.vstack(batch["f"].to_numpy()) @ matrix)})

    return block.mapInPandas(multiply, f"{key} long, f array<double>")


def minus(pairs: DataFrame, key: str, along: np.ndarray) -> DataFrame:
    """``g`` without its part along ``f``."""

    def subtract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rest = np.vstack(batch["g"].to_numpy()) - np.vstack(batch["f"].to_numpy()) @ along
                yield pd.DataFrame({key: batch[key], "f": list(rest)})

    return pairs.mapInPandas(subtract, f"{key} long, f array<double>")


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``f`` of the one and ``g`` of the other, row by row."""
    return left.join(right.withColumnRenamed("f", "g"), key)


def upper_factor(block: DataFrame, p: int) -> np.ndarray:
    """The R of the block's QR factors: each partition keeps a (p x p) one, and they are combined."""

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, p))
        for batch in batches:
            if len(batch):
                held = np.linalg.qr(np.vstack((held, np.vstack(batch["f"].to_numpy()))), mode="r")
        if len(held):
            yield pd.DataFrame({"r": [held.ravel()]})

    parts = [np.array(r["r"]).reshape(-1, p) for r in block.select("f").mapInPandas(folded, "r array<double>").collect()]
    return np.linalg.qr(np.vstack([*parts, np.zeros((p, p))]), mode="r")


def orthonormal(block: DataFrame, key: str, p: int, least: float) -> tuple[DataFrame, np.ndarray]:
    """An orthonormal basis of a block, and the block in its terms; directions not above ``least`` are left out.

    The second pass mends what nearly parallel columns have cost the first.
    """
    _, sizes, turn = np.linalg.svd(upper_factor(block, p))
    live = sizes > least
    if not live.any():
        return block, np.zeros((0, p))
    basis = stage(times(block, key, turn[live].T / sizes[live]), "block")
    small = upper_factor(basis, int(live.sum()))
    return stage(times(basis, key, np.linalg.inv(small)), "block"), small @ (sizes[live, None] * turn[live])


def apart(basis: DataFrame, block: DataFrame, key: str, width: int, p: int) -> tuple[DataFrame, np.ndarray]:
    """A block without its part along a basis, and that part; done twice, as one pass loses accuracy."""
    both = paired(basis, block, key)
    along = cross(both, width, p)
    rest = stage(minus(both, key, along), "rest")
    both = paired(basis, rest, key)
    more = cross(both, width, p)
    return stage(minus(both, key, more), "rest"), along + more


def widened(basis: DataFrame, block: DataFrame, key: str) -> DataFrame:
    """A basis with the columns of a block added."""
    return stage(paired(basis, block, key).select(key, F.concat("f", "g").alias("f")), "basis")


def leading(
    matrix: Matrix, k: int, least: float, block: int | None = None, most: int | None = None
) -> tuple[DataFrame, DataFrame, list[float]]:
    """``user, f`` and ``item, f`` of the ``k`` leading singular vectors, and the singular values.

    Values below ``least`` times the first are left out, so there may be fewer; a zero
    matrix has none.  Raises if the residuals do not fall below :data:`TOLERANCE`.
    """
    users, items = matrix.users.count(), matrix.items.count()
    k = min(k, users, items)
    p = min(users, items, block or max(BLOCK, k // 6))
    most = most or max(BASIS, BASIS_RANKS * (k + p))
    noise = [F.lit(1.0) * (hash_percent("item", F.lit(c), seed=7) / 50.0 - 0.99) for c in range(p)]
    start = stage(matrix.items.select("item", F.array(*[x.cast("double") for x in noise]).alias("f")), "block")
    fresh, _ = orthonormal(start, "item", p, 0.0)
    fresh_width = p
    right, left = fresh, None
    small = np.zeros((0, 0))  # the matrix between the two bases
    scale, tail = 0.0, np.zeros((0, 0))
    for _ in range(STEPS):
        image = stage(matrix.times(fresh, fresh_width), "image")
        wide = small.shape[0]
        along = np.zeros((0, fresh_width))
        if wide:
            image, along = apart(left, image, "user", wide, fresh_width)
        if not scale:
            scale = float(np.linalg.norm(upper_factor(image, fresh_width), 2))
            if scale <= matrix.rounding(fresh, fresh_width):
                return _none(matrix.users, "user"), _none(matrix.items, "item"), []
        new, coefficients = orthonormal(image, "user", fresh_width, NOISE * scale)
        added = len(coefficients)
        grown = np.zeros((wide + added, small.shape[1] + fresh_width))
        grown[:wide, : small.shape[1]] = small
        grown[:wide, small.shape[1] :] = along
        grown[wide:, small.shape[1] :] = coefficients
        small = grown
        if added:
            left = new if left is None else widened(left, new, "user")
            back = stage(matrix.transposed(new, added), "image")
            back, _ = apart(right, back, "item", small.shape[1], added)
            fresh, tail = orthonormal(back, "item", added, NOISE * scale)
        else:
            tail = np.zeros((0, 0))
        rows, values, columns = np.linalg.svd(small, full_matrices=False)
        scale = max(scale, float(values[0]))
        # The transpose times the left basis leaves the right one by ``tail`` of its newest block only.
        off = tail @ rows[wide:, :k] if len(tail) else np.zeros((1, min(k, len(values))))
        if not len(tail) or (len(values) >= k and (np.linalg.norm(off, axis=0) <= TOLERANCE * scale).all()):
            kept = int((values[:k] > least * values[0]).sum())
            return (stage(times(left, "user", rows[:, :kept]), "user_factors"),
                    stage(times(right, "item", columns[:kept].T), "item_factors"), values[:kept].tolist())
        if small.shape[1] + len(tail) > most:
            keep = min(k + p, len(values))
            left = stage(times(left, "user", rows[:, :keep]), "ritz")
            right = stage(times(right, "item", columns[:keep].T), "ritz")
            small = np.diag(values[:keep])
        fresh_width = len(tail)
        right = widened(right, fresh, "item")
    raise ArithmeticError(f"the factors did not converge; residuals {np.linalg.norm(off, axis=0).tolist()} of {scale}")


def _none(every: DataFrame, key: str) -> DataFrame:
    return every.select(key, F.array().cast("array<double>").alias("f"))
