"""Truncated singular value decomposition of a rating matrix.

The right factors are eigenvectors of the item-by-item Gram matrix.  With few
items (checked first) that matrix comes from the pair kernel and is solved
directly.  With more items it is never formed: a block Krylov iteration multiplies
through the ratings, two joins a step, and ends when the residuals of the wanted
vectors are small; it raises if they do not become so.  The basis stays a
distributed table, only matrices over its few columns reach the driver.  The user
factors follow from one join.

Components whose singular value is below a millionth of the leading one are
rounding noise of a squared matrix and are left out, so a matrix of lower rank has
fewer than ``k`` factors, and a zero matrix has none; ``len(factors.values)`` says how many.

A matrix ``E + sum of products of vectors``, such as the mean-normalised one, is
handled without ever being written out: the vector part is carried as a few
numbers per item (``basis``) and a small mixing matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.numeric import dot, hash_percent, scale_by
from ratingloom.operators.cells import item_means, user_means
from ratingloom.operators.gram import pair_products, squared_norms, symmetric
from ratingloom.operators.lanczos import Matrix, leading
from ratingloom.operators.normalise import item_deviations
from ratingloom.session import stage

DIRECT_ITEMS = 1024
OVERSAMPLE = 8
#: Columns of the basis after which the iteration starts again from its best vectors; three blocks at least.
BASIS = 400
#: Starts after which an iteration that does not converge is given up with an error.
STARTS = 40
#: Residual of an eigenvector, relative to the leading eigenvalue.
TOLERANCE = 1e-9

# Below this norm an item's factors are rounding noise and have no direction.
ZERO_NORM = 1e-9


@dataclass(frozen=True)
class Factors:
    """``users``: user, f; ``items``: item, f; ``values``: singular values, descending."""

    users: DataFrame
    items: DataFrame
    values: list[float]

    def singular_values(self) -> DataFrame:
        """The singular values as a table: ``f, s``."""
        spark = self.items.sparkSession
        return spark.createDataFrame(list(enumerate(self.values)), "f int, s double")


def decompose(cells: DataFrame, k: int, direct_items: int = DIRECT_ITEMS, **kernel) -> Factors:
    """Rank-``k`` factors of the matrix of ratings, missing cells being zero."""
    items, values = _leading(cells, None, None, k, direct_items, **kernel)
    projected = _project(cells, items, len(values))
    return Factors(_divided(projected, values), items, values)


def bidiagonalised(cells: DataFrame, k: int, least: float = 1e-11) -> Factors:
    """Rank-``k`` factors of the matrix of ratings by bidiagonalisation of the ratings themselves.

    For small singular values, which a squared matrix loses: values down to ``least`` times
    the leading one are exact to rounding relative to that.  The users' vectors
    come from the iteration too.  A step costs more than one of :func:`decompose`.
    """
    people = stage(cells.select("user", F.lit(0.0).alias("m")).distinct(), "users")
    things = stage(cells.select("item", F.lit(0.0).alias("m")).distinct(), "items")
    return Factors(*leading(Matrix(cells, people, things), k, least))


def bidiagonalised_normalised(cells: DataFrame, k: int, least: float = 1e-11) -> Factors:
    """The same of the mean-normalised matrix, which is never written out."""
    people = stage(user_means(cells).select("user", F.col("user_mean").alias("m")), "user_means")
    things = stage(item_means(cells).select("item", F.col("item_mean").alias("m")), "item_means")
    return Factors(*leading(Matrix(stage(item_deviations(cells), "deviations"), people, things, shifted=True), k, least))


def decompose_normalised(cells: DataFrame, k: int, direct_items: int = DIRECT_ITEMS, **kernel) -> Factors:
    """Rank-``k`` factors of the mean-normalised matrix, from its sparse part."""
    means = stage(user_means(cells), "user_means")
    deviations = stage(item_deviations(cells), "deviations")
    basis = stage(
        deviations.join(means, "user")
        .groupBy("item")
        .agg(F.sum("rating").alias("e"), F.sum(F.col("rating") * F.col("user_mean")).alias("eu"))
        .join(item_means(cells), "item")
        .select("item", F.array("e", "eu", "item_mean", F.lit(1.0)).alias("b")),
        "basis",
    )
    total = means.agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_mean").alias("s"),
        F.sum(F.col("user_mean") * F.col("user_mean")).alias("ss"),
    ).first()
    # Product of the normalised matrix with itself, in terms of the basis columns
    # (column sums of E, of E weighted by user means, item means, ones).
    mixing = np.array([
        [0.0, 0.0, 1.0, 0.0],
        [0.0, 0.0, 0.0, -1.0],
        [1.0, 0.0, total["n"], -total["s"]],
        [0.0, -1.0, -total["s"], total["ss"]],
    ])
    items, values = _leading(deviations, basis, mixing, k, direct_items, **kernel)
    if not values:
        return Factors(means.select("user", F.array().cast("array<double>").alias("f")), items, values)
    at_means, at_ones = _basis_times(basis, items, len(values))[2:]
    sparse = _project(deviations, items, len(values))
    shifted = means.join(sparse, "user", "left").select(
        "user",
        F.array(*[
            F.coalesce(F.col("f")[c], F.lit(0.0)) + F.lit(float(at_means[c]))
            - F.col("user_mean") * F.lit(float(at_ones[c]))
            for c in range(len(values))
        ]).alias("f"),
    )
    return Factors(_divided(shifted, values), items, values)


def reconstruct(factors: Factors, pairs: DataFrame, fill: bool = False) -> DataFrame:
    """Cells of the rank-k matrix for the given pairs: ``user, item, score``.

    Users and items without any rating have no factors; ``fill`` gives their cells as zeros.
    """
    left = factors.users.select("user", scale_by(F.col("f"), factors.values).alias("uf"))
    right = factors.items.select("item", F.col("f").alias("vf"))
    how = "left" if fill else "inner"
    score = dot(F.col("uf"), F.col("vf"))
    return (
        pairs.select("user", "item").join(left, "user", how).join(right, "item", how)
        .select("user", "item", (F.coalesce(score, F.lit(0.0)) if fill else score).alias("score"))
    )


def item_features(factors: Factors, weighted: bool = False) -> DataFrame:
    """Item vectors, optionally times the root of the singular values: ``item, f``."""
    if not weighted:
        return factors.items
    return factors.items.select("item", scale_by(F.col("f"), [s**0.5 for s in factors.values]).alias("f"))


def unit_features(features: DataFrame) -> DataFrame:
    """Item vectors of length one; zero where there is no direction: ``item, f, z``."""
    norm = F.sqrt(dot(F.col("f"), F.col("f")))
    return features.withColumn("norm", norm).select(
        "item",
        F.transform("f", lambda x: F.when(F.col("norm") > ZERO_NORM, x / F.col("norm")).otherwise(0.0)).alias("f"),
        F.when(F.col("norm") > ZERO_NORM, 1.0).otherwise(0.0).alias("z"),
    )


def feature_cosine(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of the item vectors for given ``i, j`` pairs: ``i, j, sim``."""
    unit = unit_features(features)
    left = unit.select(F.col("item").alias("i"), F.col("f").alias("fi"))
    right = unit.select(F.col("item").alias("j"), F.col("f").alias("fj"))
    return pairs.join(left, "i").join(right, "j").select("i", "j", dot(F.col("fi"), F.col("fj")).alias("sim"))


def _gram(cells: DataFrame, **kernel) -> DataFrame:
    pairs = pair_products(cells, "user", "item", "rating", **kernel)
    diagonal = squared_norms(cells, "item", "rating").select("i", F.col("i").alias("j"), "dot")
    return stage(symmetric(pairs, "dot").union(diagonal), "gram")


def _project(cells: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Rating matrix times item factors: ``user, f``."""
    sums = [F.sum(F.col("rating") * F.col("f")[c]).alias(f"f{c}") for c in range(k)]
    return (
        cells.join(items, "item").groupBy("user").agg(*sums)
        .select("user", F.array(*[f"f{c}" for c in range(k)]).alias("f"))
    )


def _divided(vectors: DataFrame, values: list[float]) -> DataFrame:
    return vectors.select("user", scale_by(F.col("f"), [1.0 / s for s in values]).alias("f"))


def _leading(
    cells: DataFrame, basis: DataFrame | None, mixing: np.ndarray | None, k: int, direct_items: int, **kernel
) -> tuple[DataFrame, list[float]]:
    ids = cells.select("item") if basis is None else basis.select("item")
    ids = stage(ids.distinct(), "items")
    n = ids.count()
    if n <= direct_items:
        return _direct(_gram(cells, **kernel), basis, mixing, min(k, n))
    return _krylov(cells, ids, basis, mixing, min(k, n), n)


def _kept(eigenvalues: np.ndarray, k: int, scale: float) -> int:
    """How many leading eigenvalues are not rounding noise; ``scale`` is the size of what was added up."""
    if not len(eigenvalues) or eigenvalues[0] <= 1e-12 * scale:
        return 0
    return int((eigenvalues[:k] > 1e-12 * eigenvalues[0]).sum())


def _direct(gram, basis, mixing, k):
    """Solve a Gram matrix whose size has been checked."""
    spark = gram.sparkSession
    entries = gram.toPandas()
    ids = np.unique(entries["i"].to_numpy())
    if basis is not None:
        table = basis.toPandas().sort_values("item")
        ids = np.unique(table["item"].to_numpy())
    dense = np.zeros((len(ids), len(ids)))
    dense[np.searchsorted(ids, entries["i"]), np.searchsorted(ids, entries["j"])] = entries["dot"]
    scale = np.abs(dense).max(initial=0.0)
    if basis is not None:
        b = np.vstack(table["b"].to_numpy())
        dense += b @ mixing @ b.T
        scale += np.abs(b).max(initial=0.0) ** 2 * np.abs(mixing).max()
    eigenvalues, vectors = np.linalg.eigh(dense)
    eigenvalues, vectors = eigenvalues[::-1], vectors[:, ::-1]
    k = _kept(eigenvalues, k, scale)
    rows = [(int(item), row.tolist()) for item, row in zip(ids, vectors[:, :k])]
    return spark.createDataFrame(rows, "item long, f array<double>"), np.sqrt(eigenvalues[:k]).tolist()


def _krylov(cells, ids, basis, mixing, k, n):
    """Leading eigenvectors from a block Krylov basis ``item, f``, ``p`` columns more with every step."""
    p = min(k + OVERSAMPLE, n)
    block = ids.select(
        "item",
        F.array(*[(hash_percent("item", F.lit(c), seed=7) / 50.0 - 0.99).cast("double") for c in range(p)]).alias("f"),
    )
    block = _orthonormal(stage(block, "block"), p)
    for _ in range(STARTS):
        whole, width, last, added = block, p, block, p
        small = np.zeros((p, p))  # the Gram matrix on the basis
        while True:
            image = stage(_gram_times(cells, ids, basis, mixing, last, added), "image")
            both = whole.join(image.withColumnRenamed("f", "g"), "item")
            along = _cross(both, width, added)
            small[:, width - added :] = along
            # Twice, as one pass loses accuracy when the image lies mostly in the basis.
            rest = whole.join(_minus(both, along).withColumnRenamed("f", "g"), "item")
            fresh = stage(_minus(both, along + _cross(rest, width, added)), "fresh")
            whole_small = np.triu(small) + np.triu(small, 1).T if width > p else (small + small.T) / 2
            eigenvalues, rotation = np.linalg.eigh(whole_small)
            eigenvalues, rotation = eigenvalues[::-1], rotation[:, ::-1]
            left = _cross(fresh.withColumn("g", F.col("f")), added, added)
            tails = rotation[width - added :, :k]
            residuals = np.sqrt(np.maximum(np.einsum("ic,ij,jc->c", tails, left, tails), 0.0))
            scale = max(abs(eigenvalues[0]), 1e-300)
            done = bool((residuals <= TOLERANCE * scale).all())
            roots, turn = np.linalg.eigh((left + left.T) / 2)
            # Directions that have converged leave the block.
            live = roots > (TOLERANCE * scale) ** 2
            if done or not live.any() or width + live.sum() > min(max(BASIS, 3 * p), n):
                break
            added = int(live.sum())
            last = _times(fresh, turn[:, live] / np.sqrt(roots[live]))
            if roots[live].min() < 1e-10 * scale**2:
                both = whole.join(stage(last, "block").withColumnRenamed("f", "g"), "item")
                last = _orthonormal(stage(_minus(both, _cross(both, width, added)), "block"), added)
            whole = whole.join(last.withColumnRenamed("f", "g"), "item").select("item", F.concat("f", "g").alias("f"))
            whole = stage(whole, "basis")
            last = whole.select("item", F.slice("f", width + 1, added).alias("f"))
            grown = np.zeros((width + added, width + added))
            grown[:width, :width] = small
            small, width = grown, width + added
        keep = k if done else p
        block = stage(_times(whole, rotation[:, :keep]), "ritz")
        if done:
            k = _kept(eigenvalues, k, eigenvalues[0])
            return stage(_times(block, np.eye(keep)[:, :k]), "item_factors"), np.sqrt(eigenvalues[:k]).tolist()
        block = _orthonormal(block, p)
    raise ArithmeticError(f"the factors did not converge; residuals {residuals.tolist()} of {scale}")


def _gram_times(cells, ids, basis, mixing, block, p):
    """The Gram matrix times a block, through the ratings."""

    def summed(rows, key):
        sums = [F.sum(F.col("rating") * F.col("f")[c]).alias(f"f{c}") for c in range(p)]
        return rows.groupBy(key).agg(*sums).select(key, F.array(*[f"f{c}" for c in range(p)]).alias("f"))

    rated = cells.select("user", "item", "rating")
    people = summed(rated.join(block, "item"), "user")
    product = summed(rated.join(people, "user"), "item")
    if basis is None:
        return product
    small = mixing @ _basis_times(basis, block, p)
    zero = F.array(*[F.lit(0.0)] * p)

    def add(batches):
        for batch in batches:
            if len(batch):
                whole = np.vstack(batch["f"].to_numpy()) + np.vstack(batch["b"].to_numpy()) @ small
                yield pd.DataFrame({"item": batch["item"], "f": list(whole)})

    every = basis.join(product, "item", "left").select("item", "b", F.coalesce("f", zero).alias("f"))
    return every.mapInPandas(add, "item long, f array<double>")


def _minus(both: DataFrame, along: np.ndarray) -> DataFrame:
    """``g`` without its part along ``f``: ``item, f``."""

    def subtract(batches):
        for batch in batches:
            if len(batch):
                rest = np.vstack(batch["g"].to_numpy()) - np.vstack(batch["f"].to_numpy()) @ along
                yield pd.DataFrame({"item": batch["item"], "f": list(rest)})

    return both.mapInPandas(subtract, "item long, f array<double>")


def _basis_times(basis: DataFrame, block: DataFrame, p: int) -> np.ndarray:
    """Basis columns times a block of vectors, summed over items: a few numbers."""
    terms = [
        F.sum(F.col("b")[t] * F.col("f")[c]) for t in range(4) for c in range(p)
    ]
    return np.array(basis.join(block, "item").agg(*terms).first()).reshape(4, p)


def _cross(pairs: DataFrame, p: int, q: int) -> np.ndarray:
    """Sum over items of the outer product of ``f`` and ``g``: a (p x q) matrix."""

    def partial(batches):
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


def _times(block: DataFrame, matrix: np.ndarray) -> DataFrame:
    def multiply(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"item": batch["item"], "f": list(np.vstack(batch["f"].to_numpy()) @ matrix)})

    return block.mapInPandas(multiply, "item long, f array<double>")


def _orthonormal(block: DataFrame, p: int) -> DataFrame:
    """The same column space with orthonormal columns.

    Directions that have vanished are dropped to zero.  Done twice, because one
    pass loses accuracy when the columns are nearly parallel.
    """
    for _ in range(2):
        small = _cross(block.withColumn("g", F.col("f")), p, p)
        eigenvalues, vectors = np.linalg.eigh((small + small.T) / 2)
        live = eigenvalues > 1e-14 * eigenvalues[-1]
        inverse = np.where(live, 1.0 / np.sqrt(np.where(live, eigenvalues, 1.0)), 0.0)
        block = stage(_times(block, vectors * inverse), "block")
    return block
