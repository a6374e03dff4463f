"""Bidiagonalisation against numpy."""

import numpy as np

from ratingloom.operators import lanczos, svd
from ratingloom.session import stage


def cells_of(spark, matrix):
    rows = [(int(u), int(i), float(matrix[u, i])) for u, i in zip(*np.nonzero(matrix))]
    return stage(spark.createDataFrame(rows, "user long, item long, rating double"), "cells")


def plain(spark, matrix):
    cells = cells_of(spark, matrix)
    users = spark.createDataFrame([(u, 0.0) for u in range(matrix.shape[0])], "user long, m double")
    items = spark.createDataFrame([(i, 0.0) for i in range(matrix.shape[1])], "item long, m double")
    return lanczos.Matrix(cells, users, items)


def rows_of(df, key):
    found = {r[key]: r["f"] for r in df.collect()}
    return np.array([found[k] for k in sorted(found)])


def test_small_singular_values(spark):
    """Values down to 1e-8 of the leading one, which the root of a squared matrix would lose."""
    rng = np.random.default_rng(1)
    left, right = np.linalg.qr(rng.normal(size=(70, 30)))[0], np.linalg.qr(rng.normal(size=(45, 30)))[0]
    wanted = np.logspace(0, -8, 30)
    matrix = (left * wanted) @ right.T
    factors = svd.bidiagonalised(cells_of(spark, matrix), 30)
    assert np.allclose(factors.values, wanted, rtol=0, atol=1e-12)
    assert np.allclose(factors.values, wanted, rtol=1e-5)
    users, items = rows_of(factors.users, "user"), rows_of(factors.items, "item")
    assert np.allclose(users.T @ users, np.eye(30), atol=1e-10) and np.allclose(items.T @ items, np.eye(30), atol=1e-10)
    assert np.allclose((users * factors.values) @ items.T, matrix, atol=1e-12)


def test_narrow_bases_are_turned_and_go_on(spark):
    rng = np.random.default_rng(2)
    left, right = np.linalg.qr(rng.normal(size=(60, 40)))[0], np.linalg.qr(rng.normal(size=(50, 40)))[0]
    wanted = 0.6 ** np.arange(40)
    matrix = (left * wanted) @ right.T
    users, items, values = lanczos.leading(plain(spark, matrix), 3, 1e-11, block=8, most=20)
    assert np.allclose(values, wanted[:3], rtol=1e-11)
    low = (rows_of(users, "user") * values) @ rows_of(items, "item").T
    assert np.allclose(low, (left[:, :3] * wanted[:3]) @ right[:, :3].T, atol=1e-8)


def test_rank_beyond_the_matrix_and_zero(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(12, 2)) @ rng.normal(size=(2, 9))
    _, _, values = lanczos.leading(plain(spark, matrix), 7, 1e-11)
    assert np.allclose(values, np.linalg.svd(matrix, compute_uv=False)[:2])
    none = spark.createDataFrame([(0, 0, 0.0)], "user long, item long, rating double")
    people = spark.createDataFrame([(0, 0.0), (1, 0.0)], "user long, m double")
    things = spark.createDataFrame([(0, 0.0)], "item long, m double")
    users, items, values = lanczos.leading(lanczos.Matrix(none, people, things), 2, 1e-11)
    assert values == [] and users.count() == 2 and items.count() == 1


def test_partition_factors_combine(spark):
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(500, 6)) @ np.diag([1, 1, 1e-3, 1e-6, 1e-9, 1e-12]) @ rng.normal(size=(6, 6))
    block = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(matrix)], "user long, f array<double>").repartition(7)
    basis, terms = lanczos.orthonormal(block, "user", 6, 1e-14)
    q = rows_of(basis, "user")
    assert np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-12)
    assert np.allclose(q @ terms, matrix, atol=1e-13)


def test_normalised_matrix_is_not_written_out(spark):
    rng = np.random.default_rng(5)
    matrix = np.where(rng.random((30, 20)) < 0.4, rng.integers(1, 6, (30, 20)), 0).astype(float)
    matrix[:, 0] = matrix[0] = 3
    rated = matrix > 0
    means, columns = matrix.sum(1) / rated.sum(1), matrix.sum(0) / rated.sum(0)
    wanted = np.linalg.svd(np.where(rated, matrix, columns) - means[:, None], compute_uv=False)
    factors = svd.bidiagonalised_normalised(cells_of(spark, matrix), 4)
    assert np.allclose(factors.values, wanted[:4], rtol=1e-10)
    constant = cells_of(spark, np.full((4, 3), 3.0))
    assert svd.bidiagonalised_normalised(constant, 2).values == []
