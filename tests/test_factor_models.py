"""The factor models on a real catalogue and on degenerate matrices."""

import threading

import numpy as np
import pytest

from ratingloom.operators import gram, grid, svd, svdcf
from ratingloom.plans import jobs
from ratingloom.session import scratch_path, scratch_scope, stage
from ratingloom.sources import tables


def dense(cells):
    rows = cells.select("user", "item", "rating").collect()
    users, items = sorted({r.user for r in rows}), sorted({r.item for r in rows})
    u, i = {x: k for k, x in enumerate(users)}, {x: k for k, x in enumerate(items)}
    matrix = np.zeros((len(users), len(items)))
    for r in rows:
        matrix[u[r.user], i[r.item]] = r.rating
    return users, items, matrix


def test_iterated_factors_of_two_thousand_items(spark):
    rated = stage(tables.ratings_part(spark, "/root/testdata/sf0.01"), "part")
    users, items, matrix = dense(rated)
    left, values, right = np.linalg.svd(matrix, full_matrices=False)
    factors = svd.decompose(rated, 5, direct_items=0)
    assert np.allclose(factors.values, values[:5], rtol=1e-9)
    whole = (left[:, :5] * values[:5]) @ right[:5]
    found = svd.reconstruct(factors, rated.filter("user % 10 = 0").select("user", "item")).collect()
    u, i = {x: k for k, x in enumerate(users)}, {x: k for k, x in enumerate(items)}
    assert max(abs(r.score - whole[u[r.user], i[r.item]]) for r in found) < 1e-6


def normalised(matrix):
    rated = matrix > 0
    user, item = matrix.sum(1) / rated.sum(1), matrix.sum(0) / rated.sum(0)
    return np.where(rated, matrix, item[None, :]) - user[:, None]


@pytest.mark.parametrize("direct_items", [0, 1024])
def test_normalised_factors(spark, direct_items):
    rng = np.random.default_rng(4)
    rows = [(u, i, float(rng.integers(1, 6))) for u in range(60) for i in range(40) if rng.random() < 0.3 or i == u % 40]
    rated = spark.createDataFrame(rows, "user long, item long, rating double")
    _, _, matrix = dense(rated)
    values = np.linalg.svd(normalised(matrix), compute_uv=False)
    found = svd.decompose_normalised(rated, 4, direct_items)
    assert np.allclose(found.values, values[:4], rtol=1e-8)


@pytest.mark.parametrize("direct_items", [0, 1024])
def test_lower_rank_gives_fewer_factors(spark, direct_items):
    rows = [(u, i, float((u + 1) * (i + 1))) for u in range(6) for i in range(5)]
    factors = svd.decompose(spark.createDataFrame(rows, "user long, item long, rating double"), 3, direct_items)
    assert len(factors.values) == 1
    assert all(abs(r.score - (r.user + 1) * (r.item + 1)) < 1e-9 for r in svd.reconstruct(
        factors, spark.createDataFrame(rows, "user long, item long, rating double")).collect())


@pytest.mark.parametrize("direct_items", [0, 1024])
def test_constant_ratings_score_the_mean(spark, direct_items):
    rated = spark.createDataFrame([(u, i, 3.0) for u in range(4) for i in range(3)], "user long, item long, rating double")
    factors = svd.decompose_normalised(rated, 2, direct_items)
    assert factors.values == []
    assert {r.score for r in svdcf.predict_normalised(rated, rated, factors).collect()} == {3.0}


def test_dense_rows_keep_their_shape(spark, tmp_path):
    rows = ["1,2,0,4", "0,0,0,0", "5,6,0,8", "9,1,0,2"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(rows))
    jobs.reconstruct_dense_rows(spark, str(tmp_path / "in"), str(tmp_path / "out"), 4)
    found = {r.row: list(r["values"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(found) == [0, 1, 2, 3]
    for k, line in enumerate(rows):
        assert np.allclose(found[k], [float(x) for x in line.split(",")], atol=1e-9)


def test_near_ties_choose_by_item(spark):
    people = spark.createDataFrame([(1, 0.0, [1.0], 1.0, None, None)], "user long, above double, above_f array<double>, below double, below_f array<double>, x string").drop("x")
    things = spark.createDataFrame([(1, [1.00000049995]), (2, [1.0000008])], "item long, f array<double>")
    known = spark.createDataFrame([], "user long, item long")
    assert grid.best_unrated(people, things, known, 1).first().item == 1


def test_pair_sums_with_stored_zeros(spark):
    rng = np.random.default_rng(5)
    cells = [(r, c, float(rng.integers(0, 3))) for r in range(12) for c in range(20) if rng.random() < 0.6]
    df = spark.createDataFrame(cells, "user long, item long, rating double")
    by_join = {(r.i, r.j): r.dot for r in gram.pair_products(df, "user", "item", "rating").collect()}
    in_blocks = {}
    for share in (0.0, 1.1):
        gram._DENSE_SHARE, before = share, gram._DENSE_SHARE
        block = df.selectExpr("user r", "item c", "rating a", "rating b", "0 lo", "0 hi", "0 cb").toPandas()
        found = gram._multiply_block(block)
        gram._DENSE_SHARE = before
        in_blocks[share] = {(r.i, r.j): r.dot for r in found.itertuples()}
    assert by_join == in_blocks[0.0] == in_blocks[1.1]


def test_scopes_of_threads_are_apart(spark):
    seen = {}

    def other():
        with scratch_scope(spark):
            seen["other"] = stage(spark.range(3), "other").count()

    with scratch_scope(spark):
        mine = stage(spark.range(5), "mine")
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        assert mine.count() == 5 and seen["other"] == 3
    assert scratch_path(spark, "after") != scratch_path(spark, "after")
