"""Models on random and skewed data against direct evaluation."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.operators import als, gram, itemcf, product, similarity, svd, svdcf, usercf
from ratingloom.operators.grid import best_unrated
from ratingloom.sources import tables


def skewed(seed=3, users=30, items=20):
    """A sparse matrix with one user and one item that hold much of it."""
    rng = np.random.default_rng(seed)
    matrix = np.where(rng.random((users, items)) < 0.15, rng.integers(1, 6, (users, items)), 0).astype(float)
    matrix[0] = rng.integers(1, 6, items)
    matrix[:, 0] = rng.integers(1, 6, users)
    matrix[1, 0] = matrix[0, 1] = 0
    matrix[-1, 1:] = 0
    return matrix


@pytest.fixture(scope="module")
def matrix():
    return skewed()


@pytest.fixture(scope="module")
def cells(spark, matrix):
    rows = [(int(u), int(i), float(matrix[u, i])) for u, i in zip(*np.nonzero(matrix))]
    return spark.createDataFrame(rows, "user long, item long, rating double").cache()


@pytest.fixture(scope="module")
def every(spark, matrix):
    rows = [(u, i) for u in range(matrix.shape[0]) for i in range(matrix.shape[1])]
    return spark.createDataFrame(rows, "user long, item long").cache()


def cosine_of(vectors):
    norms = np.linalg.norm(vectors, axis=0)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 1e-9)
    cosine = unit.T @ unit
    np.fill_diagonal(cosine, 0)
    return cosine


def item_scores(matrix, cosine):
    weight = 0.5 + 0.5 * cosine
    return (matrix @ weight) / ((matrix != 0) @ weight)


def scores(df):
    return {(r["user"], r["item"]): r["score"] for r in df.collect()}


def best_of(matrix, wanted, n):
    lists = {}
    for u in range(matrix.shape[0]):
        free = [i for i in range(matrix.shape[1]) if matrix[u, i] == 0 and not np.isnan(wanted[u, i])]
        lists[u] = sorted(free, key=lambda i: (-round(wanted[u, i] + 1e-10, 6), i))[:n]
    return {u: items for u, items in lists.items() if items}


def lists(df):
    out = {}
    for r in df.orderBy("user", "rank").collect():
        out.setdefault(r["user"], []).append(r["item"])
    return out


@pytest.mark.parametrize("kernel", [{}, {"long_row": 3, "block_cols": 4, "block_rows": 4}])
def test_gram(matrix, cells, kernel):
    found = {(r["i"], r["j"]): r["dot"] for r in gram.pair_products(cells, "user", "item", "rating", **kernel).collect()}
    whole = matrix.T @ matrix
    wanted = {(i, j): whole[i, j] for i in range(20) for j in range(i + 1, 20) if whole[i, j]}
    assert found == pytest.approx(wanted)


def test_sparse_blocks():
    """The sparse and the dense product of a block agree."""
    rng = np.random.default_rng(0)
    r, c = np.nonzero(rng.random((40, 30)) < 0.2)
    v = rng.random(len(r))
    left = c < 15
    p, q, dot = gram._sparse_products(r[left], c[left], v[left], r[~left], c[~left] - 15, v[~left], 15)
    dense = np.zeros((40, 30))
    dense[r, c] = v
    wanted = dense[:, :15].T @ dense[:, 15:]
    found = np.zeros((15, 15))
    found[p, q] = dot
    assert found == pytest.approx(wanted)


@pytest.fixture(params=[True, False], ids=["blocks", "join"])
def way(request, monkeypatch):
    monkeypatch.setattr(product, "JOIN_LIMIT", -1)
    monkeypatch.setattr(product.Shape, "use_blocks", property(lambda self: request.param))


def test_item_cf(way, matrix, cells, every):
    cosine = similarity.item_cosine(cells, long_row=4)
    wanted = item_scores(matrix, cosine_of(matrix))
    found = scores(itemcf.predict(every, cells, cosine, cells_per_block=60, keys_per_block=8))
    assert found == pytest.approx({(u, i): wanted[u, i] for u, i in found})
    assert len(found) == matrix.size
    for n in (1, 4, 100):
        found = itemcf.recommend(cells, cosine, n, cells_per_block=60, keys_per_block=8)
        assert lists(found) == best_of(matrix, wanted, n)


def test_unknown_pairs_get_no_score(spark, way, cells):
    cosine = similarity.item_cosine(cells)
    strange = spark.createDataFrame([(0, 999), (999, 0)], "user long, item long")
    assert itemcf.predict(strange, cells, cosine).isEmpty()
    assert usercf.predict(strange, cells, similarity.user_cosine(cells)).isEmpty()


def test_user_cf(way, matrix, cells, every):
    cosine = cosine_of(matrix.T)
    weight = np.where(cosine != 0, 0.5 + 0.5 * cosine, 0.0)
    with np.errstate(invalid="ignore"):
        wanted = (weight @ matrix) / (weight @ (matrix != 0))
    table = similarity.user_cosine(cells, long_row=4)
    found = scores(usercf.predict(every, cells, table, cells_per_block=60, keys_per_block=8))
    assert found == pytest.approx({(u, i): wanted[u, i] for u, i in zip(*np.nonzero(~np.isnan(wanted)))})
    assert lists(usercf.recommend(cells, table, 5, cells_per_block=60, keys_per_block=8)) == best_of(matrix, wanted, 5)


def test_no_neighbour_means_no_score(spark, way):
    rows = [(0, 0, 3.0), (1, 1, 4.0), (2, 1, 5.0), (2, 2, 1.0)]
    alone = spark.createDataFrame(rows, "user long, item long, rating double")
    found = scores(usercf.recommend(alone, similarity.user_cosine(alone)))
    assert found == {(1, 2): 1.0}


def test_item_without_neighbour_is_still_offered(spark, way):
    rows = [(0, 0, 3.0), (1, 1, 4.0), (1, 2, 2.0)]
    alone = spark.createDataFrame(rows, "user long, item long, rating double")
    found = scores(itemcf.recommend(alone, similarity.item_cosine(alone)))
    assert found == pytest.approx({(0, 1): 3.0, (0, 2): 3.0, (1, 0): 3.0})


def test_ways_are_measured(cells):
    cosine = similarity.item_cosine(cells)
    left = cells.select("user", F.col("item").alias("k"))
    right = gram.symmetric(cosine, "sim").select(F.col("i").alias("k"), F.col("j").alias("item"))
    assert not product.measure(left, right).use_blocks
    shape = product.measure(left, right, join_limit=0)
    assert shape.joined_rows == left.join(right, "k").count()
    assert shape.block_rows == left.count() * shape.items.total + right.count() * shape.users.total
    one_each = product.measure(left, right, cells_per_block=1, keys_per_block=1, join_limit=0)
    assert not one_each.use_blocks


def test_svd_models(matrix, cells, every):
    k = 3
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    factors = svd.decompose(cells, k)
    wanted = item_scores(matrix, cosine_of(vt[:k]))
    found = scores(svdcf.predict_by_features(every, cells, factors))
    assert found == pytest.approx({(a, b): wanted[a, b] for a, b in found})
    assert lists(svdcf.recommend_by_features(cells, factors, 6)) == best_of(matrix, wanted, 6)

    means = np.array([row[row != 0].mean() for row in matrix])
    columns = np.array([col[col != 0].mean() for col in matrix.T])
    normal = np.where(matrix != 0, matrix, columns) - means[:, None]
    u, s, vt = np.linalg.svd(normal, full_matrices=False)
    low = (u[:, :k] * s[:k]) @ vt[:k]
    weight = 0.5 + 0.5 * cosine_of(np.sqrt(s[:k])[:, None] * vt[:k])
    wanted = means[:, None] + (low @ weight) / weight.sum(axis=0)
    found = scores(svdcf.predict_normalised(every, cells, svd.decompose_normalised(cells, k)))
    assert found == pytest.approx({(a, b): wanted[a, b] for a, b in found})
    assert len(found) == matrix.size


def test_grid_is_exact_across_blocks(spark):
    rng = np.random.default_rng(1)
    p, q = rng.standard_normal((23, 4)), rng.standard_normal((31, 4))
    users = spark.createDataFrame(
        [(u, 0.0, p[u].tolist(), 1.0, None) for u in range(23)],
        "user long, above double, above_f array<double>, below double, below_f array<double>",
    )
    items = spark.createDataFrame([(i, q[i].tolist()) for i in range(31)], "item long, f array<double>")
    known = spark.range(20).select(F.col("id").alias("user"), (F.col("id") % 31).alias("item"))
    matrix = np.zeros((23, 31))
    for u in range(20):
        matrix[u, u % 31] = 1
    found = best_unrated(users, items, known, 5, users_per_block=7, items_per_block=6)
    assert lists(found) == best_of(matrix, p @ q.T, 5)


def test_als(spark, sf):
    ratings = tables.ratings_brand(spark, sf).cache()
    model = als.train(ratings, rank=3, iterations=3)
    ranked = als.recommend(model, ratings, 4).cache()
    assert ranked.join(ratings, ["user", "item"]).isEmpty()
    assert ranked.groupBy("user").count().agg(F.max("count")).first()[0] == 4
    predicted = scores(als.predict(model, ranked))
    assert scores(ranked) == pytest.approx(predicted, rel=1e-5)
    explicit = als.train_and_evaluate(ratings, rank=3, iterations=3).first()["rmse"]
    implicit = als.train_and_evaluate(ratings, implicit=True, rank=3, iterations=3).first()["rmse"]
    assert 0 < explicit < 3 and 0 < implicit <= 1


def test_svd_without_arrow(spark, matrix, cells):
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        values = svd.decompose(cells, 3).singular_values().orderBy("f").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    assert [r["s"] for r in values] == pytest.approx(np.linalg.svd(matrix)[1][:3])


@pytest.mark.parametrize("offset", [0, 2**40])
def test_pairs_of_many_columns_are_added_up_where_they_are_made(spark, offset):
    rng = np.random.default_rng(3)
    kinds = [None, 0.0, -1.5, 2.0]
    rows = [(u, offset + int(i), kinds[(u + i) % 4], 1.0 + u) for u in range(300) for i in rng.choice(2000, 12, replace=False)]
    df = spark.createDataFrame([*rows, (None, offset, 1.0, 1.0), (1, None, 1.0, 1.0)], "user long, item long, rating double, w double")
    for weight in (None, "w"):
        pairs = gram.pair_products(df, "user", "item", "rating", weight=weight)
        assert "keys=[i#" not in pairs._jdf.queryExecution().executedPlan().toString()  # no pair is shuffled
        found = pairs.collect()
        expected = {}
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            for (_, i, a, w), (_, j, b, _) in itertools.combinations(sorted(group, key=lambda r: r[1]), 2):
                known = [] if a is None or b is None else [a * b * (w if weight else 1.0)]
                expected.setdefault((i, j), []).extend(known)
        assert len(found) == len(expected)
        assert {(r.i, r.j): r.dot for r in found} == pytest.approx({k: math.fsum(v) if v else None for k, v in expected.items()})


@pytest.mark.parametrize("offset", [0, -(2**40)])
def test_blocks_of_pairs_read_the_rows_from_where_they_are(spark, monkeypatch, offset):
    """However many blocks there are, rows are stored once: a block's plan has no shuffle."""
    monkeypatch.setattr(gram, "_PAIRS_PER_BLOCK", 500)
    monkeypatch.setattr(gram, "_CELLS_PER_CHUNK", 64)
    rng = np.random.default_rng(6)
    rows = [(u, offset + int(i), float(rng.integers(1, 9))) for u in range(150) for i in rng.choice(1500, 14, replace=False)]
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    pairs = gram.pair_products(df, "user", "item", "rating")
    assert pairs.rdd.getNumPartitions() > 20
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    found = pairs.collect()
    expected = {}
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        for (_, i, a), (_, j, b) in itertools.combinations(sorted(group), 2):
            expected[i, j] = expected.get((i, j), 0.0) + a * b
    assert len(found) == len(expected) and {(r.i, r.j): r.dot for r in found} == expected


def test_implicit_als_with_users_and_items_without_a_positive(spark):
    """Forty users that reject everything: their systems are singular, their factors zero."""
    likes = [(u, i, 1.0 + (u * i) % 3) for u in range(30) for i in range(12) if (u + i) % 4]
    rejects = [(u, i, -2.0) for u in range(30, 70) for i in range(u % 3, 13, 3)] + [(u, 12, -1.0) for u in range(5)]
    df = spark.createDataFrame([*likes, *rejects], "user long, item long, rating double")
    model = als.train(df, rank=10, iterations=8, implicit=True)
    plain = als.train(spark.createDataFrame(likes, df.schema), rank=10, iterations=8, implicit=True)
    kept = {r.id: list(r.features) for r in model.userFactors.collect()}
    assert len(kept) == 70 and all(not any(kept[u]) for u in range(30, 70))
    assert all(kept[r.id] == pytest.approx(list(r.features), abs=1e-4) for r in plain.userFactors.collect())
    assert not any({r.id: list(r.features) for r in model.itemFactors.collect()}[12])
    scores = als.predict(model, df)
    assert scores.count() == df.count() and scores.filter("user >= 30 and score <> 0").count() == 0
    assert len(lists(als.recommend(model, df, 3))) == 70


@pytest.mark.parametrize("size", [60, 10**6])
def test_user_predictions_by_lists(spark, monkeypatch, size):
    """Lists sent to blocks of users give what the join gives; busy users, long lists and null ratings included."""
    rng = np.random.default_rng(5)
    rows = [(u, i, None if (u + i) % 11 == 0 else float(rng.integers(1, 6))) for u in range(40) for i in range(25) if rng.random() < 0.2]
    rows += [(40, i, 2.0) for i in range(25)] + [(u, 25, 3.0) for u in range(40)] + [(41, 26, 4.0), (None, 3, 4.0), rows[0]]
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    table = similarity.user_cosine(df.dropna().dropDuplicates(["user", "item"]))
    wanted = df.select("user", "item").distinct()
    expected = scores(usercf._predict_by_join(wanted, df, table))
    monkeypatch.setattr(usercf, "MET_PER_BLOCK", size)
    monkeypatch.setattr(usercf, "LIST", 7)
    found = usercf._predict_by_lists(wanted, df, table, 10 * size)
    assert found.count() == len(expected)
    assert scores(found) == pytest.approx(expected)


@pytest.mark.parametrize("table", [10**6, 0], ids=["table", "search"])
@pytest.mark.parametrize("held", [40, 10**6])
def test_blocks_of_users_read_ratings_from_where_they_are(spark, monkeypatch, held, table):
    """Predictions and lists of blocks that read all ratings are those of the joins, and no rating is copied."""
    rng = np.random.default_rng(7)
    rows = [(u, i, float(rng.integers(1, 6))) for u in range(60) for i in range(50) if rng.random() < 0.15]
    rows += [(60, i, 2.0) for i in range(50)] + [(u, 50, 3.0) for u in range(60)] + [(61, 51, 4.0)]
    rows += [(62, 52, 5.0), (63, 52, -5.0)]  # a weight of zero
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    similar = similarity.user_cosine(df).cache()
    by_join = [(r.user, r["rank"], r.item, round(r.score, 9)) for r in usercf.recommend(df, similar, 7).collect()]
    wanted = df.select("user", "item").union(df.select((F.col("user") + 1).alias("user"), "item")).distinct()
    predicted = scores(usercf._predict_by_join(wanted, df, similar))
    for name, value in {"MOVED_LIMIT": 0, "HELD_PER_BLOCK": held, "LIST": 30, "_AT_ONCE": 50, "_TABLE": table}.items():
        monkeypatch.setattr(usercf, name, value)
    found = usercf.recommend(df, similar, 7, join_limit=0, cells_per_block=20, keys_per_block=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "collect_list" not in plan
    assert sorted((r.user, r["rank"], r.item, round(r.score, 9)) for r in found.collect()) == sorted(by_join)
    found = usercf._predict_by_lists(wanted, df, similar, 10**9)
    assert found.count() == len(predicted) and scores(found) == pytest.approx(predicted)


def test_pairs_of_long_rows_alike_are_not_shuffled(spark):
    rng = np.random.default_rng(4)
    matrix = rng.integers(1, 6, (5, 90)).astype(float)
    matrix[2, :3] = 0
    r, c = np.nonzero(matrix)
    df = spark.createDataFrame(list(zip(r.tolist(), c.tolist(), matrix[r, c].tolist())), "user long, item long, rating double")
    kernel = {"long_row": 30, "block_cols": 20}
    pairs = gram.pair_products(df, "user", "item", "rating", **kernel)
    assert "keys=[i#" not in pairs._jdf.queryExecution().executedPlan().toString()
    found, whole = pairs.collect(), matrix.T @ matrix
    assert len(found) == 90 * 89 // 2 and all(x.i < x.j and x.dot == pytest.approx(whole[x.i, x.j]) for x in found)
    mixed = df.union(spark.createDataFrame([(9, 1, 2.0), (9, 3, 2.0)], df.schema))
    found = {(x.i, x.j): x.dot for x in gram.pair_products(mixed, "user", "item", "rating", **kernel).collect()}
    assert len(found) == 90 * 89 // 2 and found[1, 3] == pytest.approx(whole[1, 3] + 4)


def test_strips_of_long_rows_are_read_from_where_they_are(spark):
    rng = np.random.default_rng(8)
    rows = [(r, int(c), None if (r + c) % 50 == 0 else float(rng.integers(0, 4)), 1.0 + r) for r in range(4) for c in rng.choice(400, 300, replace=False)]
    df = spark.createDataFrame(rows, "user long, item long, rating double, w double")
    for weight in (None, "w"):
        pairs = gram.pair_products(df, "user", "item", "rating", weight=weight, long_row=100, block_cols=20)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "other" not in plan  # no cell goes to every other block
        assert pairs.rdd.getNumPartitions() == 4
        found = {(x.i, x.j): x.dot for x in pairs.collect()}
        flat = gram._summed(gram._block_pairs(
            df.selectExpr("user as r", "item as c", "rating as a", f"rating * {'w' if weight else 1} as b").withColumn("n", F.lit(300)), 20, 1))
        expected = {(x.i, x.j): x.dot for x in flat.collect()}
        assert found.keys() == expected.keys() and found == pytest.approx(expected)


def test_blocks_get_lists_of_cells(spark, cells):
    """What is copied to every opposite block are lists; scores are those of single cells, nulls left out alike."""
    table = similarity.user_cosine(cells)
    left, right = usercf._product_sides(cells, table)
    offsets = cells.groupBy("user").agg(F.sum("rating").alias("above"), F.lit(2.0).alias("below"))
    shape = product.measure(left, right, join_limit=0, keys_per_block=8)
    assert shape.users.total > 1 and shape.items.total > 1
    for own in (None, offsets):
        known = cells.select("user", "item")
        found = product.wanted_by_blocks(left, right, own, known, shape)
        assert "collect_list" in found._jdf.queryExecution().executedPlan().toString()
        flat = product._met(*product._squares(left, right, own, known, shape), "_parts = 1", product._wanted_of_block, product._SCORES)
        assert scores(found) == pytest.approx(scores(flat))
