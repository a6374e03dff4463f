"""The 6 x 4 example: values computed from the definitions with numpy."""

import numpy as np
import pytest

from ratingloom.operators import cells as cell_ops
from ratingloom.operators import itemcf, normalise, similarity, svd, svdcf, usercf
from tests.conftest import MATRIX

ITEM_COSINE = {(0, 1): 0.863209, (0, 2): 0.663602, (0, 3): 0.954128, (1, 2): 0.486531, (1, 3): 0.863209, (2, 3): 0.796322}
USER_COSINE = {
    (0, 1): 0.734847, (0, 2): 0.990148, (0, 3): 0.297044, (0, 4): 0.892607, (0, 5): 0.847319,
    (1, 2): 0.654846, (1, 3): 0.654846, (1, 4): 0.890190, (1, 5): 0.889499, (2, 3): 0.264706,
    (2, 4): 0.871187, (2, 5): 0.826985, (3, 4): 0.662860, (3, 5): 0.719117, (4, 5): 0.995568,
}
# (user, item): item CF, user CF, SVD item k=2, SVD normalised k=2
SCORES = {
    (0, 2): (5.000000, 4.208144, 5.000000, 4.836131),
    (1, 1): (4.072258, 4.241980, 4.325004, 3.951834),
    (2, 2): (3.300525, 4.217121, 3.181870, 3.666235),
    (3, 0): (3.919694, 4.667120, 3.719329, 4.343053),
    (3, 1): (3.887550, 4.218221, 3.534499, 4.678547),
}
NORMALISED = [
    [0.000000, 0.000000, -0.750000, 0.000000],
    [1.000000, 0.250000, -1.000000, 0.000000],
    [-0.333333, 0.666667, 0.916667, -0.333333],
    [0.600000, 0.250000, 1.000000, -1.000000],
    [0.500000, -0.500000, -0.500000, 0.500000],
    [0.250000, -0.750000, 0.250000, 0.250000],
]
RANK2 = [
    [5.288494, 5.162728, 0.214912, 4.459080],
    [3.276810, 1.902085, 3.740020, 3.805810],
    [3.532418, 3.547904, -0.133169, 2.898404],
    [1.147524, -0.641714, 4.947236, 2.384550],
    [5.072687, 3.663995, 3.788690, 5.313004],
    [5.108566, 3.401879, 4.616605, 5.582224],
]


def by_pair(df, value="score", keys=("user", "item")):
    return {(r[keys[0]], r[keys[1]]): r[value] for r in df.collect()}


def close(found, wanted):
    assert found.keys() == wanted.keys()
    for key in wanted:
        assert found[key] == pytest.approx(wanted[key], abs=2e-6), key


def column(n):
    return {k: v[n] for k, v in SCORES.items()}


def rmse_of(df):
    return df.first()["rmse"]


@pytest.mark.parametrize("kernel", [{}, {"long_row": 1}, {"long_row": 1, "block_cols": 1, "block_rows": 2}])
def test_cosines(ratings, kernel):
    close(by_pair(similarity.item_cosine(ratings, **kernel), "sim", ("i", "j")), ITEM_COSINE)
    close(by_pair(similarity.user_cosine(ratings, **kernel), "sim", ("i", "j")), USER_COSINE)


def test_means(ratings):
    users = {r["user"]: r["user_mean"] for r in cell_ops.user_means(ratings).collect()}
    items = {r["item"]: r["item_mean"] for r in cell_ops.item_means(ratings).collect()}
    assert [users[u] for u in range(6)] == pytest.approx([5, 4, 10 / 3, 4, 4.5, 4.75])
    assert [items[i] for i in range(4)] == pytest.approx([4.6, 4.25, 4.25, 25 / 6])


def test_item_cf(ratings, unrated):
    cosine = similarity.item_cosine(ratings)
    close(by_pair(itemcf.predict(unrated, ratings, cosine)), column(0))
    close(by_pair(itemcf.recommend(ratings, cosine)), column(0))
    assert rmse_of(itemcf.evaluate(ratings, ratings, cosine)) == pytest.approx(0.691302, abs=2e-6)


def test_user_cf(ratings, unrated):
    cosine = similarity.user_cosine(ratings)
    close(by_pair(usercf.predict(unrated, ratings, cosine)), column(1))
    close(by_pair(usercf.recommend(ratings, cosine)), column(1))
    assert rmse_of(usercf.evaluate(ratings, ratings, cosine)) == pytest.approx(0.983851, abs=2e-6)


@pytest.mark.parametrize("direct_items", [1024, 0])
def test_svd(ratings, unrated, direct_items):
    full = svd.decompose(ratings, 4, direct_items)
    assert full.values == pytest.approx([17.713921, 6.391671, 3.097961, 1.328978], abs=2e-6)
    factors = svd.decompose(ratings, 2, direct_items)
    whole = {(u, i): RANK2[u][i] for u in range(6) for i in range(4)}
    close(by_pair(svd.reconstruct(factors, ratings.union(unrated.selectExpr("*", "0D")))), whole)
    assert rmse_of(svdcf.evaluate_reconstruction(ratings, factors)) == pytest.approx(0.559750, abs=2e-6)

    cosine = {(0, 1): 0.873670, (0, 2): 0.064335, (0, 3): 0.894908, (1, 2): -0.429305, (1, 3): 0.564744, (2, 3): 0.502900}
    pairs = ratings.sparkSession.createDataFrame(list(cosine), "i long, j long")
    close(by_pair(svd.feature_cosine(svd.item_features(factors), pairs), "sim", ("i", "j")), cosine)

    close(by_pair(svdcf.predict_by_features(unrated, ratings, factors)), column(2))
    close(by_pair(svdcf.recommend_by_features(ratings, factors)), column(2))
    assert rmse_of(svdcf.evaluate_by_features(ratings, ratings, factors)) == pytest.approx(0.650723, abs=2e-6)


def test_normalised(ratings):
    close(by_pair(normalise.normalised_dense(ratings), "value"),
          {(u, i): NORMALISED[u][i] for u in range(6) for i in range(4)})
    close(by_pair(normalise.normalised_observed(ratings), "value"),
          {(u, i): NORMALISED[u][i] for u in range(6) for i in range(4) if MATRIX[u][i]})


@pytest.mark.parametrize("direct_items", [1024, 0])
def test_svd_normalised(ratings, unrated, direct_items):
    factors = svd.decompose_normalised(ratings, 2, direct_items)
    assert factors.values == pytest.approx([2.222309, 1.385483], abs=2e-6)
    close(by_pair(svdcf.predict_normalised(unrated, ratings, factors)), column(3))
    assert rmse_of(svdcf.evaluate_normalised(ratings, ratings, factors)) == pytest.approx(0.463135, abs=2e-6)


def test_discarded_singular_values(ratings, unrated):
    """The rank-k error is what the dropped singular values hold."""
    matrix = np.array(MATRIX, float)
    cells = ratings.union(unrated.selectExpr("*", "0D"))
    for k in (1, 2, 3):
        factors = svd.decompose(ratings, k)
        close_to = by_pair(svd.reconstruct(factors, cells))
        error = sum((matrix[u, i] - close_to[u, i]) ** 2 for u in range(6) for i in range(4))
        assert error == pytest.approx((np.linalg.svd(matrix)[1][k:] ** 2).sum(), abs=1e-6)
