"""Best lists by bounds against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.operators import als
from ratingloom.operators.bounded import best_by_bound, best_lists
from ratingloom.operators.grid import best_unrated
from ratingloom.session import stage
from ratingloom.sources import tables


def model(spark, seed, users, items, ratio):
    rng = np.random.default_rng(seed)
    people, things = rng.normal(size=(users, 4)), rng.normal(size=(items, 4)) * rng.exponential(1, (items, 1))
    things[1::7] = things[0]  # ties go by item
    things[3] = 0
    if ratio:
        things /= np.maximum(np.linalg.norm(things, axis=1, keepdims=True), 1e-9)
    rows = [(u, float(rng.normal()), p.tolist(), 9.0 if ratio else 1.0, rng.normal(size=4).tolist() if ratio else None) for u, p in enumerate(people)]
    known = [(u, int(i)) for u in range(0, users, 2) for i in rng.choice(items, min(items, 9), replace=False)]
    return (
        spark.createDataFrame(rows, "user long, above double, above_f array<double>, below double, below_f array<double>"),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(things)], "item long, f array<double>"),
        spark.createDataFrame(known, "user long, item long"),
    )


def listed(df):
    return [(r["user"], r["rank"], r["item"], round(r["score"], 9)) for r in df.orderBy("user", "rank").collect()]


@pytest.mark.parametrize("ratio", [False, True])
@pytest.mark.parametrize("chunk", [32 << 20, 1500])
def test_lists_equal_all_scores(spark, ratio, chunk):
    users, items, known = model(spark, 1, 60, 150, ratio)
    for n in (3, 200) if chunk > 1500 else (5,):
        found = best_by_bound(users, items, known, n, block_items=16, chunk_bytes=chunk)
        assert listed(found) == listed(best_unrated(users, items, known, n))


def test_blocks_that_cannot_win_are_skipped(spark):
    users, items, known = model(spark, 2, 40, 2000, False)
    met = best_lists(users, items, known, 5, block_items=32).agg(F.avg("met")).first()[0]
    assert met < 0.35 * 2000
    # In chunks, users that are done are not read again.
    in_chunks = best_lists(users, items, known, 5, block_items=32, chunk_bytes=40 * 320)
    assert in_chunks.agg(F.avg("met")).first()[0] < 0.5 * 2000


def test_lists_of_als_factors(spark, sf):
    rated = stage(tables.ratings_part(spark, sf), "rated")
    fitted = als.train(rated, rank=4, iterations=3)
    users, items, known = als.sides(fitted, rated)
    assert listed(als.recommend(fitted, rated, 7)) == listed(best_unrated(users, items, known, 7))


def test_lists_of_nothing(spark):
    users, items, known = model(spark, 3, 3, 4, False)
    assert best_by_bound(users, items.limit(0), known, 3).isEmpty()
    assert best_by_bound(users.limit(0), items, known, 3).isEmpty()
    all_known = users.select("user").join(items.select("item"))
    assert best_by_bound(users, items, all_known, 3).isEmpty()
