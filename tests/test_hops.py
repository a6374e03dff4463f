"""Item-based lists without a table of cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.operators import hops, itemcf, product, similarity
from ratingloom.plans import queries
from ratingloom.session import collected_scratch, stage

CELLS = "user long, item long, rating double"


def sparse(seed, users, items, share):
    rng = np.random.default_rng(seed)
    return np.where(rng.random((users, items)) < share, rng.integers(1, 6, (users, items)), 0).astype(float)


def cells_of(spark, matrix):
    rows = [(int(u) - 3, int(i) * 7 - 5, float(matrix[u, i])) for u, i in zip(*np.nonzero(matrix))]
    return stage(spark.createDataFrame(rows, CELLS), "cells")


def wanted(matrix, n):
    norms = np.linalg.norm(matrix, axis=0)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    weight = 0.5 + 0.5 * (unit.T @ unit)
    np.fill_diagonal(weight, 0.5)
    here = np.flatnonzero(norms)
    found = {}
    for u in np.flatnonzero(matrix.any(axis=1)):
        score = (matrix[u] @ weight) / ((matrix[u] != 0) @ weight)
        free = [(-round(score[i] + 1e-10, 6), i * 7 - 5) for i in here if not matrix[u, i]]
        found.update({(u - 3, k): (i, -s) for k, (s, i) in enumerate(sorted(free)[:n], 1)})
    return found


def lists(df):
    return {(r["user"], r["rank"]): (r["item"], round(r["score"] + 1e-10, 6)) for r in df.collect()}


@pytest.mark.parametrize("shape", [(30, 20, 0.3), (60, 300, 0.02), (20, 3000, 0.001)], ids=["dense", "sparse", "hardly any"])
@pytest.mark.parametrize("sizes", [{}, {"cells_per_piece": 40, "hops_per_block": 50}], ids=["one piece", "pieces"])
def test_lists_by_hops(spark, monkeypatch, shape, sizes):
    monkeypatch.setattr(hops, "_PRODUCTS_AT_ONCE", 7)
    matrix = sparse(5, *shape)
    matrix[0, ::3] = 4  # a long row and a long column
    matrix[::2, 0] = 2
    cells = cells_of(spark, matrix)
    measured = hops.measure_hops(cells)
    count = np.count_nonzero(matrix, axis=0)
    meets = (matrix != 0).T @ np.count_nonzero(matrix, axis=1)
    assert (measured.cells, measured.users) == (np.count_nonzero(matrix), np.count_nonzero(matrix.any(axis=1)))
    assert (measured.first, measured.products) == (count @ count, count @ meets)
    assert measured.joined == count @ np.minimum(meets, np.count_nonzero(count))
    for n in (1, 4, 100):
        assert lists(hops.best_by_hops(cells, measured, n, **sizes)) == wanted(matrix, n)


def test_odd_rows_as_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(product.Shape, "use_blocks", True)
    matrix = sparse(8, 25, 60, 0.1)
    rows = [(int(u), int(i), float(matrix[u, i])) for u, i in zip(*np.nonzero(matrix))]
    rows += [(3, 100, None), (4, 100, None), (None, 2, 5.0), (5, None, 4.0), (6, 101, 0.0), (7, 101, 0.0), (8, 102, -2.0), (9, 102, 3.0)]
    cells = stage(spark.createDataFrame(rows, CELLS), "cells")
    by_hops = hops.best_by_hops(cells, hops.measure_hops(cells), 500, cells_per_piece=50)
    by_blocks = itemcf.recommend(cells, similarity.item_cosine(cells), 500, join_limit=0)
    both = [{(r["user"], r["item"]): r["score"] for r in df.collect()} for df in (by_hops, by_blocks)]
    assert both[0] == pytest.approx(both[1]) and len(both[0]) > 1000
    assert {3, 4}.isdisjoint(u for u, _ in both[0]) and {5, 6, 7, 8} <= {u for u, _ in both[0]}
    nobody = cells.filter("user > 1000")
    assert hops.best_by_hops(nobody, hops.measure_hops(nobody)).isEmpty()
    alone = spark.createDataFrame([(1, 1, None), (2, 2, 3.0), (2, 3, 3.0)], CELLS)
    assert lists(hops.best_by_hops(alone, hops.measure_hops(alone))) == {(2, 1): (1, 3.0)}


def test_table_only_where_it_is_small(spark, monkeypatch):
    made = []
    monkeypatch.setattr(similarity.ItemCosine, "table", lambda self: made.append(1) or similarity.item_cosine(self.cells))
    matrix = sparse(6, 50, 400, 0.02)
    cells = cells_of(spark, matrix)
    assert lists(itemcf.recommend(cells, similarity.ItemCosine(cells), 5, join_limit=0)) == wanted(matrix, 5) and not made
    assert lists(itemcf.recommend(cells, similarity.ItemCosine(cells), 5)) == wanted(matrix, 5) and len(made) == 1
    # Through users who rated everything there would be far more products than pairs of items.
    crowd = np.ones((60, 4))
    full = cells_of(spark, crowd)
    assert itemcf.recommend(full, similarity.ItemCosine(full), 5, join_limit=0).isEmpty() and len(made) == 2


def test_parts_stage_no_pairs(spark, monkeypatch, tmp_path):
    """Nothing that the query stores has more rows than there are ratings."""
    monkeypatch.setattr(itemcf, "JOIN_LIMIT", 1000)
    matrix = sparse(7, 80, 500, 0.04)
    found = [(int(u), int(i), float(matrix[u, i])) for u, i in zip(*np.nonzero(matrix))]
    spark.createDataFrame([(u, u) for u in range(80)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.createDataFrame(found, "l_orderkey long, l_partkey long, l_quantity double").withColumn("l_quantity", F.col("l_quantity") * 10)
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    with collected_scratch() as folders:
        best = queries.itemcf_recommend_part(spark, str(tmp_path))
        assert best.count() == 80 * 100
    assert folders and max(spark.read.parquet(f).count() for f in folders) <= len(found)
    assert lists(best) == {(u + 3, rank): ((i + 5) // 7, score) for (u, rank), (i, score) in wanted(matrix, 100).items()}


def test_pieces_and_blocks_are_small_in_a_task(spark):
    """Pieces pass as slices of which ten thousand, a batch, are 16 MB; a task's arrays stay below 300 MB."""
    rows = [(u, i, 1.0 + (u * i) % 97 / 7) for u in range(300) for i in range(u % 7, 700, 7)]
    slices = hops._pieces(stage(spark.createDataFrame(rows, CELLS), "cells"), 2)
    assert slices.count() > 20 and slices.agg(F.max(F.length("data"))).first()[0] <= 1600
    assert 40 * hops.HOPS_PER_BLOCK + 60 * hops.CELLS_PER_PIECE < 300e6
