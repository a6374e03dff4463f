import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ratingloom.operators import itemsets as sets
from ratingloom.operators import fpgrowth, vertical
from ratingloom.operators.fpgrowth import fp_itemsets
from ratingloom.sources import tables
from tests.conftest import BASKETS

AT_TWO = {
    (1,): 6, (2,): 7, (3,): 6, (4,): 2, (5,): 2,
    (1, 2): 4, (1, 3): 4, (1, 5): 2, (2, 3): 4, (2, 4): 2, (2, 5): 2,
    (1, 2, 3): 2, (1, 2, 5): 2,
}


def found(df):
    rows = df.collect()
    assert all(len(r["items"]) == r["size"] for r in rows)
    out = {tuple(r["items"]): r["freq"] for r in rows}
    assert len(out) == len(rows)
    return out


def brute(baskets, count):
    seen = {}
    for basket in baskets:
        for k in range(1, len(set(basket)) + 1):
            for combo in itertools.combinations(sorted(set(basket)), k):
                seen[combo] = seen.get(combo, 0) + 1
    return {k: v for k, v in seen.items() if v >= count}


@pytest.mark.parametrize("kernel", [{}, {"long_row": 2}])
def test_levels(baskets, kernel):
    cells = sets.basket_cells(baskets)
    assert found(sets.frequent_itemsets(cells, 2, **kernel)) == AT_TWO
    assert found(sets.frequent_itemsets(cells, 1, **kernel)) == brute(BASKETS, 1)
    levels = [found(x) for x in sets.apriori(cells, 2, max_iterations=3, **kernel)]
    assert [sorted({len(k) for k in x}) for x in levels] == [[1], [2]]
    assert list(sets.apriori(cells, 100, max_iterations=3)) == []
    assert found(sets.frequent_itemsets(cells, 100)) == {}


def test_pairs_are_strict(baskets):
    wanted = {k: v for k, v in AT_TWO.items() if v > 2 and len(k) <= 2}
    assert found(sets.frequent_pairs(sets.basket_cells(baskets), 2)) == wanted


def test_fp_growth(baskets):
    assert found(fp_itemsets(baskets, min_count=2)) == AT_TWO
    assert found(fp_itemsets(baskets, min_count=3)) == brute(BASKETS, 3)
    assert found(fp_itemsets(baskets, min_support=0.3)) == brute(BASKETS, 3)


def test_weighted(spark):
    rows = [(["b", "a"],), (["a", "b"],), (["b", "c"],), (["a"],)] * 3
    baskets = spark.createDataFrame(rows, "items array<string>")
    collapsed = {tuple(r["items"]): r["weight"] for r in sets.collapse_baskets(baskets).collect()}
    assert collapsed == {("a", "b"): 6, ("b", "c"): 3, ("a",): 3}
    mined = sets.weighted_itemsets(baskets, 0.3)
    assert found(mined) == {("a",): 9, ("b",): 9, ("c",): 3, ("a", "b"): 6, ("b", "c"): 3}
    assert {tuple(r["items"]): r["support"] for r in mined.collect()}[("a", "b")] == 0.5


def test_related(baskets):
    related = sets.related_items(sets.frequent_itemsets(sets.basket_cells(baskets), 2, 2))
    assert {r["item"]: r["related"] for r in related.collect()} == {
        1: [2, 3, 5], 2: [1, 3, 4, 5], 3: [1, 2], 4: [2], 5: [1, 2]
    }
    alone = sets.related_items(sets.frequent_itemsets(sets.basket_cells(baskets), 5))
    assert {r["item"]: r["related"] for r in alone.collect()} == {1: [], 2: [], 3: []}


def test_repeated_items(spark):
    twice = spark.createDataFrame([(0, [1, 1, 2])], "basket long, items array<int>")
    assert sets.basket_cells(twice).count() == 2
    with pytest.raises(PySparkException, match="repeated item"):
        sets.basket_cells(twice, "error").collect()
    with pytest.raises(PySparkException, match="repeated item"):
        fp_itemsets(twice, 0.1, duplicates="error").collect()


def test_support_rank(baskets):
    ranked = sets.support_rank(sets.item_frequency(sets.basket_cells(baskets)), start=1)
    assert {r["item"]: r["rank"] for r in ranked.collect()} == {2: 1, 1: 2, 3: 3, 4: 4, 5: 5}


def test_three_ways_agree(spark, sf):
    """Pairs job, level-wise mining and FP-growth on the order baskets."""
    baskets = tables.baskets_brand(spark, sf).cache()
    cells = sets.basket_cells(baskets)
    pairs = found(sets.frequent_pairs(cells, 5))
    levels = found(sets.frequent_itemsets(cells, 6))
    assert any(len(k) == 3 for k in levels)
    assert levels == found(fp_itemsets(baskets, min_count=6))
    assert pairs == {k: v for k, v in levels.items() if len(k) <= 2}
    assert levels == brute([r["items"] for r in baskets.collect()], 6)
    weighted = sets.weighted_itemsets(baskets, 6.5 / baskets.count())
    assert found(weighted) == levels


def test_one_basket_holds_a_third(spark):
    """A very long basket goes through the blocks and nothing is lost."""
    long = list(range(300))
    rows = [(0, long)] + [(b, [b % 300, (7 * b + 1) % 300, (3 * b + 2) % 300]) for b in range(1, 201)]
    baskets = spark.createDataFrame(rows, "basket long, items array<int>")
    pairs = sets.frequent_pairs(sets.basket_cells(baskets), 1, long_row=50, block_cols=40, block_rows=4)
    wanted = {k: v for k, v in brute_pairs(rows).items() if v > 1}
    assert found(pairs.filter(F.col("size") == 2)) == wanted


def brute_pairs(rows):
    seen = {}
    for _, basket in rows:
        for pair in itertools.combinations(sorted(set(basket)), 2):
            seen[pair] = seen.get(pair, 0) + 1
    return seen


def by_levels(spark, rows, least):
    """Level-wise mining of weighted baskets, items being their own numbers."""
    cells = spark.createDataFrame([(b, w, i) for b, (items, w) in enumerate(rows) for i in items], "basket long, weight long, item long")
    return {tuple(r["items"]): r.freq for r in sets.frequent_itemsets(cells, least).collect()}


def test_weighted_growth_agrees_with_levels(spark):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(120):
        items = np.flatnonzero(rng.random(14) < np.linspace(0.7, 0.05, 14)).tolist()
        rows.append((items, int(rng.integers(1, 9))))
    baskets = spark.createDataFrame(rows, "items array<long>, weight long").cache()
    for least, sizes in ((60, (500_000, 20)), (12, (200,))):
        wanted = by_levels(spark, rows, least)
        # Groups of any size, and ones that Spark has to split again and again.
        for cells in sizes:
            found = fpgrowth.weighted_fp(baskets, least, cells).collect()
            assert len(found) == len(wanted) and {tuple(r["items"]): r.freq for r in found} == wanted
            assert all(r["size"] == len(r["items"]) for r in found)


def test_one_very_long_basket_ends(spark):
    rng = np.random.default_rng(12)
    rows = [(list(range(5000)), 1)] + [(sorted(rng.choice(5000, 3, replace=False).tolist()), 2) for _ in range(300)]
    found = fpgrowth.weighted_fp(spark.createDataFrame(rows, "items array<long>, weight long"), 3, 20_000)
    wanted = {}
    for items, weight in rows[1:]:
        for mask in range(1, 8):
            part = tuple(x for k, x in enumerate(items) if mask >> k & 1)
            wanted[part] = wanted.get(part, 1) + weight  # the long basket has every set once
    assert {tuple(r["items"]): r.freq for r in found.collect()} == {k: v for k, v in wanted.items() if v >= 3}


def test_weighted_growth_of_nothing(spark):
    none = spark.createDataFrame([([], 3)], "items array<long>, weight long")
    assert fpgrowth.weighted_fp(none, 1).isEmpty() and fpgrowth.weighted_fp(none.limit(0), 1).isEmpty()
    assert sets.weighted_itemsets(spark.createDataFrame([], "items array<string>")).isEmpty()


def test_bitmaps_count_as_occurrences_do(spark, monkeypatch):
    rng = np.random.default_rng(13)
    held = rng.random((260, 10)) < np.linspace(0.8, 0.05, 10)
    rows = [(int(b) * 10**9, int(i)) for b, i in zip(*np.nonzero(held))]
    cells = spark.createDataFrame(rows, "basket long, item long").cache()
    wanted = {tuple(r["items"]): r.freq for r in sets.frequent_itemsets(cells, 30).collect()}
    assert max(map(len, wanted)) >= 4
    # In ranges of 64 baskets, and candidates in parts.
    monkeypatch.setattr(vertical.item_bitmaps, "__defaults__", (64, 500))
    monkeypatch.setattr(vertical.count_sets, "__defaults__", (20,))
    assert {tuple(r["items"]): r.freq for r in sets.frequent_itemsets(cells, 30, vertical=True).collect()} == wanted


def test_bitmaps_of_few_and_many_baskets():
    rng = np.random.default_rng(14)
    for baskets in (1, 63, 64, 1000):
        for share in (0.001, 0.05, 0.06, 0.07, 1.0):
            places = np.flatnonzero(rng.random(baskets) < share)
            words = vertical.bitmap(vertical.packed(places, baskets), baskets)
            assert len(words) == -(-baskets // 64) and np.bitwise_count(words).sum() == len(places)
            bits = np.unpackbits(words.view(np.uint8))
            assert np.flatnonzero(bits).tolist() == places.tolist()


def test_occurrences_in_short_and_long_baskets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(b, rng.choice(12, rng.integers(1, 9), replace=False).tolist()) for b in range(60)]
    cells = spark.createDataFrame([(b, i) for b, basket in rows for i in basket], "basket long, item long")
    cells = cells.union(spark.createDataFrame([(None, i) for i in range(4)], cells.schema))
    want = {k: n for k, n in brute([basket for _, basket in rows], 3).items()}
    for longest in (0, 4, 100):
        monkeypatch.setattr(sets, "LONG_BASKET", longest)
        got = {tuple(r["items"]): r["freq"] for r in sets.frequent_itemsets(cells, 3).filter("size > 1").collect()}
        assert got == {k: n for k, n in want.items() if len(k) > 1}


def test_what_a_short_basket_does_not_hold_is_not_shuffled(spark, baskets):
    kept = sets.basket_cells(baskets)
    grown = kept.select(F.array("item").alias("prefix"), "item", F.array("item", "item").alias("items")).limit(1)
    (found,) = sets._singly(kept)
    assert "rest" in found.columns
    plan = sets._occurrences(found, F.broadcast(grown), kept)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
