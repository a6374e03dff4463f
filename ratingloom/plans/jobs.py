"""Jobs from text files to text files.  Each error measure is returned as a number."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.operators import als, cells, index, itemcf, itemsets, sampling, similarity, svd, svdcf, usercf
from ratingloom.operators.fpgrowth import fp_itemsets
from ratingloom.operators.grid import grid_pairs
from ratingloom.operators.rank import TOP
from ratingloom.session import scratch_scope, stage
from ratingloom.sinks import text as out
from ratingloom.sources import text as src


def job(function: Callable) -> Callable:
    """A job leaves nothing behind in the scratch folder."""

    @wraps(function)
    def run(spark: SparkSession, *args, **kwargs):
        with scratch_scope(spark):
            return function(spark, *args, **kwargs)

    return run


def _cells(spark: SparkSession, path: str) -> DataFrame:
    return stage(cells.rating_cells(src.read_ratings(spark, path)), "cells")


def _error(table: DataFrame) -> float:
    return table.first()["rmse"]


@job
def recommend_by_items(spark: SparkSession, train: str, output: str, n: int = TOP) -> None:
    """Item-based lists."""
    rated = _cells(spark, train)
    ranked = itemcf.recommend(rated, similarity.ItemCosine(rated), n)
    out.write_lines(out.recommendation_lines(ranked), output)


@job
def test_by_items(spark: SparkSession, train: str, test: str) -> float:
    """Item-based RMSE."""
    rated = _cells(spark, train)
    return _error(itemcf.evaluate(rated, src.read_ratings(spark, test), stage(similarity.item_cosine(rated), "cosine")))


@job
def recommend_by_users(spark: SparkSession, train: str, output: str, n: int = TOP) -> None:
    """User-based lists."""
    rated = _cells(spark, train)
    ranked = usercf.recommend(rated, stage(similarity.user_cosine(rated), "cosine"), n)
    out.write_lines(out.recommendation_lines(ranked), output)


@job
def test_by_users(spark: SparkSession, train: str, test: str) -> float:
    """User-based RMSE."""
    rated = _cells(spark, train)
    return _error(usercf.evaluate(rated, src.read_ratings(spark, test), stage(similarity.user_cosine(rated), "cosine")))


@job
def recommend_by_svd(spark: SparkSession, train: str, output: str, k: int, n: int = TOP) -> None:
    """Item-based lists with similarity from SVD factors."""
    rated = _cells(spark, train)
    ranked = svdcf.recommend_by_features(rated, svd.decompose(rated, k), n)
    out.write_lines(out.recommendation_lines(ranked), output)


@job
def test_by_svd(spark: SparkSession, train: str, test: str, k: int) -> float:
    """RMSE of item-based scores with similarity from SVD factors."""
    rated = _cells(spark, train)
    return _error(svdcf.evaluate_by_features(rated, src.read_ratings(spark, test), svd.decompose(rated, k)))


@job
def test_by_normalised_svd(spark: SparkSession, train: str, test: str, k: int) -> float:
    """RMSE of scores from the SVD of the mean-normalised matrix."""
    rated = _cells(spark, train)
    factors = svd.decompose_normalised(rated, k)
    return _error(svdcf.evaluate_normalised(rated, src.read_ratings(spark, test), factors))


@job
def test_by_reconstruction(spark: SparkSession, train: str, test: str, k: int) -> float:
    """RMSE of the rank-k matrix."""
    rated = _cells(spark, train)
    return _error(svdcf.evaluate_reconstruction(src.read_ratings(spark, test), svd.decompose(rated, k)))


@job
def decompose_sparse_rows(spark: SparkSession, path: str, output: str, k: int) -> list[float]:
    """SVD of a matrix in sparse row text; factors are saved, singular values returned."""
    rows = src.read_sparse_rows(spark, path).selectExpr("row AS user", "bigint(col) AS item", "value AS rating")
    factors = svd.decompose(stage(cells.rating_cells(rows), "cells"), k)
    factors.users.write.parquet(f"{output}/users")
    factors.items.write.parquet(f"{output}/items")
    factors.singular_values().write.parquet(f"{output}/values")
    return factors.values


@job
def reconstruct_dense_rows(spark: SparkSession, path: str, output: str, k: int) -> None:
    """The rank-k matrix of a matrix in dense row text, as rows of values; as many rows and columns as the text has."""
    lines = src.read_dense_rows(spark, path)
    rated = stage(src.dense_cells(lines).selectExpr("row AS user", "bigint(col) AS item", "value AS rating"), "cells")
    width = lines.agg(F.max(F.size("values"))).first()[0] or 0
    every = grid_pairs(lines.select(F.col("row").alias("user")), spark.range(width).withColumnRenamed("id", "item"))
    out.dense_rows(svd.reconstruct(svd.decompose(rated, k), every, fill=True)).write.parquet(output)


@job
def recommend_by_als(
    spark: SparkSession, train: str, output: str, n: int = TOP, implicit: bool = False, **params
) -> None:
    """ALS lists."""
    rated = _cells(spark, train)
    rated = als.as_confidence(rated) if implicit else rated
    model = als.train(rated, implicit=implicit, **params)
    out.write_lines(out.recommendation_lines(als.recommend(model, rated, n)), output)


@job
def test_by_als(spark: SparkSession, ratings: str, implicit: bool = False, **params) -> float:
    """ALS RMSE on a held-out fifth."""
    return _error(als.train_and_evaluate(_cells(spark, ratings), implicit=implicit, **params))


@job
def mine_pairs(spark: SparkSession, baskets: str, output: str, min_count: int) -> None:
    """Frequent items and pairs, strictly more often than ``min_count``."""
    cells_ = itemsets.basket_cells(stage(src.read_baskets(spark, baskets), "baskets"))
    out.write_lines(out.itemset_lines(itemsets.frequent_pairs(cells_, min_count)), output)


@job
def mine_levels(spark: SparkSession, baskets: str, max_iterations: int, min_count: int, output: str) -> int:
    """Level-wise itemsets in one folder per size; returns the number of levels."""
    cells_ = itemsets.basket_cells(stage(src.read_baskets(spark, baskets), "baskets"))
    return out.write_levels(itemsets.apriori(cells_, min_count, max_iterations), output)


@job
def mine_fp_growth(
    spark: SparkSession, baskets: str, itemset_output: str, related_output: str,
    min_support: float, partitions: int | None = None,
) -> None:
    """FP-growth itemsets with counts, and the items related through them."""
    found = stage(fp_itemsets(src.read_baskets(spark, baskets, "string"), min_support, partitions=partitions), "itemsets")
    out.write_lines(out.counted_itemset_lines(found), itemset_output)
    out.write_lines(out.related_lines(itemsets.related_items(found)), related_output)


@job
def mine_weighted(spark: SparkSession, baskets: str, output: str, min_support: float = 0.3) -> None:
    """Itemsets with relative support from baskets with a leading id, by size."""
    found = itemsets.weighted_itemsets(src.read_baskets(spark, baskets, "string", leading_id=True), min_support)
    out.write_by_size(out.support_lines(found), output)


@job
def map_ids(spark: SparkSession, raw: str, output: str, train_rate: int, seed: int = sampling.SEED) -> None:
    """Dense ids by first appearance; train and test ratings and both id maps."""
    rows = stage(src.read_raw_ratings(spark, raw), "raw")
    users = stage(index.ids_by_first_seen(rows, "raw_user", src.RAW_POSITION), "users")
    items = stage(index.ids_by_first_seen(rows, "raw_item", src.RAW_POSITION), "items")
    mapped = index.encode(index.encode(rows, "raw_user", users, "user"), "raw_item", items, "item")
    training, testing = sampling.split_ratings(mapped, train_rate, seed)
    out.write_lines(out.rating_lines(training), f"{output}/training")
    out.write_lines(out.rating_lines(testing), f"{output}/testing")
    out.write_lines(out.id_map_lines(users), f"{output}/users")
    out.write_lines(out.id_map_lines(items), f"{output}/items")


@job
def sparse_matrix(spark: SparkSession, raw: str, output: str) -> None:
    """Raw ratings as sparse matrix rows; ids in sorted order, the last duplicate wins."""
    rows = stage(src.read_raw_ratings(spark, raw), "raw")
    users = index.ids_by_value(rows, "raw_user")
    items = index.ids_by_value(rows, "raw_item")
    mapped = index.encode(index.encode(rows, "raw_user", users, "user"), "raw_item", items, "item")
    last = cells.rating_cells(mapped.selectExpr("*", "struct(_file, _block, _line) AS at"), "last", "at", drop_zero=False)
    out.write_lines(out.sparse_row_lines(last).orderBy("user").select("value"), output)


@job
def sample_lines(
    spark: SparkSession, path: str, output: str, first: int, n: int,
    seed: int = sampling.SEED, check: bool = False,
) -> None:
    """``n`` of the first ``first`` lines in their original order."""
    lines = src.read_numbered_lines(spark, path)
    picked = sampling.sample_rows(lines, "pos", first, n, seed, check)
    out.write_lines(sampling.in_order(picked, "pos").select("value"), output)
