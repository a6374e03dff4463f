"""The registered queries: each takes a session and a table folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.functions.basket import joined
from ratingloom.functions.numeric import stable_round
from ratingloom.operators import (
    als, cells, gram, index, itemcf, itemsets, neighbours, normalise, sampling, similarity, svd, svdcf, usercf,
)
from ratingloom.operators.fpgrowth import fp_itemsets
from ratingloom.operators.grid import grid_pairs
from ratingloom.plans import jobs
from ratingloom.session import scratch_path, stage
from ratingloom.sinks import text as out
from ratingloom.sources import tables
from ratingloom.sources import text as src

Query = Callable[[SparkSession, str], DataFrame]

RANK = 5
PAIR_SUPPORT = 0.01
TRIPLE_SUPPORT = 0.002
RELATED_SUPPORT = 0.03

_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name."""
    _REGISTRY[function.__name__] = function
    return function


def registered() -> dict[str, Query]:
    """All queries by name."""
    return dict(_REGISTRY)


def _brand(spark: SparkSession, sf: str) -> DataFrame:
    return stage(tables.ratings_brand(spark, sf), "ratings_brand")


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return stage(tables.ratings_part(spark, sf), "ratings_part")


def _supplier(spark: SparkSession, sf: str) -> DataFrame:
    return stage(tables.ratings_supplier(spark, sf), "ratings_supplier")


def _basket_cells(spark: SparkSession, sf: str) -> DataFrame:
    return stage(tables.basket_cells_brand(spark, sf), "basket_cells")


def _count(spark: SparkSession, sf: str, share: float) -> int:
    """A basket count as a share of all orders that have lines."""
    baskets = tables.table(spark, sf, "lineitem").select("l_orderkey").distinct().count()
    return int(baskets * share)


def _item_model(rated: DataFrame) -> DataFrame:
    """The similarity table is the model: stored once, its size known to the joins."""
    return stage(similarity.item_cosine(rated), "cosine")


def _user_model(rated: DataFrame) -> DataFrame:
    return stage(similarity.user_cosine(rated), "cosine")


def _scores(df: DataFrame) -> DataFrame:
    return df.withColumn("score", stable_round(F.col("score")))


def _sims(df: DataFrame) -> DataFrame:
    return df.withColumn("sim", stable_round(F.col("sim")))


def _values(df: DataFrame) -> DataFrame:
    return df.withColumn("value", stable_round(F.col("value")))


def _error(df: DataFrame) -> DataFrame:
    return df.withColumn("rmse", stable_round(F.col("rmse")))


def _sets(df: DataFrame, *more: Column | str) -> DataFrame:
    return df.select(joined(F.col("items")).alias("items"), "size", "freq", *more)


# --- itemsets ---------------------------------------------------------------


@query
def apriori_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _sets(itemsets.frequent_pairs(_basket_cells(spark, sf), _count(spark, sf, PAIR_SUPPORT)))


def _level(spark: SparkSession, sf: str, size: int, **how) -> DataFrame:
    levels = itemsets.apriori(_basket_cells(spark, sf), _count(spark, sf, TRIPLE_SUPPORT), size + 1, **how)
    found = list(levels)
    # Levels end with the last that has a set.
    return _sets(found[size - 1] if size <= len(found) else found[-1].filter("false"))


@query
def apriori_level1(spark: SparkSession, sf: str) -> DataFrame:
    return _level(spark, sf, 1)


@query
def apriori_level2(spark: SparkSession, sf: str) -> DataFrame:
    return _level(spark, sf, 2)


@query
def apriori_level3(spark: SparkSession, sf: str) -> DataFrame:
    return _level(spark, sf, 3)


@query
def apriori_level3_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    """The same, counted on bitmaps of baskets."""
    return _level(spark, sf, 3, vertical=True)


@query
def fp_itemsets_all(spark: SparkSession, sf: str) -> DataFrame:
    return _sets(fp_itemsets(tables.baskets_brand(spark, sf), TRIPLE_SUPPORT))


@query
def fp_itemsets_by_count(spark: SparkSession, sf: str) -> DataFrame:
    baskets = stage(tables.baskets_brand(spark, sf), "baskets")
    return _sets(fp_itemsets(baskets, min_count=_count(spark, sf, PAIR_SUPPORT)))


@query
def itemsets_by_size(spark: SparkSession, sf: str) -> DataFrame:
    found = fp_itemsets(tables.baskets_brand(spark, sf), TRIPLE_SUPPORT)
    return found.groupBy("size").agg(F.count(F.lit(1)).alias("itemsets"))


@query
def fp_weighted_support(spark: SparkSession, sf: str) -> DataFrame:
    found = itemsets.weighted_itemsets(tables.baskets_brand(spark, sf), PAIR_SUPPORT)
    return _sets(found, stable_round(F.col("support")).alias("support"))


@query
def related_items(spark: SparkSession, sf: str) -> DataFrame:
    found = stage(fp_itemsets(tables.baskets_brand(spark, sf), PAIR_SUPPORT), "itemsets")
    return itemsets.partners(found)


@query
def related_item_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = stage(fp_itemsets(tables.baskets_brand(spark, sf), RELATED_SUPPORT), "itemsets")
    return out.related_lines(itemsets.related_items(found))


@query
def basket_weights(spark: SparkSession, sf: str) -> DataFrame:
    collapsed = itemsets.collapse_baskets(tables.baskets_brand(spark, sf))
    return collapsed.select(joined(F.col("items")).alias("items"), "weight")


@query
def item_support_rank(spark: SparkSession, sf: str) -> DataFrame:
    return itemsets.support_rank(itemsets.item_frequency(tables.basket_cells_brand(spark, sf)), start=1)


# --- rating preparation -----------------------------------------------------


@query
def rating_profile(spark: SparkSession, sf: str) -> DataFrame:
    return cells.rating_profile(_part(spark, sf))


@query
def user_mean(spark: SparkSession, sf: str) -> DataFrame:
    means = cells.user_means(tables.ratings_part(spark, sf))
    return means.withColumn("user_mean", stable_round(F.col("user_mean")))


@query
def item_mean(spark: SparkSession, sf: str) -> DataFrame:
    means = cells.item_means(tables.ratings_part(spark, sf))
    return means.withColumn("item_mean", stable_round(F.col("item_mean")))


@query
def matrix_width(spark: SparkSession, sf: str) -> DataFrame:
    return cells.matrix_width(tables.ratings_part(spark, sf))


@query
def transposed_ratings(spark: SparkSession, sf: str) -> DataFrame:
    swapped = cells.transpose(tables.ratings_part(spark, sf))
    return swapped.withColumn("rating", stable_round(F.col("rating")))


@query
def implicit_ratings(spark: SparkSession, sf: str) -> DataFrame:
    shifted = als.as_confidence(tables.ratings_brand(spark, sf))
    return shifted.withColumn("rating", stable_round(F.col("rating")))


def _line_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return tables.raw_ratings(spark, sf).select(
        F.substring("raw_user", 2, 20).cast("long").alias("user"), F.col("l_partkey").alias("item"),
        "rating", "l_orderkey", "l_linenumber",
    )


@query
def duplicates_averaged(spark: SparkSession, sf: str) -> DataFrame:
    merged = cells.rating_cells(_line_ratings(spark, sf))
    return merged.withColumn("rating", stable_round(F.col("rating")))


@query
def duplicates_last(spark: SparkSession, sf: str) -> DataFrame:
    merged = cells.rating_cells(
        _line_ratings(spark, sf), "last", F.struct("l_orderkey", "l_linenumber", "rating"), drop_zero=False
    )
    return merged.withColumn("rating", stable_round(F.col("rating")))


@query
def id_map_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return index.ids_by_value(tables.raw_ratings(spark, sf), "raw_user")


@query
def id_map_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return index.ids_by_first_seen(tables.raw_ratings(spark, sf), "raw_item", ["l_orderkey", "l_linenumber"])


@query
def mapped_ratings(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(tables.raw_ratings(spark, sf), "raw")
    position = ["l_orderkey", "l_linenumber"]
    users = index.ids_by_first_seen(rows, "raw_user", position)
    items = index.ids_by_first_seen(rows, "raw_item", position)
    mapped = index.encode(index.encode(rows, "raw_user", users, "user"), "raw_item", items, "item")
    return mapped.select("l_orderkey", "l_linenumber", "user", "item", stable_round(F.col("rating")).alias("rating"))


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return sampling.split_ratings(tables.ratings_part(spark, sf), 90)


@query
def split_train(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf)[0].withColumn("rating", stable_round(F.col("rating")))


@query
def split_test(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf)[1].withColumn("rating", stable_round(F.col("rating")))


@query
def sample_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A fiftieth of the first half of the lines."""
    lines = index.dense_index(
        tables.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey"),
        ["l_orderkey", "l_linenumber", "l_partkey"], "pos",
    )
    first = tables.table(spark, sf, "lineitem").count() // 2
    return sampling.in_order(sampling.sample_rows(lines, "pos", first, first // 50), "pos")


@query
def sparse_rows_text(spark: SparkSession, sf: str) -> DataFrame:
    last = cells.rating_cells(
        _line_ratings(spark, sf), "last", F.struct("l_orderkey", "l_linenumber", "rating"), drop_zero=False
    )
    return out.sparse_row_lines(last)


# --- neighbourhood models ---------------------------------------------------


@query
def item_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _sims(similarity.item_cosine(_brand(spark, sf)))


@query
def item_cosine_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return _sims(similarity.item_cosine(_part(spark, sf)))


@query
def item_gram(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    pairs = gram.pair_products(rated, "user", "item", "rating")
    return pairs.withColumn("dot", F.round(F.col("dot") + 1e-6, 3))


@query
def user_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _sims(similarity.user_cosine(_supplier(spark, sf)))


@query
def user_cosine_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Every brand is bought by most customers, so all rows are long ones."""
    return _sims(similarity.user_cosine(_brand(spark, sf)))


@query
def user_similarity_table(spark: SparkSession, sf: str) -> DataFrame:
    return _sims(similarity.similarity_table(similarity.user_cosine(_supplier(spark, sf))))


@query
def itemcf_predict(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    return _scores(itemcf.predict(rated, rated, _item_model(rated)))


@query
def itemcf_recommend(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    return _scores(itemcf.recommend(rated, _item_model(rated)))


@query
def itemcf_recommend_part(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of a hundred from a catalogue of all parts."""
    rated = _part(spark, sf)
    return _scores(itemcf.recommend(rated, similarity.ItemCosine(rated)))


@query
def itemcf_recommend_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same, computed in blocks however small the tables are."""
    rated = _brand(spark, sf)
    return _scores(itemcf.recommend(rated, _item_model(rated), join_limit=0))


@query
def itemcf_rmse(spark: SparkSession, sf: str) -> DataFrame:
    training, test = sampling.split_ratings(_brand(spark, sf), 80)
    return _error(itemcf.evaluate(training, test, _item_model(training)))


@query
def usercf_predict(spark: SparkSession, sf: str) -> DataFrame:
    rated = _supplier(spark, sf)
    return _scores(usercf.predict(rated, rated, _user_model(rated)))


@query
def usercf_recommend(spark: SparkSession, sf: str) -> DataFrame:
    rated = _supplier(spark, sf)
    return _scores(usercf.recommend(rated, _user_model(rated)))


@query
def usercf_predict_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same, computed in blocks however small the tables are."""
    rated = _supplier(spark, sf)
    return _scores(usercf.predict(rated, rated, _user_model(rated), join_limit=0))


@query
def usercf_recommend_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rated = _supplier(spark, sf)
    return _scores(usercf.recommend(rated, _user_model(rated), join_limit=0))


@query
def usercf_rmse(spark: SparkSession, sf: str) -> DataFrame:
    training, test = sampling.split_ratings(_supplier(spark, sf), 80)
    return _error(usercf.evaluate(training, test, _user_model(training)))


#: Cosines of parts and of customers that count as similar, and the length of neighbour lists.
SIMILAR_PARTS, SIMILAR_CUSTOMERS, NEAREST = 0.45, 0.1, 20


@query
def item_cosine_above(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that the same suppliers sell alike, by an index that leaves most products out."""
    return _sims(neighbours.similar_pairs(_supplier(spark, sf), SIMILAR_PARTS))


@query
def user_cosine_above(spark: SparkSession, sf: str) -> DataFrame:
    return _sims(neighbours.similar_users(_part(spark, sf), SIMILAR_CUSTOMERS))


@query
def user_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest customers of every customer, exactly."""
    near = _sims(neighbours.nearest_users(_part(spark, sf), NEAREST))
    return near.select(F.col("item").alias("user"), "rank", "neighbour", "sim")


@query
def usercf_predict_near(spark: SparkSession, sf: str) -> DataFrame:
    """A user-based model whose table holds each customer's nearest ones, not all pairs."""
    rated = _part(spark, sf)
    near = stage(neighbours.neighbour_weights(neighbours.nearest_users(rated, NEAREST)), "cosine")
    return _scores(usercf.predict(rated, rated, near))


# --- factor models ----------------------------------------------------------


@query
def normalised_observed(spark: SparkSession, sf: str) -> DataFrame:
    return _values(normalise.normalised_observed(_brand(spark, sf)))


@query
def normalised_dense(spark: SparkSession, sf: str) -> DataFrame:
    return _values(normalise.normalised_dense(_brand(spark, sf)))


@query
def svd_singular_values(spark: SparkSession, sf: str) -> DataFrame:
    factors = svd.decompose(_brand(spark, sf), RANK)
    return factors.singular_values().withColumn("s", stable_round(F.col("s")))


@query
def svd_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    every = grid_pairs(rated.select("user").distinct(), rated.select("item").distinct())
    return _scores(svd.reconstruct(svd.decompose(rated, RANK), every))


@query
def svd_reconstruct_full_rank(spark: SparkSession, sf: str) -> DataFrame:
    """At full rank the matrix itself must come back."""
    rated = _brand(spark, sf)
    rank = rated.select("item").distinct().count()
    every = grid_pairs(rated.select("user").distinct(), rated.select("item").distinct())
    scores = svd.reconstruct(svd.decompose(rated, rank), every)
    return scores.withColumn("score", F.abs(stable_round(F.col("score"), 5)))


@query
def svd_energy(spark: SparkSession, sf: str) -> DataFrame:
    """The squared singular values add up to the squared ratings."""
    rated = _brand(spark, sf)
    values = svd.decompose(rated, rated.select("item").distinct().count()).singular_values()
    return values.agg(F.round(F.sum(F.col("s") * F.col("s")) + 1e-6, 3).alias("energy"))


@query
def svd_bidiagonal_energy(spark: SparkSession, sf: str) -> DataFrame:
    """The squared singular values add up to the squared ratings."""
    rated = _brand(spark, sf)
    values = svd.bidiagonalised(rated, rated.select("item").distinct().count()).singular_values()
    return values.agg(F.round(F.sum(F.col("s") * F.col("s")) + 1e-6, 3).alias("energy"))


@query
def svd_normalised_energy(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the mean-normalised matrix, missing cells included."""
    rated = _brand(spark, sf)
    values = svd.decompose_normalised(rated, rated.select("item").distinct().count()).singular_values()
    return values.agg(F.round(F.sum(F.col("s") * F.col("s")) + 1e-6, 3).alias("energy"))


@query
def svd_rmse(spark: SparkSession, sf: str) -> DataFrame:
    training, test = sampling.split_ratings(_brand(spark, sf), 80)
    return _error(svdcf.evaluate_reconstruction(test, svd.decompose(training, RANK)))


@query
def svditem_similarity(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    pairs = gram.pair_products(rated, "user", "item", "rating").select("i", "j")
    return _sims(svd.feature_cosine(svd.item_features(svd.decompose(rated, RANK)), pairs))


@query
def svditem_predict(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    return _scores(svdcf.predict_by_features(rated, rated, svd.decompose(rated, RANK)))


@query
def svditem_recommend(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    return _scores(svdcf.recommend_by_features(rated, svd.decompose(rated, RANK)))


@query
def svditem_rmse(spark: SparkSession, sf: str) -> DataFrame:
    training, test = sampling.split_ratings(_brand(spark, sf), 80)
    return _error(svdcf.evaluate_by_features(training, test, svd.decompose(training, RANK)))


@query
def svdplus_predict(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    return _scores(svdcf.predict_normalised(rated, rated, svd.decompose_normalised(rated, RANK)))


@query
def svdplus_rmse(spark: SparkSession, sf: str) -> DataFrame:
    training, test = sampling.split_ratings(_brand(spark, sf), 80)
    return _error(svdcf.evaluate_normalised(training, test, svd.decompose_normalised(training, RANK)))


# With one factor the decomposition is a power iteration, which SQL can repeat.


@query
def svd_rank1_values(spark: SparkSession, sf: str) -> DataFrame:
    values = svd.decompose(_brand(spark, sf), 1).singular_values()
    return values.withColumn("s", stable_round(F.col("s"), 4))


@query
def svd_rank1_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    every = grid_pairs(rated.select("user").distinct(), rated.select("item").distinct())
    return _scores(svd.reconstruct(svd.decompose(rated, 1), every))


@query
def svd_rank1_rmse(spark: SparkSession, sf: str) -> DataFrame:
    training, test = sampling.split_ratings(_brand(spark, sf), 80)
    return _error(svdcf.evaluate_reconstruction(test, svd.decompose(training, 1)))


@query
def svditem_rank1_predict(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    return _scores(svdcf.predict_by_features(rated, rated, svd.decompose(rated, 1)))


@query
def svditem_rank1_recommend(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    return _scores(svdcf.recommend_by_features(rated, svd.decompose(rated, 1)))


@query
def svdplus_rank1_predict(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    return _scores(svdcf.predict_normalised(rated, rated, svd.decompose_normalised(rated, 1)))


@query
def svdplus_rank1_rmse(spark: SparkSession, sf: str) -> DataFrame:
    training, test = sampling.split_ratings(_brand(spark, sf), 80)
    return _error(svdcf.evaluate_normalised(training, test, svd.decompose_normalised(training, 1)))


@query
def als_rank1_rmse(spark: SparkSession, sf: str) -> DataFrame:
    error = als.train_and_evaluate(_brand(spark, sf), rank=1, iterations=30)
    return error.withColumn("rmse", stable_round(F.col("rmse"), 4))


@query
def als_predict(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    return _scores(als.predict(als.train(rated), rated))


@query
def als_recommend(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    return _scores(als.recommend(als.train(rated), rated))


@query
def als_rmse(spark: SparkSession, sf: str) -> DataFrame:
    return _error(als.train_and_evaluate(_brand(spark, sf)))


@query
def als_rmse_implicit(spark: SparkSession, sf: str) -> DataFrame:
    return _error(als.train_and_evaluate(_brand(spark, sf), implicit=True))


# --- text formats, written and read back ------------------------------------


def _written(spark: SparkSession, lines: DataFrame, label: str) -> str:
    path = scratch_path(spark, label)
    out.write_lines(lines, path)
    return path


@query
def ratings_text(spark: SparkSession, sf: str) -> DataFrame:
    rated = tables.ratings_part(spark, sf).withColumn("rating", stable_round(F.col("rating"), 4))
    return src.read_ratings(spark, _written(spark, out.rating_lines(rated), "ratings"))


@query
def ratings_text_transposed(spark: SparkSession, sf: str) -> DataFrame:
    rated = tables.ratings_part(spark, sf).withColumn("rating", stable_round(F.col("rating"), 4))
    return src.read_ratings(spark, _written(spark, out.rating_lines(rated), "ratings"), transposed=True)


@query
def raw_ratings_text(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines with ids by first appearance in the file."""
    rows = tables.raw_ratings(spark, sf).orderBy("l_orderkey", "l_linenumber", "l_partkey")
    lines = rows.select(F.concat_ws(",", "raw_user", "raw_item", F.col("rating").cast("string")).alias("value"))
    read = src.read_raw_ratings(spark, _written(spark, lines, "raw"))
    return index.ids_by_first_seen(read, "raw_item", src.RAW_POSITION)


@query
def map_ids_text(spark: SparkSession, sf: str) -> DataFrame:
    """The job from raw lines to mapped lines: its item map, with the ratings of each item in both parts."""
    rows = tables.raw_ratings(spark, sf).orderBy("l_orderkey", "l_linenumber", "l_partkey")
    lines = rows.select(F.concat_ws(",", "raw_user", "raw_item", F.col("rating").cast("string")).alias("value"))
    folder = scratch_path(spark, "mapped")
    jobs.map_ids(spark, _written(spark, lines, "raw"), folder, 80)
    parts = src.read_ratings(spark, f"{folder}/training").union(src.read_ratings(spark, f"{folder}/testing"))
    counts = parts.groupBy(F.col("item").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    return src.read_id_map(spark, f"{folder}/items").join(counts, "idx").select("raw", "idx", "n")


@query
def numbered_lines_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    lines = rows.select(F.concat_ws(",", "l_orderkey", "l_linenumber", "l_partkey").alias("value"))
    return src.read_numbered_lines(spark, _written(spark, lines, "numbered"))


@query
def id_map_text(spark: SparkSession, sf: str) -> DataFrame:
    ids = index.ids_by_value(tables.raw_ratings(spark, sf), "raw_item")
    return src.read_id_map(spark, _written(spark, out.id_map_lines(ids), "ids"))


@query
def baskets_text(spark: SparkSession, sf: str) -> DataFrame:
    """Baskets as lines of parts, repeats included; items counted once per basket."""
    lines = tables.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.concat_ws(",", F.collect_list(F.col("l_partkey").cast("string"))).alias("value")
    ).select("value")
    read = src.read_baskets(spark, _written(spark, lines, "baskets"), "bigint")
    return itemsets.item_frequency(itemsets.basket_cells(read))


@query
def tid_baskets_text(spark: SparkSession, sf: str) -> DataFrame:
    """Baskets of brand names with a leading id, collapsed."""
    baskets = tables.baskets_brand(spark, sf)
    names = F.transform("items", lambda x: F.concat(F.lit("B"), x.cast("string")))
    lines = baskets.select(F.concat_ws(",", F.col("basket").cast("string"), names).alias("value"))
    read = src.read_baskets(spark, _written(spark, lines, "tid_baskets"), "string", leading_id=True)
    return itemsets.collapse_baskets(read).select(joined(F.col("items")).alias("items"), "weight")


@query
def string_baskets_text(spark: SparkSession, sf: str) -> DataFrame:
    """Baskets of brand names without an id; a repeated name would fail the query."""
    names = F.transform("items", lambda x: F.concat(F.lit("B"), x.cast("string")))
    lines = tables.baskets_brand(spark, sf).select(F.concat_ws(",", names).alias("value"))
    read = src.read_baskets(spark, _written(spark, lines, "string_baskets"), "string")
    found = fp_itemsets(read, 0.1, duplicates="error").filter("size = 1")
    return found.select(joined(F.col("items")).alias("items"), "freq")


@query
def itemset_lines_text(spark: SparkSession, sf: str) -> DataFrame:
    found = fp_itemsets(tables.baskets_brand(spark, sf), PAIR_SUPPORT)
    return src.read_lines(spark, _written(spark, out.counted_itemset_lines(found), "itemsets"))


@query
def pair_lines_text(spark: SparkSession, sf: str) -> DataFrame:
    found = itemsets.frequent_pairs(_basket_cells(spark, sf), _count(spark, sf, PAIR_SUPPORT))
    return src.read_lines(spark, _written(spark, out.itemset_lines(found), "pairs"))


@query
def level_folders_text(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "levels")
    found = out.write_levels(itemsets.apriori(_basket_cells(spark, sf), _count(spark, sf, PAIR_SUPPORT), 3), path)
    levels = [
        src.read_lines(spark, f"{path}/{k}").withColumn("size", F.lit(k).cast("long"))
        for k in range(1, found + 1)
    ]
    whole = spark.createDataFrame([], "value string, size long")
    for level in levels:
        whole = whole.union(level)
    return whole


@query
def support_folders_text(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "support")
    found = itemsets.weighted_itemsets(tables.baskets_brand(spark, sf), PAIR_SUPPORT)
    found = found.withColumn("support", stable_round(F.col("support"), 4))
    out.write_by_size(out.support_lines(found), path)
    return spark.read.text(path).select("value", F.col("size").cast("long").alias("size"))


@query
def recommendation_lines_text(spark: SparkSession, sf: str) -> DataFrame:
    rated = _brand(spark, sf)
    ranked = _scores(itemcf.recommend(rated, _item_model(rated)))
    return src.read_lines(spark, _written(spark, out.recommendation_lines(ranked), "recommendations"))


@query
def sparse_matrix_text(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse row lines, written in user order and read back as cells."""
    rated = tables.ratings_brand(spark, sf).withColumn("rating", stable_round(F.col("rating"), 4))
    lines = out.sparse_row_lines(rated).orderBy("user").select("value")
    return src.read_sparse_rows(spark, _written(spark, lines, "sparse"))


@query
def dense_matrix_text(spark: SparkSession, sf: str) -> DataFrame:
    """Dense row lines, written in user order and read back as cells."""
    rated = _brand(spark, sf)
    every = grid_pairs(rated.select("user").distinct(), rated.select("item").distinct())
    filled = every.join(rated, ["user", "item"], "left").select(
        "user", "item", F.coalesce(stable_round(F.col("rating"), 4), F.lit(0.0)).alias("score")
    )
    lines = out.dense_rows(filled).orderBy("row").select(
        F.concat_ws(",", F.transform("values", lambda x: x.cast("string"))).alias("value")
    )
    return src.dense_cells(src.read_dense_rows(spark, _written(spark, lines, "dense")))


@query
def full_shape_rows_text(spark: SparkSession, sf: str) -> DataFrame:
    """Dense row text with empty rows and columns, through the full-rank matrix and back: every cell is there."""
    rated = stage(tables.ratings_brand(spark, sf).withColumn("rating", stable_round(F.col("rating"), 4)), "ratings_brand")
    last = rated.agg(F.max("user").alias("user"), F.max("item").alias("item"), F.countDistinct("item").alias("n")).first()
    users = spark.range((last["user"] or 0) + 3).withColumnRenamed("id", "user")
    items = spark.range((last["item"] or 0) + 3).withColumnRenamed("id", "item")
    filled = grid_pairs(users, items).join(rated, ["user", "item"], "left").select(
        "user", "item", F.coalesce("rating", F.lit(0.0)).alias("score")
    )
    lines = out.dense_rows(filled).orderBy("row").select(
        F.concat_ws(",", F.transform("values", lambda x: x.cast("string"))).alias("value")
    )
    source, result = scratch_path(spark, "full_shape"), scratch_path(spark, "full_shape_rows")
    out.write_lines(lines, source)
    jobs.reconstruct_dense_rows(spark, source, result, max(1, last["n"]))
    cells = spark.read.parquet(result).select("row", F.posexplode("values").alias("col", "value"))
    return cells.withColumn("value", stable_round(F.col("value"), 4) + F.lit(0.0))
