"""Alternating least squares."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.numeric import clamp_unit, implicit_confidence, implicit_truth
from ratingloom.operators.bounded import best_items
from ratingloom.operators.evaluate import rmse
from ratingloom.operators.rank import TOP
from ratingloom.operators.sampling import SEED, split_ratings
from ratingloom.session import ensure_checkpoint_dir, scratch_path, stage


def as_confidence(cells: DataFrame) -> DataFrame:
    """Ratings on a 1-5 scale as signed confidences."""
    return cells.withColumn("rating", implicit_confidence(F.col("rating")))


def train(
    cells: DataFrame,
    rank: int = 10,
    iterations: int = 20,
    reg: float = 1.0,
    implicit: bool = False,
    user_blocks: int | None = None,
    item_blocks: int | None = None,
    seed: int = SEED,
) -> ALSModel:
    """Fit the factors.  Without explicit block numbers there is one per core.

    ``cells`` must hold each (user, item) once and ids in Int range, so no user or
    item has more ratings than there are items or users.

    A user or item without a positive confidence has the zero vector as its implicit
    factor, exactly: nothing pulls it away.  Spark does not regularise such rows, and their
    systems can be singular; so they take no part, and their zero vectors join the model.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    if implicit:
        unliked = {side: stage(_without_positive(cells, side), f"als-unliked-{side}") for side in ("user", "item")}
        liked = cells
        for side, ids in unliked.items():
            if not ids.isEmpty():
                liked = liked.join(ids, side, "left_anti")
        if liked is not cells and not (liked := stage(liked, "als-liked")).isEmpty():
            model = _fit(liked, rank, iterations, reg, True, user_blocks, item_blocks, seed)
            return _with_zeros(model, unliked)
    return _fit(cells, rank, iterations, reg, implicit, user_blocks, item_blocks, seed)


def _without_positive(cells: DataFrame, side: str) -> DataFrame:
    """The ids of one side, as the model has them, all of whose confidences are zero or below."""
    return cells.groupBy(F.col(side)).agg(F.max("rating").alias("most")).filter("most <= 0").select(side)


def _with_zeros(model: ALSModel, ids: dict[str, DataFrame]) -> ALSModel:
    """The model with zero vectors for more users and items, by way of its stored form."""
    spark = model.userFactors.sparkSession
    path = scratch_path(spark, "als-model")
    model.save(path)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), model.rank).alias("features")
    for side, new in ids.items():
        new.filter(F.col(side).isNotNull()).select(F.col(side).cast("int").alias("id"), zeros).write.mode("append").parquet(
            f"{path}/{side}Factors"
        )
    return ALSModel.load(path)


def _fit(
    cells: DataFrame, rank: int, iterations: int, reg: float, implicit: bool,
    user_blocks: int | None, item_blocks: int | None, seed: int,
) -> ALSModel:
    auto = max(10, cells.sparkSession.sparkContext.defaultParallelism)
    return ALS(
        userCol="user", itemCol="item", ratingCol="rating",
        rank=rank, maxIter=iterations, regParam=reg, implicitPrefs=implicit,
        numUserBlocks=user_blocks or auto, numItemBlocks=item_blocks or auto,
        coldStartStrategy="drop", seed=seed,
    ).fit(cells)


def predict(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """Scores for the given pairs: ``user, item, score``."""
    return model.transform(pairs.select("user", "item")).select(
        "user", "item", F.col("prediction").cast("double").alias("score")
    )


def recommend(model: ALSModel, cells: DataFrame, n: int = TOP) -> DataFrame:
    """The ``n`` best unknown items of every user: ``user, rank, item, score``.

    Blocks of items that cannot reach a user's list are not multiplied.
    """
    return best_items(*sides(model, cells), n)


def sides(model: ALSModel, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users, items and known pairs as the list operators take them."""
    doubles = F.transform("features", lambda x: x.cast("double"))
    users = model.userFactors.select(
        F.col("id").cast("long").alias("user"),
        F.lit(0.0).alias("above"), doubles.alias("above_f"),
        F.lit(1.0).alias("below"), F.lit(None).cast("array<double>").alias("below_f"),
    )
    items = model.itemFactors.select(F.col("id").cast("long").alias("item"), doubles.alias("f"))
    return users, items, cells.select("user", "item")


def evaluate(model: ALSModel, test: DataFrame, implicit: bool = False) -> DataFrame:
    """RMSE; with implicit data against 0/1, with predictions clamped to [0, 1]."""
    scores = predict(model, test)
    if implicit:
        scores = scores.withColumn("score", clamp_unit(F.col("score")))
        test = test.withColumn("rating", implicit_truth(F.col("rating")))
    return rmse(scores, test)


def train_and_evaluate(
    ratings: DataFrame, train_rate: int = 80, implicit: bool = False, seed: int = SEED, **params
) -> DataFrame:
    """Split, fit on the larger part, measure on the rest."""
    cells = stage(as_confidence(ratings) if implicit else ratings, "als_cells")
    training, test = split_ratings(cells, train_rate, seed)
    return evaluate(train(training, implicit=implicit, seed=seed, **params), test, implicit)
