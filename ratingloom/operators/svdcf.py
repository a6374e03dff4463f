"""Recommendation from SVD factors.

Cosines between item factors are dot products of unit vectors, so every sum over
items that the neighbourhood formulas need becomes one vector of length k per
user (or one for all users).  No items-by-items table is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.numeric import dot, ratio, scale_by
from ratingloom.operators.bounded import best_items
from ratingloom.operators.cells import matrix_width, user_means
from ratingloom.operators.evaluate import rmse
from ratingloom.operators.lanczos import cross
from ratingloom.operators.rank import TOP
from ratingloom.operators.svd import Factors, item_features, reconstruct, unit_features
from ratingloom.session import stage


def predict_by_features(pairs: DataFrame, cells: DataFrame, factors: Factors) -> DataFrame:
    """Item-based scores with cosines between item factors: ``user, item, score``.

    An item is not similar to itself here, so a rated item takes its own term out
    of the user's sums.
    """
    unit = unit_features(item_features(factors))
    known = cells.select("user", "item", F.col("rating").alias("own"))
    wanted = pairs.select("user", "item").distinct().join(known, ["user", "item"], "left")
    own = F.coalesce("own", F.lit(0.0))
    is_known = F.when(F.col("own").isNull(), 0.0).otherwise(1.0)
    above = F.col("above") + dot(F.col("above_f"), F.col("f")) - F.col("z") * own
    below = F.col("below") + dot(F.col("below_f"), F.col("f")) - F.col("z") * is_known
    return (
        wanted.join(_profiles(cells, unit, len(factors.values)), "user").join(unit, "item")
        .select("user", "item", ratio(above, below).alias("score"))
        .filter(F.col("score").isNotNull())
    )


def recommend_by_features(cells: DataFrame, factors: Factors, n: int = TOP) -> DataFrame:
    """The ``n`` best unrated items of every user: ``user, rank, item, score``."""
    unit = unit_features(item_features(factors))
    profiles = stage(_profiles(cells, unit, len(factors.values)), "profiles")
    return best_items(profiles, unit.select("item", "f"), cells.select("user", "item"), n)


def evaluate_by_features(cells: DataFrame, test: DataFrame, factors: Factors) -> DataFrame:
    """RMSE of the item-based scores."""
    return rmse(predict_by_features(test, cells, factors), test)


def predict_normalised(pairs: DataFrame, cells: DataFrame, factors: Factors) -> DataFrame:
    """Scores from the reconstructed normalised matrix: ``user, item, score``.

    The score is the user's mean plus the average of the user's reconstructed row
    over all items, weighted by similarity to the target.  Both sums over items
    fold into one vector and one number per target item.
    """
    k = len(factors.values)
    if k == 0:
        # All deviations vanish: nothing but the user's mean is left.
        means = user_means(cells)
        return pairs.select("user", "item").distinct().join(means, "user").join(factors.items.select("item"), "item").select(
            "user", "item", F.col("user_mean").alias("score")
        )
    unit = unit_features(item_features(factors, weighted=True))
    both = unit.join(factors.items.withColumnRenamed("f", "v"), "item")
    sums = both.agg(
        *[F.sum(F.col("v")[a]).alias(f"v{a}") for a in range(k)],
        *[F.sum(F.col("f")[a]).alias(f"t{a}") for a in range(k)],
    ).first()
    mixed_by = cross(both.select(F.col("v").alias("f"), F.col("f").alias("g")), k, k)
    width = matrix_width(cells).first()["width"]
    totals = [sums[f"t{a}"] for a in range(k)]

    def weighted(a: int):
        mixed = dot(F.array(*[F.lit(float(x)) for x in mixed_by[a]]), F.col("f"))
        return F.lit(0.5 * sums[f"v{a}"]) + F.lit(0.5) * (mixed - F.col("z") * F.col("v")[a])

    overall = dot(F.array(*[F.lit(t) for t in totals]), F.col("f"))
    targets = both.select(
        "item",
        F.array(*[weighted(a) for a in range(k)]).alias("w"),
        (F.lit(width / 2.0) + F.lit(0.5) * (overall - F.col("z"))).alias("d"),
    )
    people = factors.users.join(user_means(cells), "user").select(
        "user", "user_mean", scale_by(F.col("f"), factors.values).alias("us")
    )
    return (
        pairs.select("user", "item").distinct().join(people, "user").join(targets, "item")
        .select(
            "user", "item",
            (F.col("user_mean") + ratio(dot(F.col("us"), F.col("w")), F.col("d"))).alias("score"),
        )
        .filter(F.col("score").isNotNull())
    )


def evaluate_normalised(cells: DataFrame, test: DataFrame, factors: Factors) -> DataFrame:
    """RMSE of the scores from the normalised matrix."""
    return rmse(predict_normalised(test, cells, factors), test)


def evaluate_reconstruction(test: DataFrame, factors: Factors) -> DataFrame:
    """RMSE of the rank-k matrix itself as the prediction."""
    return rmse(reconstruct(factors, test), test)


def _profiles(cells: DataFrame, unit: DataFrame, k: int) -> DataFrame:
    """Per user the sum and number of ratings, plain and along the unit vectors."""
    above = [F.sum(F.col("rating") * F.col("f")[c]).alias(f"a{c}") for c in range(k)]
    below = [F.sum(F.col("f")[c]).alias(f"b{c}") for c in range(k)]
    return (
        cells.join(unit, "item").groupBy("user")
        .agg(F.sum("rating").alias("above"), F.count(F.lit(1)).cast("double").alias("below"), *above, *below)
        .select(
            "user", "above", F.array(*[f"a{c}" for c in range(k)]).alias("above_f"),
            "below", F.array(*[f"b{c}" for c in range(k)]).alias("below_f"),
        )
    )
