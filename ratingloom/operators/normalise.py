"""Mean-normalised ratings.

An observed cell becomes ``rating - user mean``; a missing cell of a rated item
becomes ``item mean - user mean``; a column without any rating becomes zero.
With E = rating - item mean on the observed cells, m the item means and u the
user means, the whole matrix is ``E + 1 m' - u 1'`` on the rated columns: one
sparse part and two vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.operators.cells import item_means, user_means
from ratingloom.operators.grid import grid_pairs


def normalised_observed(cells: DataFrame) -> DataFrame:
    """The observed cells: ``user, item, value``."""
    return cells.join(user_means(cells), "user").select(
        "user", "item", (F.col("rating") - F.col("user_mean")).alias("value")
    )


def normalised_dense(cells: DataFrame) -> DataFrame:
    """Every user with every rated item: ``user, item, value``.

    As long as users times items; the models below never need it.
    """
    grid = grid_pairs(user_means(cells), item_means(cells))
    return (
        grid.join(cells.select("user", "item", "rating"), ["user", "item"], "left")
        .select(
            "user", "item",
            (F.coalesce("rating", "item_mean") - F.col("user_mean")).alias("value"),
        )
    )


def item_deviations(cells: DataFrame) -> DataFrame:
    """The sparse part E: ``user, item, rating`` with the item mean taken off."""
    return cells.join(item_means(cells), "item").select(
        "user", "item", (F.col("rating") - F.col("item_mean")).alias("rating")
    )
