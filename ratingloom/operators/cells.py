"""Preparing rating triples: duplicates, zeros, transposition, width, means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rating_cells(
    ratings: DataFrame,
    duplicates: str = "average",
    position: str | Column | None = None,
    drop_zero: bool = True,
) -> DataFrame:
    """One row per (user, item).

    ``duplicates`` is ``average`` or ``last``; ``last`` needs the ``position``
    that tells which row came later.  A rating of zero means "not rated" and is
    dropped unless ``drop_zero`` is off.
    """
    keys = ratings.groupBy("user", "item")
    if duplicates == "average":
        cells = keys.agg(F.avg("rating").alias("rating"))
    elif duplicates == "last":
        if position is None:
            raise ValueError("duplicates='last' needs a position")
        cells = keys.agg(F.max_by("rating", position).alias("rating"))
    else:
        raise ValueError(f"unknown duplicates rule: {duplicates}")
    return cells.filter(F.col("rating") != 0.0) if drop_zero else cells


def transpose(ratings: DataFrame) -> DataFrame:
    """Swap the roles of user and item."""
    return ratings.select(
        F.col("item").alias("user"), F.col("user").alias("item"), *(
            c for c in ratings.columns if c not in ("user", "item")
        )
    )


def matrix_width(ratings: DataFrame, column: str = "item") -> DataFrame:
    """Greatest index plus one."""
    return ratings.agg((F.max(column) + 1).cast("long").alias("width"))


def user_means(ratings: DataFrame) -> DataFrame:
    """Mean rating of every user."""
    return ratings.groupBy("user").agg(F.avg("rating").alias("user_mean"))


def item_means(ratings: DataFrame) -> DataFrame:
    """Mean rating of every item."""
    return ratings.groupBy("item").agg(F.avg("rating").alias("item_mean"))


def rating_profile(ratings: DataFrame) -> DataFrame:
    """Rows, distinct users and distinct items.

    Three flat aggregates instead of two distinct counts in one, which would
    expand every row twice before the shuffle.
    """
    rows = ratings.agg(F.count(F.lit(1)).alias("ratings"))
    users = ratings.select("user").distinct().agg(F.count(F.lit(1)).alias("users"))
    items = ratings.select("item").distinct().agg(F.count(F.lit(1)).alias("items"))
    return rows.select(
        "ratings", users.scalar().alias("users"), items.scalar().alias("items")
    )
