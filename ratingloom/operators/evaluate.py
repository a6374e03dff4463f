"""Prediction error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rmse(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Root mean squared error over the pairs that have both: one row, ``rmse``."""
    error = F.col("score") - F.col("rating")
    return (
        predictions.select("user", "item", "score")
        .join(truth.select("user", "item", "rating"), ["user", "item"])
        .agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    )
